"""Budgeted chat windows: conversations as formatted training rows with a loss mask, in DataFrame functions only.

A turn is written ``<s>role\\ntext</s>``; ``&``, ``<`` and ``[`` inside texts and roles (and line feeds inside roles)
are written as entities, so no text can hold a control string, and the escape is reversible.

Prefix sums of turn tokens choose the spans: a conversation's tokens are cut into blocks of ``budget`` less history and
system turn; a turn belongs to the block in which it begins, and one that reaches over its block's end makes a window of
its own. So a window's own turns fit the block, or are one single turn that is longer (turns are never cut). Each window
repeats the conversation's first system turn, if that came before it, and the turns that begin within ``history``
tokens before it. The loss mask lists the assistant texts of a window's own turns; repeated ones are not in it, so each
assistant text is a target once.

Defined cases: null role or text is empty; null ids make a conversation of their own; turns that tie are ordered by role, then
text; repeated rows are separate turns; an empty table gives no rows; further columns are ignored. A block has a quarter of the budget at
least, so windows of a conversation whose history and system turn leave less go over the budget by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BEGIN, END = "<s>", "</s>"
#: Tokens that a turn's markers and role count for, besides its words.
TURN_TOKENS = 4
BUDGET, HISTORY = 512, 128


def escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescaped(c: Column) -> Column:
    for plain, entity in (("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, mask array<struct<start, length>> (code points), n_repeated, n_turns, n_tokens.

    The first ``n_repeated`` turns in ``formatted`` stand in earlier windows too; ``n_tokens`` counts all of them.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        escaped(text).alias("body"),
        F.concat(F.lit(BEGIN), F.replace(escaped(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + TURN_TOKENS).cast("long").alias("tokens"),
    )
    rows = rows.select("*", F.concat("head", "body", F.lit(END)).alias("whole"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id", "role", "body", "head", "whole", "tokens",
        F.row_number().over(order).alias("pos"),
        (F.sum("tokens").over(so_far) - F.col("tokens")).alias("before"),
        (F.sum(F.char_length("whole")).over(so_far) - F.char_length("whole")).alias("chars_before"),
    )
    first_system = F.min(F.when(F.col("role") == "system", F.struct("pos", "whole", "tokens")))
    rows = rows.withColumn("sys", first_system.over(Window.partitionBy("conv_id")))
    block = F.greatest(budget - history - F.coalesce("sys.tokens", F.lit(0)), F.lit(budget // 4)).cast("long")
    rows = rows.withColumn("block", F.floor(F.col("before") / block))
    rows = rows.withColumn("over", F.col("before") + F.col("tokens") > (F.col("block") + 1) * block)
    near = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    past = F.when(~F.col("pos").eqNullSafe(F.col("sys.pos")), F.struct("whole", "tokens"))
    rows = rows.withColumn("past", F.collect_list(past).over(near))
    own = F.array_sort(F.collect_list(F.struct("pos", "role", "head", "body", "whole", "tokens", "chars_before")))
    found = rows.groupBy("conv_id", "block", "over").agg(own.alias("own"), F.min_by("past", "pos").alias("past"), F.first("sys").alias("sys"))
    first = F.col("own")[0]
    retained = F.col("sys.pos") < first["pos"]
    found = found.select(
        "conv_id", "own",
        (F.col("block") * 2 + F.col("over").cast("long")).alias("at"),
        F.concat(F.when(retained, F.col("sys.whole")).otherwise(""), F.array_join(F.transform("past", lambda p: p["whole"]), "")).alias("lead"),
        (F.coalesce(retained, F.lit(False)).cast("long") + F.size("past")).alias("n_repeated"),
        (F.when(retained, F.col("sys.tokens")).otherwise(0) + F.aggregate("past", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])).alias("lead_tokens"),
    )
    targets = F.filter("own", lambda t: t["role"] == "assistant")
    start = lambda t: F.char_length("lead") + t["chars_before"] - first["chars_before"] + F.char_length(t["head"])
    return found.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("at")).alias("window"),
        F.concat("lead", F.array_join(F.transform("own", lambda t: t["whole"]), "")).alias("formatted"),
        F.transform(targets, lambda t: F.struct(start(t).cast("long").alias("start"), F.char_length(t["body"]).cast("long").alias("length"))).alias("mask"),
        "n_repeated",
        F.size("own").cast("long").alias("n_turns"),
        (F.col("lead_tokens") + F.aggregate("own", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns array<struct<role, text>> (a window's own), targets array<string>: parsed from the formatted text and its mask."""
    parts = F.split("formatted", END, -1)
    own = F.slice(parts, (F.col("n_repeated") + 1).cast("int"), (F.size(parts) - 1 - F.col("n_repeated")).cast("int"))
    turn = lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, "\n", 1), F.lit(len(BEGIN) + 1), F.lit(1 << 30))).alias("role"),
        unescaped(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.lit(1 << 30))).alias("text"),
    )
    targets = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(own, turn).alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    back = read_back(chat_windows(turns))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), F.array_join(F.transform("turns", line), "").alias("said"), F.array_join("targets", "").alias("loss"), "chars").alias("w"))
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("ws", lambda w: w["said"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )


OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {TURN_TOKENS} AS tokens,
         8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;'))
           + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS chars
  FROM c
), p AS (
  SELECT *, row_number() OVER w AS pos, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS sys_pos FROM p
), y AS (
  SELECT *, max(CASE WHEN pos = sys_pos THEN tokens END) OVER (PARTITION BY conv_id) AS sys_tokens,
         max(CASE WHEN pos = sys_pos THEN chars END) OVER (PARTITION BY conv_id) AS sys_chars FROM s
), h AS (
  SELECT *, coalesce(sum(CASE WHEN pos IS DISTINCT FROM sys_pos THEN chars END) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING), 0) AS past_chars,
         greatest({BUDGET - HISTORY} - coalesce(sys_tokens, 0), {BUDGET // 4}) AS size FROM y
), b AS (
  SELECT *, CAST(floor(before / size) AS BIGINT) AS block FROM h
), k AS (
  SELECT conv_id, block, before + tokens > (block + 1) * size AS over,
         sum(chars) + min_by(past_chars, pos) + CASE WHEN min(sys_pos) < min(pos) THEN min(sys_chars) ELSE 0 END AS chars
  FROM b GROUP BY 1, 2, 3
), f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM k GROUP BY conv_id),
t AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM p GROUP BY conv_id
)
SELECT t.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""
