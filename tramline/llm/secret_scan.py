"""Secret scans: fixed credential patterns, and values in a credential's place that are hard to guess.

The base patterns (``assign``, ``access``, ``hex``) always give their spans. Kind ``guess`` adds values that follow a
wider list of credential names and are priced at ``10 ** MIN_GUESSES`` guesses or more. The price is that of the cheapest
segmentation of the value, found by dynamic programming over its characters. A segment's price is the decimal logarithm
of the guesses it takes, besides ``SEGMENT_COST`` for each:

* word: the rank of a known word of 3 to ``LONGEST`` letters, with the case and look-alike digits undone at a price. Known are
  a few words that passwords are made of, and the ``LEXICON`` commonest words of all documents (``lexicon``), values in
  a credential's place left out and at least ``LEAST`` times, so ordinary prose is cheap and no secret vouches for itself;
* date: days with or without separators, years;
* repeat: a unit of 1 to ``UNIT`` characters by brute force, and each repetition;
* walk: three or more keys, each beside the one before (or up or down the alphabet), by steps straight on and turns;
* brute force: each character by the size of its alphabet.

All spans of these kinds are candidates, any start and end, so the segmentation is the cheapest there is. Placeholders such as
``changeme`` or ``qwerty12345`` are cheap and so left alone; a span that a base ``assign`` span covers is not given again.

Spans are in code points, end exclusive, over whole texts. Defined cases: null or empty text has no spans; repeated rows are
scanned each; values of any length are priced whole, in time proportional to their length; further columns pass through, but one
named ``spans``, which is replaced.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, table
from .pieces import forget

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Names whose value is priced.
NAMED = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|credentials?|(?:access|private|auth)[_-]?key|login)["']?\x20*[:=]\x20*["']?([^\x20\x09-\x0D"'<>,;]{6,})""", re.I | re.A)
HINTS = (b"pass", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"credential", b"key", b"login")
#: Decimal logarithm of the guesses from which a named value counts as a secret.
MIN_GUESSES = 8.0

# Words that passwords and placeholders are made of, commonest first.
WORDS = (
    "password pass admin user test login welcome letmein secret master root guest default change changeme "
    "qwerty monkey dragon shadow sunshine princess football baseball iloveyou superman batman trustno hello "
    "freedom whatever access server system example sample demo temp dummy placeholder your here insert "
    "token value string null none true false enter my the key api code name money love "
    "summer winter spring autumn company office house secure private public"
).split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKE = str.maketrans("4@301$57!", "aaeoissti")
_Y, _M, _D, _SEP = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
#: Ways to write a day or a year; each counts wherever it matches.
DATES = tuple(re.compile(f, re.A) for f in (_Y + _SEP + _M + _SEP + _D, _D + _SEP + _M + _SEP + _Y, _M + _SEP + _D + _SEP + _Y, _D + _SEP + _M + _SEP + r"\d\d", _Y))
#: Guesses for a date: days in 100 years, or years alone.
DATE_COST, YEAR_COST = math.log10(36_525 * 4), math.log10(100)
#: Cost of each segment besides its own: where it ends and what kind it is.
SEGMENT_COST = math.log10(5)
#: Longest unit of a repeat, and the price of each repetition.
UNIT, AGAIN_COST = 16, math.log10(1.5)
#: Price of a walk's first key, of a step straight on and of one that turns.
KEY_COST, STEP_COST, TURN_COST = math.log10(47), math.log10(1.5), math.log10(6)
#: Longest and commonest words that count, and how often they must occur.
LONGEST, LEXICON, LEAST = 20, 20_000, 3


@functools.cache
def _neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """The keys beside each key, and the direction in which they lie."""
    near: dict[str, dict[str, tuple[int, int]]] = {}
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)]
            near[c] = {ROWS[v][u]: (v - y, u - x) for v, u in around if 0 <= v < len(ROWS) and 0 <= u < len(ROWS[v])}
    return near


def _key_way(a: str, b: str) -> tuple[int, int] | None:
    """Direction from one key to the next; None if it is not beside it."""
    return _neighbours().get(a, {}).get(b)


def _letter_way(a: str, b: str) -> int | None:
    """1 or -1 if b comes after or before a in the alphabet or among digits."""
    return ord(b) - ord(a) if a.isalnum() and b.isalnum() and a.isascii() and b.isascii() and abs(ord(b) - ord(a)) == 1 else None


def _alphabet(c: str) -> int:
    return 10 if c.isascii() and c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _case_cost(word: str) -> float:
    return 0.0 if word.islower() else math.log10(2) if word.isupper() or word.istitle() else len(word) * math.log10(2)


@functools.cache
def _own_ranks() -> dict[str, int]:
    return {w: r for r, w in enumerate(WORDS, 1)}


def _word_cost(found: str, low: str, plain: str, lexicon: Mapping[str, int]) -> float | None:
    """Price of a word as it is spelt (``low``: in lower case, ``plain``: look-alikes undone); None if it is not known."""
    best = None
    for spelt, more in ((low, 0.0), *(((plain, math.log10(4)),) if plain != low else ())):
        for ranks in (_own_ranks(), lexicon):
            if rank := ranks.get(spelt):
                cost = math.log10(rank) + more
                best = cost if best is None else min(best, cost)
    return None if best is None else best + _case_cost(found)


def guess_cost(value: str, lexicon: Mapping[str, int] = {}) -> tuple[float, list[tuple[int, int, str]]]:  # noqa: B006
    """Decimal logarithm of the guesses for ``value``, and the segments (start, end, kind) that give it. ``lexicon``: ranks of further words, from 1."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a capital letter that has no single small one
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LOOKALIKE)
    single = [math.log10(_alphabet(c)) for c in value]
    upto = [0.0]
    for c in single:
        upto.append(upto[-1] + c)
    infinite = (math.inf, 0)
    # done[k]: the cheapest price of the first k characters, how[k]: the last segment's start and kind.
    done, how = [0.0], [(0, "")]
    # (price, start) of the cheapest segmentation whose last segment, still open, ends at k: by brute force, as a walk of two or more keys
    # (in the keyboard's or the alphabet's order), as a repeat with each length of unit.
    brute, walks, repeats = infinite, [[infinite, infinite, None], [infinite, infinite, None]], [[infinite] * (n + 1) for _ in range(UNIT + 1)]
    same = [0] * (UNIT + 1)
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for k in range(n + 1):
        if k:
            brute = min(brute, (done[k - 1] + SEGMENT_COST, k - 1))
            brute = (brute[0] + single[k - 1], brute[1])
            best = (*brute, "brute")
            for state, way_of in zip(walks, (_key_way, _letter_way)):
                way = way_of(low[k - 2], low[k - 1]) if k > 1 else None
                if way is None:
                    state[:] = infinite, infinite, None
                    continue
                step = STEP_COST if way == state[2] else TURN_COST
                longer = min((state[0][0] + step, state[0][1]), (state[1][0] + step, state[1][1]))
                state[:] = (done[k - 2] + SEGMENT_COST + KEY_COST + STEP_COST, k - 2), longer, way
                best = min(best, (*longer, "walk"))
            for p in range(1, min(UNIT, k - 1) + 1):
                same[p] = same[p] + 1 if value[k - 1] == value[k - 1 - p] else 0
                if same[p] >= p:
                    first = k - 2 * p
                    own = min((done[first] + SEGMENT_COST + upto[first + p] - upto[first] + AGAIN_COST, first), (repeats[p][k - p][0] + AGAIN_COST, repeats[p][k - p][1]))
                    repeats[p][k] = own
                    best = min(best, (*own, "repeat"))
            for i, kind, cost in ending.pop(k, ()):
                best = min(best, (done[i] + SEGMENT_COST + cost, i, kind))
            done.append(best[0])
            how.append(best[1:])
        for j in range(k + 3, min(n, k + LONGEST) + 1):
            if (cost := _word_cost(value[k:j], low[k:j], plain[k:j], lexicon)) is not None:
                ending.setdefault(j, []).append((k, "word", cost))
        for form in DATES:
            if k < n and value[k].isdigit() and (m := form.match(value, k)):
                ending.setdefault(m.end(), []).append((k, "date", DATE_COST if m.end() - k > 4 else YEAR_COST))
    parts, k = [], n
    while k:
        parts.append((how[k][0], k, how[k][1]))
        k = how[k][0]
    return done[-1], parts[::-1]


_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def lexicon(docs: DataFrame, text: str = "text", size: int = LEXICON) -> dict[str, int]:
    """Ranks, from 1, of the commonest words of all texts, without values in a credential's place: at most ``size`` of them.

    Words are counted in full; a histogram of their counts, in steps of a 64th of a power of two, then says from which count on
    there are no more than ``size``. So only those words leave the tasks, and none is preferred to another of its step.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        found: Counter = Counter()

        def rows():
            kept = {w: n for w, n in found.items() if 3 <= len(w) <= LONGEST}
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                low = raw.lower()
                if any(h in low for h in HINTS) and (b":" in raw or b"=" in raw):
                    low = NAMED.sub(" ", ASSIGN.sub(" ", t)).lower().encode("utf-8", "surrogatepass")
                found.update(low.translate(_LETTERS).split())
            if len(found) > 200_000:
                yield rows()
        yield rows()

    counted = docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.filter(F.col("n") >= LEAST).withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "word-counts")
    # A row for each step: some 4,000 at most.
    upto, first = 0, None
    for r in sorted(counted.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        upto += r["words"]
        if upto > size:
            break
        first = r["step"]
    if first is None:
        return {}
    # At most ``size`` words, whatever the input.
    best = sorted(counted.filter(F.col("step") >= first).select("word", "n").collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    return {bytes(r["word"]).decode("utf-8", "replace"): k for k, r in enumerate(best, 1)}


#: A text's bytes with hex digits as one letter and all else as another: long runs of hex are found by a plain search.
_HEX_RUNS = bytes(120 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


def scan_text(text: str, lexicon: Mapping[str, int] = {}) -> list[tuple[str, int, int, float | None]]:  # noqa: B006
    """(kind, start, end, log10 of the guesses or None) of all spans, by start and kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low, found = raw.lower(), []
    if any(h in low for h in HINTS) and (b":" in raw or b"=" in raw):
        taken = deque()
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append(("assign", m.start(), m.end(), guess_cost(m[2], lexicon)[0]))
                taken.append(m.span())
        for m in NAMED.finditer(text):
            i, j = m.span(1)
            while taken and taken[0][1] <= i:
                taken.popleft()
            if not (taken and taken[0][0] < j) and (cost := guess_cost(m[1], lexicon)[0]) >= MIN_GUESSES:
                found.append(("guess", i, j, cost))
    if b"AKIA" in raw:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in raw.translate(_HEX_RUNS):
        found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log10_guesses", T.DoubleType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))


def scan(docs: DataFrame, text: str = "text", redact: str | None = None, words: dict[str, int] | None = None) -> DataFrame:
    """Add ``spans`` array<struct<kind, start, end, log10_guesses>>; ``words``: ranks of known words, by default the ``lexicon`` of ``docs``. With ``redact``, that string replaces each span in the text
    (overlapping ones together), and a text without spans stays as it was, null included."""
    kept = [f for f in docs.schema.fields if f.name != "spans"]
    schema = T.StructType([*kept, T.StructField("spans", T.ArrayType(SPAN))])
    at = [f.name for f in kept].index(text)
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text) if words is None else words)

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            spans = [scan_text(t, known.value) if t else [] for t in texts]
            columns = list(b.columns)
            if redact is not None:
                columns[at] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(texts, spans)], columns[at].type)
            columns.append(pa.array([[dict(zip(("kind", "start", "end", "log10_guesses"), s)) for s in own] for own in spans], _ARROW))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for _, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
    )
