"""A digest index whose compaction is broken off, batches that come again, and token ids over all of Unicode."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.llm import exact_dedup
from tramline.llm.common import scratch

SCHEMA = "doc_id long, text string"


def batch(spark, first=0, n=200):
    return spark.createDataFrame([(i, f"text {i}") for i in range(first, first + n)], SCHEMA)


@pytest.mark.parametrize("step", ["_entry", "insert", "_name"])
def test_compaction_broken_off_at_each_step(spark, monkeypatch, step):
    path = scratch(spark, "broken")
    index = exact_dedup.DigestIndex(spark, path, 8)
    index.dedup(batch(spark)).count()
    before = sorted(map(tuple, index.rows().collect()))
    with monkeypatch.context() as m:
        def fail(*_, **__):
            raise RuntimeError("lost")

        if step == "insert":
            m.setattr(type(index.rows().write), "insertInto", fail)
        else:
            m.setattr(exact_dedup.DigestIndex, step, fail)
        with pytest.raises(RuntimeError, match="lost"):
            index.compact(32)
    # The same session, a new opening, and a compaction that goes through.
    for again in (index, exact_dedup.DigestIndex(spark, path, 3)):
        assert (again.generation, again.buckets) == (0, 8)
        assert again.dedup(batch(spark, 100)).filter("kept").count() == (200 if again is index else 200)
    whole = sorted(map(tuple, index.rows().collect()))
    assert len(whole) == 300 and set(before) <= set(whole)
    index.compact(32)
    opened = exact_dedup.DigestIndex(spark, path, 3)
    assert (opened.generation, opened.buckets) == (1, 32) and sorted(map(tuple, opened.rows().collect())) == whole
    opened.dedup(batch(spark)).count()
    assert opened.rows().count() == 300
    assert spark.table(opened.name).select("digest").inputFiles() and "generation-1" in opened.rows().inputFiles()[0]


def test_a_batch_that_comes_again_has_its_results_again(spark):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "again"), 4)
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (None, "c"), (None, "ab")], SCHEMA)
    rows = lambda d: sorted(map(str, d.collect()))
    first = rows(index.dedup(docs))
    assert rows(index.dedup(docs)) == first and index.rows().count() == 2
    # Another row with an indexed text is not kept, whatever its length.
    other = {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(spark.createDataFrame([(7, "a      b"), (3, "c")], SCHEMA)).collect()}
    assert other == {(7, 1, False), (3, 3, True)}


def test_rows_without_an_id_are_dealt_out(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert exact_dedup.digests(docs).select("salt").distinct().count() > 32
    index = exact_dedup.DigestIndex(spark, scratch(spark, "none"), 4)
    got = index.dedup(docs)
    assert got.count() == 2000 and {r.group_size for r in got.collect()} == {2000}
    assert exact_dedup.kept_rows(docs, exact_dedup.DigestIndex(spark, scratch(spark, "none"), 4)).count() == 1


TURKISH = ["GELDİ.", "SAHİBİ, ASKERİ; DENİZ", "İ.", "İSTANBUL'DA (İZMİR) İ!", "İ\n.İ", "ıİ,ŞĞ. ÇÖÜ;"]


def coders():
    """(encoder, the library's ids of a text) of each vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tramline.llm.byte_bpe import ranked_tokenizer
    from tramline.llm.pieces import PieceEncoder

    for name, cut in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")):
        yield name, (lambda n=name: Tokenizer.from_file(public_tokenizers.path(n))), cut, PieceEncoder
    yield "byte_bpe_50k.tiktoken", (lambda: ranked_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)), "spaces", PieceEncoder


@pytest.mark.parametrize("which", range(3))
def test_ids_over_all_of_unicode(which):
    """Each character up to U+FFFF at the end of a word before punctuation, a line feed and a space, and random rows of them."""
    import pyarrow as pa

    _, load, cut, kind = list(coders())[which]
    ours, library = kind(load, cut), load()
    library.encode_special_tokens = True
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(which)
    near = "abzÀéİıŞß.,;:!?'\"()-\n  \t 019"
    texts = TURKISH + [f"a{c}. x{c}y\n{c}, {c} (b{c})" for c in chars[:: 1 if which == 0 else 3]]
    texts += ["".join(rng.choice(near) if rng.random() < 0.7 else rng.choice(chars) for _ in range(rng.randrange(1, 30))) for _ in range(15_000)]
    for k in range(0, len(texts), 2000):
        part = texts[k : k + 2000]
        ids, at = ours.encode(pa.array(part))
        want = library.encode_batch_fast(part, add_special_tokens=False)
        wrong = [t for i, (t, w) in enumerate(zip(part, want)) if ids[at[i] : at[i + 1]].tolist() != w.ids]
        assert not wrong, wrong[:3]


@pytest.mark.parametrize("which", range(3))
def test_a_word_is_remembered_once_whatever_stands_beside_it(which):
    """Ids and memory of words with many marks before and after them; each such pair was a piece of its own before."""
    import pyarrow as pa

    _, load, cut, kind = list(coders())[which]
    ours, library = kind(load, cut), load()
    library.encode_special_tokens = True
    words = [a + b + c for a in ("Éb", "kö", "St", "ra") for b in ("ado", "ñel", "ırk") for c in ("wen", "pfi", "lu", "šq", "aux")]
    marks = [".", ",", ";", ":", "!", "?", ")", "...", "!?", '."', "***", "&&&"]
    texts = [f"{w}{m} ({w}{m}\n{w}/{w}{m} {w}" for w in words for m in marks]
    texts += ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \nb", "a\n b", "x\ty. z", "a1, b", "'s don't 's,", "a\u0301. e\u0301", "=\u0338 a=\u0338b", "×a÷b İ."]
    held = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    ids, at = ours.encode(held)
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [w.ids for w in want]
    # A word with and without a space before it, as little letters or not, and the marks.
    assert len(ours.young) < 3 * len(words)
    for none in ([], [""], ["", ""]):
        ids, at = ours.encode(pa.array(none, pa.string()))
        assert len(ids) == 0 and at.tolist() == [0] * (len(none) + 1)


def test_examples_are_indexed_in_little_memory():
    """The index is built on the driver: bytes a posting at the peak, which were 100 while rows were lists of arrays."""
    import tracemalloc

    import numpy as np

    from tramline.llm import toxicity

    rng = np.random.default_rng(1)
    vectors = [np.stack([np.sort(rng.choice(200_000, 2000, replace=False)), np.ones(2000, np.int64)], 1).astype(np.int32) for _ in range(200)]
    tracemalloc.start()
    try:
        index = toxicity.Examples(np.ones(200_000), vectors, [0] * 200, list(range(200)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.row) > 390_000 and peak < 75 * 400_000
