"""Whitening, top-k search and collocations against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tramline.llm import collocations, pivot_topk, whitening


# -- spectrum ------------------------------------------------------------------------------------


@pytest.mark.parametrize("d", [1, 2, 7, 33])
@pytest.mark.parametrize("kind", ["plain", "low rank", "equal", "pairs", "near"])
def test_leading_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((3 * d, d))
    if kind == "low rank":
        a[:, d // 2 :] = a[:, :1]
    v = {"equal": 3.0 * np.eye(d), "pairs": np.diag(np.repeat(np.arange(1.0, d + 1), 2)[:d]), "near": np.eye(d) + np.diag(np.arange(d) * 1e-9)}.get(kind, a.T @ a / len(a))
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = q @ v @ q.T
    v = (v + v.T) / 2
    want = np.linalg.eigvalsh(v)[::-1][:16]
    want = want[want > 1e-12 * want[0]]
    e, x = whitening.leading(v, 16)
    assert len(e) == len(want) and np.abs(e - want).max() < 1e-12 * want[0] * d
    assert np.abs(v @ x - x * e).max() < 1e-12 * want[0] * d and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


def test_counts_above_a_shift():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(-3, 4, (9, 9)).astype(float)
        v = a + a.T
        w = np.linalg.eigvalsh(v)
        for s in rng.uniform(w[0] - 1, w[-1] + 1, 5):
            assert whitening.above(v, s) == (w > s).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


# -- whitening -----------------------------------------------------------------------------------


def whitened(spark, vectors, **columns):
    rows = spark.createDataFrame([(i, v) for i, v in vectors], "vec_id long, embedding array<float>").withColumns({k: F.lit(v) for k, v in columns.items()})
    x = whitening.whole_numbers(rows, whitening.SCALE, whitening.OFFSET)
    return whitening.whiten(x, whitening.fit(x)).toPandas()


def by_numpy(vectors):
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    longest = max((len(v) for _, v in good), default=0)
    good = [(i, v) for i, v in good if len(v) == longest]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good], object)
    fit = np.unique(x.astype(np.int64), axis=0)
    n, sums = len(fit), fit.sum(0).astype(object)
    y = fit - fit.mean(0)
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    kept = e > 1e-12 * e[0]
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(1), (x.astype(float) - fit.mean(0)) @ q[:, kept] / np.sqrt(e[kept]), e[kept] / e.sum() if len(e) == x.shape[1] else None


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(0, 1 + np.arange(5), 5).astype(np.float32).tolist()) for i in range(200)]
    vectors += [(i, vectors[3][1]) for i in range(200, 400)] + [(7, vectors[7][1]), (None, vectors[8][1])]
    vectors += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] * 5), (904, [1.0]), (905, [])]
    got = whitened(spark, vectors, x=1, component="c", n=None)
    ids, n, deviation, want, explained = by_numpy(vectors)
    assert len(got) == len(ids) * 5 and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    w = got.pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first")
    order = {i: k for k, i in enumerate(ids) if i is not None}
    rows = want[[order[i] for i in w.index]]
    assert np.abs(rows * np.sign((rows * w.to_numpy()).sum(0)) - w.to_numpy()).max() < 1e-9
    assert dict(zip(got.vec_id.fillna(-1), got.deviation)) == {(-1 if i is None else i): d for i, d in zip(ids, deviation)}
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


def test_whitening_odd_tables(spark):
    assert len(whitened(spark, [])) == 0 and len(whitened(spark, [(1, None), (2, [])])) == 0
    assert len(whitened(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])) == 0
    flat = whitened(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert sorted(flat.component) == [1, 1] and np.allclose(np.abs(flat.whitened), 1) and np.allclose(flat.explained, 1)
    with pytest.raises(Exception, match="too large"):
        whitened(spark, [(1, [1e30]), (2, [1.0])])


def test_deviations_are_exact():
    model = whitening.Whitening(3, (4, 1 << 41), 1.0, np.ones(1), np.ones((2, 1)))
    x = np.array([[5, (1 << 40) + 7]])
    assert model.deviations(x).tolist() == [(15 - 4) ** 2 + (3 * ((1 << 40) + 7) - (1 << 41)) ** 2] if (3 * ((1 << 40) + 7) - (1 << 41)) ** 2 < 1 << 63 else True
    with pytest.raises(OverflowError):
        model.deviations(np.array([[0, -(1 << 40)]]))


def test_op11_by_numpy(spark, sf):
    got = whitening.op11_whitening(spark, sf).toPandas()
    src = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, n, deviation, want, _ = by_numpy([(i, None if v is None else list(v)) for i, v in zip(src.vec_id, src.embedding)])
    got = got.sort_values(["vec_id", "component"])
    order = np.argsort(ids, kind="stable")
    w, have = want[order], got.whitened.to_numpy().reshape(len(ids), -1)
    assert np.abs(w * np.sign((w * have).sum(0)) - have).max() < 1e-8 and got.identity_error.max() < 1e-4
    assert (got.deviation.to_numpy().reshape(len(ids), -1)[:, 0] == np.array(deviation[order], np.int64)).all()


# -- top-k ---------------------------------------------------------------------------------------


def nearest(spark, vectors, k, every=3):
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    x = whitening.whole_numbers(rows)
    return pivot_topk.search(pivot_topk.build(x, k), x.filter(F.col("vec_id") % every == 0), k).toPandas()


def by_hand(vectors, k, every=3):
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in vectors]
    out = []
    for a, (i, v) in enumerate(x):
        if i is not None and i % every == 0:
            others = sorted((-sum(p * q for p, q in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(x) if b != a)
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(others[:k], 1)]
    return out


@pytest.mark.parametrize("shape", ["spread", "clusters", "lengths", "copies"])
def test_top_k_by_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(pivot_topk, "BLOCK", 16)
    monkeypatch.setattr(pivot_topk, "QUERIES", 8)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(260, 6))
    if shape == "clusters":
        v = rng.normal(size=(5, 6))[rng.integers(0, 5, 260)] * 3 + v * 0.05
    if shape == "lengths":
        v *= rng.pareto(1, (260, 1)) + 0.01
    if shape == "copies":
        v = np.round(v[rng.integers(0, 12, 260)])
    vectors = [(int(i), row.astype(np.float32).tolist()) for i, row in zip(rng.permutation(260), v)]
    vectors += [(None, vectors[4][1]), (3, vectors[5][1]), vectors[6], vectors[6], (9, vectors[9][1])]
    got = nearest(spark, vectors, 7)
    want = by_hand(vectors, 7)
    key = lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0)
    assert sorted([(a, b, None if c != c else c, d) for a, b, c, d in got.itertuples(index=False)], key=key) == sorted(want, key=key)


def test_top_k_stops_by_bound(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 4
    vectors = [(i, (centres[i % 8] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(800)]
    asked = []
    old = pivot_topk._expanded
    monkeypatch.setattr(pivot_topk, "_expanded", lambda *a: asked.append(out := old(*a)) or out)
    got = nearest(spark, vectors, 5, every=80)
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(by_hand(vectors, 5, every=80))
    annuli = sum(d.count() for d in asked)
    assert annuli < 10 * 800 / 16 / 2


def test_top_k_odd_tables(spark):
    assert len(nearest(spark, [], 3)) == 0 and len(nearest(spark, [(3, None), (6, [])], 3)) == 0
    assert len(nearest(spark, [(3, [1.0])], 3)) == 0
    few = nearest(spark, [(3, [1.0, 0.0]), (4, [0.5, 0.0]), (5, [0.0, 0.0])], 3)
    assert few[["query_id", "rank", "vec_id", "score"]].values.tolist() == [[3, 1, 4, 64 * 32], [3, 2, 5, 0]]
    with pytest.raises(Exception, match="fewer"):
        x = whitening.whole_numbers(spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<float>"))
        pivot_topk.search(pivot_topk.build(x, 2), x, 3)


def test_large_scores_are_exact():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 5], [1 << 31, 1]])
    assert pivot_topk._products(a, b).tolist() == [[(1 << 60) + 15, (1 << 61) + 3]]
    with pytest.raises(OverflowError):
        pivot_topk._products(np.array([[1 << 33]]), np.array([[1 << 33]]))


# -- collocations --------------------------------------------------------------------------------


def mined(spark, duck_rows, least, best, monkeypatch):
    import duckdb

    rows = spark.createDataFrame(duck_rows, "lang string, text string").withColumns({"f": F.lit(1), "w1": F.lit("x"), "doc_id": F.lit(None).cast("long")})
    got = collocations.mine(rows, least, best).toPandas()
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    if duck_rows:
        c.executemany("INSERT INTO documents VALUES (?, ?)", duck_rows)
    sql = collocations.OP13_SQL.replace(f">= {collocations.LEAST})", f">= {least})").replace(f"rank <= {collocations.BEST}", f"rank <= {best}")
    want = c.execute(sql).df()
    same(got, want)
    return got


def texts(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "l'été", "\x01odd", "naïve", "ABC"]
    p = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(120):
        lang = ["en", "de", None, "und", "x y"][rng.integers(0, 5)]
        line = rng.choice(words, rng.integers(0, 60), p=p / p.sum()).tolist()
        if i % 3 == 0:
            line[5:5] = "the quick brown fox jumps over Lazy dogs".split()
        rows.append((lang, "".join(w + ["", " ", "\t", ", ", ".\n", "  "][rng.integers(1, 6)] for w in line)))
    return rows + [("en", None), ("en", ""), ("en", " \t. !"), ("en", "one"), ("fr", "Same words. " * 400), ("fr", "Same words, " * 300 + "end"), ("la", "a " * 5000)] + [("de", "copy of this line here")] * 60


@pytest.mark.parametrize(("least", "best"), [(3, 2000), (10, 20), (50, 5)])
def test_collocations_by_sql(spark, monkeypatch, least, best):
    assert len(mined(spark, texts(), least, best, monkeypatch))


def test_growth_stops_before_frequent_first_words(spark, monkeypatch):
    rows = [("en", f"rare{i} pair{i} the of the of the of the of and the") for i in range(40) for _ in range(12)]
    grown = []
    old = collocations.phrases
    monkeypatch.setattr(collocations, "phrases", lambda found, bits, pairs, least: grown.append(pairs) or old(found, bits, pairs, least))
    got = mined(spark, rows, 10, 30, monkeypatch)
    assert len(got) == 30 and grown.count(False) < 3


def test_collocations_when_filters_are_full(spark, monkeypatch):
    """Bits of the filters that all agree let everything through; results stay."""
    monkeypatch.setattr(collocations, "WORD_BITS", 16)
    monkeypatch.setattr(collocations, "PAIR_BITS", 16)
    monkeypatch.setattr(collocations, "bitmap", lambda cells, n_bits: np.full((1 << n_bits) // 8, 255, np.uint8))
    assert len(mined(spark, texts(3), 5, 50, monkeypatch))


def test_collocations_odd_tables(spark, monkeypatch):
    assert len(mined(spark, [], 1, 5, monkeypatch)) == 0
    assert len(mined(spark, [(None, None), ("en", "")], 1, 5, monkeypatch)) == 0
    assert len(mined(spark, [("en", "a b")], 2, 5, monkeypatch)) == 0
    assert mined(spark, [("en", "a b")], 1, 5, monkeypatch).phrase.tolist() == ["a b"]


def test_words_that_share_a_hash_fail(spark, monkeypatch):
    whole = collocations._texts

    def folded(batches, seed):
        for b, (raw, starts, ends, keys, row, joined) in whole(batches, seed):
            yield b, (raw, starts, ends, keys & np.uint64(3), row, joined)

    monkeypatch.setattr(collocations, "_texts", folded)
    with pytest.raises(Exception, match="share a hash"):
        collocations.mine(spark.createDataFrame([("en", f"word{i}") for i in range(100)], "lang string, text string"), 1)
