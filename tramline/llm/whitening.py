"""Whitening of embeddings by spectrum slicing.

Entries become integers x = floor(64 c) + 1,000,000. Each distinct vector is once in the fit list. Sums and the covariance are
partial sums of tasks, added in a shuffle by dimension; vectors are centred before they are multiplied. Only the covariance, whose size
is set by the dimension, is on the driver. There the number of eigenvalues above a shift is read off the signs of an LDL^T of
the shifted covariance; bisection by such counts isolates each leading eigenvalue, Rayleigh quotient iteration sharpens it, and
two more counts prove that it is the one with its number. Eigenvalues that no shift tells apart share a subspace, found by
inverse iteration on a block.

Defined cases: rows whose vector is null or has null or non-finite entries are left out, and so is a vector shorter than the
longest, whose missing entries count as null; repeated rows and rows without an id each get their own result; components
without variance (an eigenvalue of no more than rounding) can't be scaled and have no rows, so one distinct vector gives none; an
empty table gives no rows; further columns are ignored. An entry of 2^40 or more in size, and a deviation that a long can't hold, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
_EPS = float(np.finfo(float).eps)


# -- spectrum of a symmetric matrix --------------------------------------------------------------


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` exceed ``shift``: positive pivots of an LDL^T with one- and two-row pivots."""
    a = v - shift * np.eye(len(v))
    n, k, positive = len(a), 0, 0
    limit = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        own, two = abs(a[k, k]), False
        if k + 1 < n:
            r = k + 1 + int(np.argmax(np.abs(a[k + 1 :, k])))
            below = abs(a[r, k])
            if own < limit * below:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                most = row.max()
                if own * most < limit * below * below:
                    two = abs(a[r, r]) < limit * most
                    swap(k + 1 if two else k, r)
        if two:
            block, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            positive += 1 if det < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            k += 2
        else:
            d, c = a[k, k], a[k + 1 :, k]
            positive += int(d > 0)
            if d:
                a[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            k += 1
    return positive


def _solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    tiny = _EPS * max(1e-300, float(np.abs(v).max()))
    for nudge in (0, tiny, 3 * tiny, 100 * tiny):
        try:
            y = np.linalg.solve(v - (shift + nudge) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and np.any(y):
            return y
    return x


def _free(x: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """``x`` of unit length, without its parts along the ``known`` unit vectors."""
    for _ in range(2):
        for u in known:
            x = x - u * (u @ x)
    length = np.linalg.norm(x)
    return x / length if length else x


def _isolated(v: np.ndarray, lo: float, hi: float, start: np.ndarray, known: list[np.ndarray], tiny: float) -> tuple[float, np.ndarray] | None:
    """The eigenpair of the one eigenvalue between ``lo`` and ``hi``; None if the iteration leaves the interval."""
    mid, x = (lo + hi) / 2, start
    for _ in range(8):
        x = _free(_solve(v, mid, x), known)
        value = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - value * x))
        if lo < value - rest and value + rest < hi:
            break
    else:
        return None
    for _ in range(12):
        y = _free(_solve(v, value, x), known)
        new = float(y @ v @ y)
        less = float(np.linalg.norm(v @ y - new * y))
        if not lo < new < hi:
            return None
        done = less >= rest / 2
        if less <= rest:
            x, value, rest = y, new, less
        if done or rest <= tiny:
            break
    return (value, x) if rest <= 64 * tiny else None


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues of the covariance ``v``, falling, and their unit vectors as columns. Eigenvalues of rounding size are left out."""
    d = len(v)
    norm = float(np.abs(v).sum(1).max()) if d else 0.0
    if not norm:
        return np.zeros(0), np.zeros((d, 0))
    tiny = d * _EPS * norm
    values: list[float] = []
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    starts = rng.standard_normal((d, d))
    # (low, high, count above low, count above high); the interval with the largest eigenvalues is on top.
    todo = [(-4 * tiny, norm + 4 * tiny, d, 0)]
    while todo and len(values) < k:
        lo, hi, many, few = todo.pop()
        if hi <= 8 * tiny:
            break
        found = _isolated(v, lo, hi, starts[:, few], vectors, tiny) if many - few == 1 else None
        if found:
            values.append(found[0])
            vectors.append(found[1])
        elif hi - lo > 8 * tiny:
            mid = (lo + hi) / 2
            between = min(max(above(v, mid), few), many)
            todo += [x for x in ((lo, mid, many, between), (mid, hi, between, few)) if x[2] > x[3]]
        else:
            block = starts[:, few:many]
            for _ in range(6):
                block = _solve(v, (lo + hi) / 2, block)
                block = np.stack([_free(c, vectors) for c in block.T], 1)
                block = np.linalg.qr(block)[0]
            for c in block.T:
                c = _free(c, vectors)
                values.append(float(c @ v @ c))
                vectors.append(c)
    values, vectors = values[:k], vectors[:k]
    for number, (e, x) in enumerate(zip(values, vectors), 1):
        slack = max(8 * tiny, 4 * float(np.linalg.norm(v @ x - e * x)))
        if e > 8 * tiny and not above(v, e + slack) < number <= above(v, e - slack):
            raise ArithmeticError(f"eigenvalue {number} is not where its counts say")
    kept = [i for i, e in enumerate(values) if e > 8 * tiny]
    return np.array([values[i] for i in kept]), np.stack([vectors[i] for i in kept], 1) if kept else np.zeros((d, 0))


# -- tables --------------------------------------------------------------------------------------


def whole_numbers(df: DataFrame, scale: int = SCALE, offset: int = 0) -> DataFrame:
    """(vec_id, x): the rows with a whole vector, and floor(scale * entry) + offset of each entry as long."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = df.filter(~odd).select("vec_id", e.alias("_e"))
    longest = good.agg(F.max(F.size("_e"))).first()[0] or 0
    number = lambda c: F.when(F.abs(c * scale) < float(1 << 40), F.floor(c * scale)).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long")) + offset
    return good.filter((F.size("_e") == longest) & (F.size("_e") > 0)).select("vec_id", F.transform("_e", number).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: all of it has the size of the dimension."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part of the mean is taken off exactly."""
        return (x - self._floor()).astype(float) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact."""
        off, rest = x - self._floor(), [s % self.n for s in self.sums]
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((off * self.n - np.array(rest, np.int64)) ** 2).sum(1)
        out = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in off.tolist()]
        if max(out) >> 63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(out, np.int64)

    def _floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sums over all rows of ``part(x)``, a matrix of ``width`` columns: one matrix a task, added up by its rows in a shuffle."""
    schema = pa.schema([("i", pa.int32()), ("s", pa.list_(pa.float64()))])

    def give(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], schema.field("s").type)], schema=schema)

    def own(batches: Iterator[pa.RecordBatch]):
        total = None
        for b in batches:
            if b.num_rows:
                p = part(matrix(b.column(0)))
                total = p if total is None else total + p
        if total is not None:
            yield give(dict(enumerate(total)))

    def merged(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), matrix(b.column(1))):
                total[i] = total[i] + s if i in total else s
        if total:
            yield give(total)

    kind = "i int, s array<double>"
    found = rows.select("x").mapInArrow(own, kind).repartition(min(width, partitions(rows.sparkSession)), "i").mapInArrow(merged, kind).collect()
    return np.array([r["s"] for r in sorted(found, key=lambda r: r["i"])])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (vec_id, x); None without rows."""
    fit_list = materialise(rows.select("x").distinct(), "fit-list")
    n = fit_list.count()
    if not n:
        return None
    # One row a dimension.
    by_dim = fit_list.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    sums = tuple(int(r["s"]) for r in sorted(by_dim, key=lambda r: r["pos"]))
    d = len(sums)
    bare = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)))

    def product(x: np.ndarray) -> np.ndarray:
        y = bare.centred(x)
        return y.T @ y

    v = _summed(fit_list, product, d) / n
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    trace = float(np.trace(v))
    found = Whitening(n, sums, trace, values, vectors)
    k = len(values)
    if not k:
        return found

    def moments(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return np.vstack([w.sum(0), w.T @ w])

    m = _summed(fit_list, moments, k + 1) / n
    error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())
    return Whitening(n, sums, trace, values, vectors, error)


OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_SQL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of (vec_id, x) and component of the model."""
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], _OUT_SQL)

    def run(batches: Iterator[pa.RecordBatch]):
        k = len(model.values)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                m = len(x)
                again = pa.array(np.repeat(np.arange(m), k))
                const = lambda v, t: pa.array(np.full(m * k, v), t)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), const(model.n, pa.int64()), pa.array(np.repeat(model.deviations(x), k)),
                    pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(model.values / model.trace, m)), const(model.identity_error, pa.float64()),
                ], schema=OUT)

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, _OUT_SQL)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"), SCALE, OFFSET)
    return whiten(rows, fit(rows))
