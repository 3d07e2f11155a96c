"""Embedding whitening by a one-sided Jacobi SVD.

1. Entries become whole numbers, floor(scale * c) + shift, whose sums are exact; one pass gives the
   number of vectors and the sums of each dimension.
2. Blockwise TSQR: a task centres its rows block by block and keeps the triangle R of the QR
   factors of what it has seen; triangles of FAN tasks at a time are stacked and reduced again until
   one is left. The covariance matrix, whose formation would square the condition number,
   is never made.
3. On the driver, plane rotations orthogonalise R's columns pair by pair (in rounds of disjoint
   pairs) until all are orthogonal to working precision. The accumulated rotations are the
   components, the columns' lengths over sqrt(n) the standard deviations, small ones too
   to high relative accuracy.
4. A pass over the rows projects them and measures the covariance of the result (centred block
   means, merged pairwise); a last one returns the rows.

What meets in one task or on the driver are FAN triangles of the dimension's size; rows never
move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored, table

TOP, SCALE, SHIFT = 32, 64, 1_000_000
#: Triangles or moments reduced at a time.
FAN = 16
#: Rows that a task stacks under its triangle, as multiples of the dimension.
STACK = 4
#: Scaled entries from here on don't fit exact sums; a row with one counts as not finite.
MOST = 2.0**40
SWEEPS = 60


@dataclass(frozen=True)
class Model:
    """n vectors of the fit list, per-dimension sums of their whole numbers without shift, all eigenvalues (falling) and the leading components as columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def live(self) -> np.ndarray:
        """Which of the components have a variance beyond rounding."""
        e = self.eigenvalues[: self.components.shape[1]]
        return e > (len(self.sums) * np.finfo(float).eps) ** 2 * e[:1]

    @property
    def axes(self) -> np.ndarray:
        """Components over their standard deviations; without variance not a number."""
        e = self.eigenvalues[: self.components.shape[1]]
        return self.components / np.sqrt(np.where(self.live, e, np.nan))


def whole(column: pa.Array, scale: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are usable, their lengths, where each begins, all scaled entries as whole numbers) of a column of lists; only rows of that length, if one is given."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    entries = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # null entries become NaN
    starts = np.cumsum(lengths) - lengths
    bad = ~(np.abs(entries) < MOST)
    before = np.concatenate([[0], np.cumsum(bad)])
    good = np.flatnonzero((lengths > 0 if length is None else lengths == length) & (before[starts + lengths] == before[starts]))
    return good, lengths[good], starts[good], np.where(bad, 0, entries).astype(np.int64)


def _rows(b: pa.RecordBatch, scale: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a batch (identifier, vector) and their matrix of whole numbers without shift."""
    good, _, starts, entries = whole(b.column(1), scale, length)
    return good, entries[starts[:, None] + np.arange(length)]


def _part() -> int:
    return TaskContext.get().partitionId()


def _lists(a: np.ndarray) -> pa.Array:
    """A matrix as a column with one list."""
    return pa.array([np.ascontiguousarray(a, np.float64).reshape(-1)], pa.list_(pa.float64()))


def _reduced(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One value from (part long, x array<double>): FAN values at a time, in the order of parts, until one is left."""
    kind = "part long, x array<double>"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        x = merge([np.asarray(v.values, np.float64) for v in group.column("x")])
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN], pa.int64()), "x": _lists(x)})

    while True:
        parts = stored(parts, "whitening-parts")
        most = parts.agg(F.max("part")).first()[0]
        if most is None:
            return None
        if most == 0:
            return np.array(parts.first().x)
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("at")).applyInArrow(run, kind)


def triangle(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """R of the QR factors of the stacked blocks; d x d, zeros where there are fewer rows."""
    r, waiting, rows = np.zeros((0, d)), [], 0
    for block in blocks:
        waiting.append(block)
        rows += len(block)
        if rows >= STACK * d:
            r, waiting, rows = np.linalg.qr(np.concatenate([r, *waiting]), mode="r"), [], 0
    r = np.linalg.qr(np.concatenate([r, *waiting]), mode="r")
    return np.concatenate([r, np.zeros((d - len(r), d))])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) by plane rotations of r's columns.

    A sweep meets every pair of columns once, in rounds of disjoint pairs; it ends when no
    pair's cosine is over rounding.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64, copy=True), np.eye(d)
    seats = np.arange(d + d % 2)
    limit = np.finfo(float).eps * math.sqrt(max(1, len(r)))
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            both = (p < d) & (q < d)
            p, q = np.minimum(p, q)[both], np.maximum(p, q)[both]
            pp, qq, pq = (np.einsum("ij,ij->j", a[:, x], a[:, y]) for x, y in ((p, p), (q, q), (p, q)))
            apart = np.abs(pq) > limit * np.sqrt(pp) * np.sqrt(qq)
            if apart.any():
                turned = True
                p, q = p[apart], q[apart]
                with np.errstate(over="ignore"):  # an infinite quotient means no turn
                    zeta = (qq - pp)[apart] / (2 * pq[apart])
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                for m in (a, v):
                    x, y = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    size = np.linalg.norm(a, axis=0)
    order = np.argsort(-size, kind="stable")
    v = v[:, order]
    return size[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def _merge_moments(k: int) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Merges (count, means, centred products) of blocks, each centred before multiplying."""

    def merge(values: list[np.ndarray]) -> np.ndarray:
        n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
        for v in values:
            off, total = v[1 : k + 1] - mean, n + v[0]
            m2 += v[k + 1 :].reshape(k, k) + np.outer(off, off) * (n * v[0] / total)
            mean, n = mean + off * (v[0] / total), total
        return np.concatenate([[n], mean, m2.reshape(-1)])

    return merge


def _centred(x: np.ndarray, model_n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly first."""
    return (x - np.array([s // model_n for s in sums], np.int64)) - np.array([s % model_n for s in sums], np.float64) / model_n


def fit(df: DataFrame, vector: str = "embedding", top: int = TOP, scale: int = SCALE) -> Model | None:
    """The model of all usable vectors; None where there is none."""
    spark = df.sparkSession
    small_batches(spark)
    input_ = df.select(F.lit(0).alias("id"), quoted(vector).cast("array<double>").alias("v"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, lengths, starts, entries = whole(b.column(1), scale)
            sizes = np.unique(lengths)
            sums = [entries[starts[lengths == d][:, None] + np.arange(d)].sum(axis=0) for d in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array([int((lengths == d).sum()) for d in sizes], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["d", "n", "sums"])

    counted = stored(input_.mapInArrow(count, "d long, n long, sums array<long>"), "whitening-sums")
    best = counted.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    d, n = best.d, best.n
    each = counted.filter(F.col("d") == d).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in sorted(each.collect())]

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((_centred(_rows(b, scale, d)[1], n, sums) for b in batches), d)
        yield pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), _lists(r)], names=["part", "x"])

    r = _reduced(input_.mapInArrow(factor, "part long, x array<double>"), lambda rs: triangle((x.reshape(d, d) for x in rs), d))
    size, components = jacobi(r.reshape(d, d))
    return Model(n, sums, size**2 / n, components[:, :top])


def identity_error(df: DataFrame, model: Model, vector: str = "embedding", scale: int = SCALE) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over the components with variance; None without one."""
    axes = model.axes[:, model.live]
    d, k = axes.shape
    if not k:
        return None
    n, sums, merge = model.n, model.sums, _merge_moments(k)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            w = _centred(_rows(b, scale, d)[1], n, sums) @ axes
            if len(w):
                mean = w.mean(axis=0)
                block = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).reshape(-1)])
                total = block if total is None else merge([total, block])
        yield pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), _lists(np.zeros(0) if total is None else total)], names=["part", "x"])

    input_ = df.select(F.lit(0).alias("id"), quoted(vector).cast("array<double>").alias("v"))
    out = _reduced(input_.mapInArrow(measure, "part long, x array<double>"), lambda xs: merge([x for x in xs if len(x)]) if any(map(len, xs)) else np.zeros(0))
    return float(np.abs(out[k + 1 :].reshape(k, k) / n - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", top: int = TOP, scale: int = SCALE) -> DataFrame:
    """One row for each usable row of df: id_col (long), deviation long, whitened array<double> of up to `top` components, n long, explained array<double>, identity_error double.

    A row is usable if its vector has no null, NaN, infinite or immense (2^40 / scale) entry and the length
    that most such rows have (of equally many the greater); others are left out, as are
    empty vectors. Entries are floor(scale * c); a shift of them changes no result. deviation is
    the sum of (n * x - S)^2, exact; null where it exceeds a long. Components without variance (fewer rows
    than dimensions, constant ones) have null whitened values; explained is null where no component
    has variance. Equal eigenvalues leave their components' order and directions free. Null and
    repeated identifiers stay as they are, repeated rows count each. An empty table gives an empty
    result. Other columns of df are ignored.
    """
    schema = "id long, deviation long, whitened array<double>"
    columns = F.col("id").alias(id_col), "deviation", "whitened"
    model = fit(df, vector, top, scale)
    if model is None:
        return df.sparkSession.createDataFrame([], f"{schema}, n long, explained array<double>, identity_error double").select(*columns, "n", "explained", "identity_error")
    error = identity_error(df, model, vector, scale)
    n, d, sums, axes = model.n, len(model.sums), model.sums, np.where(model.live, model.axes, 0.0)
    dead = np.flatnonzero(~model.live)
    whole_mean, left = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    left_square = sum(int(r) ** 2 for r in left)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = _rows(b, scale, d)
            x = x - whole_mean
            # n x - S = n y - r with y = x - floor(S / n), r = S mod n; products of whole numbers, as wide as needed.
            high = int(np.abs(x).max(initial=0))
            z, r = (x, left) if high * max(n, high) * d < 1 << 62 else (x.astype(object), left.astype(object))
            squares, mixed = (z * z).sum(axis=1), (z * r).sum(axis=1)
            deviation = [v if v < 1 << 63 else None for v in (n * n * int(s) - 2 * n * int(m) + left_square for s, m in zip(squares, mixed, strict=True))]
            w = (x - left / n) @ axes
            values = pa.array(w.reshape(-1), pa.float64(), mask=np.isin(np.arange(w.size) % max(1, w.shape[1]), dead))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * w.shape[1]), values)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])

    trace = float(model.eigenvalues.sum())
    explained = F.array(*(F.lit(float(e) / trace if trace else None).cast("double") for e in model.eigenvalues[:top]))
    out = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v")).mapInArrow(apply, schema)
    return out.select(*columns, F.lit(n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings")).select("*", F.posexplode("whitened").alias("at", "value"))
    component = (F.col("at") + 1).cast("int").alias("component")
    return out.select("vec_id", component, "n", "deviation", F.col("value").alias("whitened"), F.col("explained")[F.col("at")].alias("explained"), "identity_error")
