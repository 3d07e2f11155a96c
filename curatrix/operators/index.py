"""Inverted lists under coarse centroids: an approximate kNN join with measured recall, and exact pairs within a distance.

Centroids are fitted on a bounded sample (at most PER_CELL rows for each of at most MOST_CELLS
cells, drawn by a hash); every row is listed under its nearest one. Nothing else of the data
reaches the driver. A search sends each query to the lists of its `probes` nearest centroids,
where it meets all vectors in full; `tune` reads from the exact neighbours of a bounded sample
of queries how many probes reach a recall. Lists of over BLOCK rows are cut into blocks (see `neighbors.cells`), so
a list may hold any share of the rows.

Pairs within a distance r need no probing: a row whose home is p meets list q only if
d(x, q) - d(x, p) <= 2 r (it may have a partner nearer to q than to p) and
d(x, q) <= r + the radius of q (it may have one inside q's ball). Both follow from the triangle inequality, so no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import neighbors as N
from curatrix.sources.storage import stored

#: Cells at most, and rows of the fitting sample for each cell.
MOST_CELLS, PER_CELL = 4096, 32
STEPS = 10
#: Queries of the sample that tunes the probes.
TUNING = 256
#: Visits that a task holds at a time.
VISITS = 65_536
#: Of pairs within a distance: with visits to more than this share of the cells, blocks of all pairs are cheaper.
DENSE = 0.5


@dataclass(frozen=True)
class Index:
    """centroids: one row a cell. lists: (id, g, v, value): every vector with its cell. rows: how many."""

    centroids: np.ndarray
    lists: DataFrame
    rows: int
    metric: str


def _units(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as they are compared: of unit length for the cosine; a zero vector stays zero."""
    if metric != "cosine":
        return v
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T, 0))


def lloyd(x: np.ndarray, k: int, seed: int = 42, steps: int = STEPS) -> np.ndarray:
    """k centroids of the rows of x; cells that run empty take the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(steps):
        d = _distances(x, c)
        at = d.argmin(axis=1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        far = np.argsort(-d[np.arange(len(x)), at], kind="stable")
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        c[n == 0] = x[far[: int((n == 0).sum())]]
    return c


def fit(df: DataFrame, rows: int, metric: str = "cosine", cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", seed: int = 42) -> np.ndarray:
    """Centroids of about sqrt(rows) cells, from at most PER_CELL rows for each, drawn by a seeded hash of identifier and vector."""
    k = max(1, min(cells or math.isqrt(rows), MOST_CELLS, rows))
    most = PER_CELL * k
    d = N.vectors(df, id_col, vector)
    if rows > most:
        d = d.filter(F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(1 << 30)) < int(0.95 * most / rows * (1 << 30)))
    x = _units(N.matrix(d.select("v").limit(most).toArrow().column("v")), metric)
    return lloyd(x, min(k, len(x)), seed)


def assigned(df: DataFrame, centroids: np.ndarray, metric: str, probes: int = 1, value: str | None = None) -> DataFrame:
    """(id, g, v, value) of rows (id, v, value) once for each of their `probes` nearest cells; g is the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = min(probes, len(centroids))
        each = max(1, 16 * VISITS // max(1, len(centroids)))
        for b in (whole.slice(i, each) for whole in batches for i in range(0, max(1, whole.num_rows), each)):
            d = _distances(_units(N.matrix(b.column("v")), metric), centroids) if b.num_rows else np.zeros((0, len(centroids)))
            near = np.argpartition(d, p - 1, axis=1)[:, :p] if p < len(centroids) else np.tile(np.arange(p), (len(d), 1))
            row = pa.array(np.repeat(np.arange(b.num_rows), p))
            yield pa.RecordBatch.from_arrays([b.column("id").take(row), pa.array(near.reshape(-1).astype(str), pa.string()), *(b.column(c).take(row) for c in b.schema.names if c not in ("id", "g"))], names=["id", "g", *(c for c in b.schema.names if c not in ("id", "g"))])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, ", ".join(["id long", "g string", *(f"{c} {kinds[c]}" for c in df.columns if c not in ("id", "g"))]))


def build(df: DataFrame, metric: str = "cosine", cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", value: str | None = None, seed: int = 42) -> Index:
    """The index of all of df's rows that have a vector. value: a column that comes along, such as a label."""
    rows = df.filter(F.col(vector).isNotNull()).count()
    centroids = fit(df, rows, metric, cells, id_col, vector, seed) if rows else np.zeros((0, 0))
    lists = N.vectors(df, id_col, vector, None, value)
    return Index(centroids, stored(assigned(lists, centroids, metric), "index") if rows else lists, rows, metric)


def search(index: Index, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector: str = "embedding", value: str | None = None, same: bool | None = None, exclude_self: bool = True) -> DataFrame:
    """(q, c, score, rank, q_value, c_value) as neighbors.nearest(), of the rows in each query's `probes` nearest lists. same: only rows with (True) or without (False) the query's value."""
    left = N.vectors(queries, id_col, vector, None, value)
    if not index.rows:
        return N.ranked(left.limit(0).select(F.col("id").alias("q"), F.col("id").alias("c"), F.lit(0.0).alias("score"), *([F.col("value").alias("q_value"), F.col("value").alias("c_value")] if value else [])), k, index.metric)
    left, metric = assigned(left, index.centroids, index.metric, probes), index.metric

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        for at, to in N.shared_groups(x, y):
            a, b = x.take(at), y.take(to)
            qs, cs, points = a.column("id").to_numpy(), b.column("id").to_numpy(), N.matrix(b.column("v"))
            labels = (a.column("value").combine_chunks(), b.column("value").combine_chunks()) if same is not None else None
            codes = [c.to_numpy(zero_copy_only=False) for c in labels] if labels else None
            v = N.matrix(a.column("v"))
            for i in range(0, len(qs), N.TILE):
                s = N.scores(v[i : i + N.TILE], points, metric)
                if exclude_self:
                    s[qs[i : i + N.TILE, None] == cs[None, :]] = -np.inf
                if codes:
                    s[(codes[0][i : i + N.TILE, None] == codes[1][None, :]) != same] = -np.inf
                row, col = N.best(s, cs, k)
                got = {"q": qs[row + i], "c": cs[col], "score": s[row, col]}
                if value:
                    got |= {"q_value": a.column("value").take(pa.array(row + i)), "c_value": b.column("value").take(pa.array(col))}
                out.append(pa.table(got))
        return pa.concat_tables(out) if out else schema.empty_table()

    kinds = {"q": "long", "c": "long", "score": "double"}
    if value:
        kinds |= {"q_value": left.schema["value"].dataType.simpleString(), "c_value": index.lists.schema["value"].dataType.simpleString()}
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = ", ".join(f"{c} {t}" for c, t in kinds.items())
    schema = to_arrow_schema(index.lists.sparkSession.createDataFrame([], ddl).schema)
    return N.ranked(N.cells(left, index.lists, work, ddl, True), k, metric)


def tune(index: Index, df: DataFrame, k: int, target: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", seed: int = 1) -> int:
    """The least number of probes with which lists hold the target share of the exact k nearest rows, of TUNING queries at most, drawn by a hash from df."""
    share = min(1.0, TUNING / max(1, index.rows))
    some = stored(df.filter(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))).limit(TUNING), "index-tuning")
    exact = N.nearest(some, df, k, index.metric, id_col, id_col, vector).select("q", "c")
    home = exact.join(index.lists.select(F.col("id").alias("c"), F.col("g").cast("int").alias("cell")), "c").select("q", "cell").toArrow()  # at most TUNING k rows
    queries = N.vectors(some, id_col, vector).select("id", "v").toArrow()
    if not home.num_rows:
        return len(index.centroids)
    d = _distances(_units(N.matrix(queries.column("v")), index.metric), index.centroids)
    place = {int(q): r for q, r in zip(queries.column("id").to_numpy(), d.argsort(axis=1, kind="stable").argsort(axis=1), strict=True)}
    ranks = np.sort([place[int(q)][cell] for q, cell in zip(home.column("q").to_numpy(), home.column("cell").to_numpy(), strict=True)])
    return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, recall: the share of the exact (q, c) that were found."""
    hit = exact.select("q", "c").join(found.select("q", "c", F.lit(1).alias("hit")), ["q", "c"], "left")
    return hit.agg(F.countDistinct("q").alias("queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def reach(threshold: float, metric: str) -> float:
    """The distance within which pairs reach a similarity; of unit vectors for the cosine."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) if metric == "cosine" else max(0.0, 1 - threshold)


@dataclass(frozen=True)
class Visits:
    """What similar pairs will meet: rows of (id, g, v, value) where value tells whether g is the row's home; the homes; how many rows, cells and visits there are; share of all possible visits."""

    visitors: DataFrame
    homes: DataFrame
    rows: int
    cells: int
    visits: int

    @property
    def share(self) -> float:
        """Visits over those that all pairs of cells, each met once, would take."""
        return self.visits / max(1.0, self.rows * (self.cells + 1) / 2)


def visits(df: DataFrame, threshold: float, metric: str = "cosine", cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", seed: int = 42) -> Visits:
    """Each row at home and, of the later cells, in those that a partner over the threshold may have as home."""
    r = reach(threshold, metric) + 1e-6
    index = build(df, metric, cells, id_col, vector, None, seed)
    centroids = index.centroids

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(centroids))
        for b in batches:
            if b.num_rows:
                at = b.column("g").cast(pa.int32()).to_numpy()
                d = np.linalg.norm(_units(N.matrix(b.column("v")), metric) - centroids[at], axis=1)
                np.maximum.at(most, at, d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most)), pa.int32()), pa.array(most)], names=["cell", "r"])

    radii = np.zeros(len(centroids))
    for x in index.lists.mapInArrow(radius, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect() if index.rows else []:  # one row a cell
        radii[x.cell] = x.r

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their homes, row, cell) of the visits of few rows at a time, at most about VISITS."""
        each, at = max(1, VISITS // max(1, len(centroids))), np.arange(len(centroids))[None, :]
        for whole in batches:
            for i in range(0, whole.num_rows, each):
                b = whole.slice(i, each)
                home = b.column("g").cast(pa.int32()).to_numpy()
                d = _distances(_units(N.matrix(b.column("v")), metric), centroids)
                own = d[np.arange(len(home)), home][:, None]
                yield b, home, *np.nonzero(((d - own <= 2 * r) & (d <= r + radii[None, :]) & (at > home[:, None])) | (at == home[:, None]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, home, row, cell in reached(batches):
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(cell.astype(str), pa.string()), b.column("v").take(at), pa.array(home[row] == cell)], names=["id", "g", "v", "value"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(row) for _, _, row, _ in reached(batches))], pa.int64())], names=["n"])

    homes = index.lists.select("id", "g", "v")
    visitors = homes.mapInArrow(send, f"id long, g string, v {homes.schema['v'].dataType.simpleString()}, value boolean")
    count = homes.mapInArrow(tell, "n long") if index.rows else None
    total = (count.agg(F.sum("n")).first()[0] or 0) if count is not None else 0
    return Visits(visitors, homes, index.rows, len(centroids), total)


def similar_pairs(df: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", strict: bool = True, cells: int | None = None, dense: float = DENSE) -> DataFrame:
    """neighbors.similar_pairs(), with rows sent only to cells they can reach.

    Where they reach more than the share `dense` of all cells, as vectors without clusters at a low threshold do, blocks of
    all pairs give the same rows with fewer copies; so they do where all rows are one block. With dense 1, cells are always used.
    """
    if dense < 1 and df.filter(F.col(vector).isNotNull()).limit(N.BLOCK + 1).count() <= N.BLOCK:
        return N.similar_pairs(df, threshold, metric, id_col, vector, strict)
    plan = visits(df, threshold, metric, cells, id_col, vector)
    if dense < 1 and plan.share > dense or not plan.rows:
        return N.similar_pairs(df, threshold, metric, id_col, vector, strict)

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        for at, to in N.shared_groups(x, y):
            a, b = x.take(at), y.take(to)
            left, right, home = a.column("id").to_numpy(), b.column("id").to_numpy(), a.column("value").to_numpy()
            v, points = N.matrix(a.column("v")), N.matrix(b.column("v"))
            for i in range(0, len(left), N.TILE):
                s = N.scores(v[i : i + N.TILE], points, metric)
                s = s if metric == "cosine" else 1 + s
                ids = left[i : i + N.TILE, None]
                hit = (s > threshold if strict else s >= threshold) & np.where(home[i : i + N.TILE, None], ids < right[None, :], ids != right[None, :])
                r, c = np.nonzero(hit)
                p, q = left[i + r], right[c]
                out.append(pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q), "score": s[r, c]}))
        return pa.concat_tables(out) if out else pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})

    return N.cells(plan.visitors, plan.homes, work, "a long, b long, score double", True)
