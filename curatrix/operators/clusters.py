"""Outliers, density, clustering and interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.ladders import clip, whole
from curatrix.functions.vectors import interpolate
from curatrix.operators.index import PER_CELL, build, lloyd
from curatrix.operators.neighbors import matrix, mean_distance, nearest, vectors
from curatrix.operators.ranks import numbered, quantiles
from curatrix.sources.storage import stored

#: Rows of a coreset: bounds what an elbow's fits hold on the driver.
CORESET = 20_000
#: Rows of a cell that one task clusters, and centroids under which a larger one is dealt again.
CELL, FAN, LEVELS = 4096, 256, 4


def by_density(df: DataFrame, k: int = 5, quantile: float = 0.85, keep: str = "dense", group: str | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df's rows whose mean distance to their k nearest is up to the quantile ("dense") or from it on ("sparse"), by group; a group of at most k rows stays whole."""
    g = group or "__g"
    d = df if group else df.withColumn(g, F.lit(0))
    d = stored(d.join(mean_distance(d, k, "euclidean", id_col, vector, g), id_col, "left"), "density")
    n = d.groupBy(F.col(g).alias("__g1")).agg(F.count(F.lit(1)).alias("__n"))
    q = n.join(quantiles(d, [g], "mean_distance", {"__q": quantile}).select(F.col(g).alias("__g2"), "__q"), F.col("__g1").eqNullSafe(F.col("__g2")), "left")
    test = F.round("mean_distance", 9) <= F.round("__q", 9) if keep == "dense" else F.round("mean_distance", 9) >= F.round("__q", 9)
    return d.join(q, F.col(g).eqNullSafe(F.col("__g1"))).filter((F.col("__n") <= k) | test).select(*df.columns, "mean_distance")


def kmeans(df: DataFrame, k: int, seed: int = 42, vector: str = "embedding", steps: int = 20) -> tuple[DataFrame, list[list[float]], float]:
    """(df with cluster, centroids, inertia); one cluster where k is 1 or the rows are no more than k."""
    n = df.count()
    k = 1 if k <= 1 or n <= k else k
    x = df.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=max(k, 2), seed=seed, featuresCol="__x", predictionCol="cluster", maxIter=steps).fit(x) if k > 1 else None
    if model is None:
        from curatrix.functions.vectors import euclidean, mean_vector

        c = mean_vector(df.withColumn("__g", F.lit(0)), ["__g"], vector).first()
        centroid = list(c.centroid) if c else []
        inertia = df.agg(F.sum(F.pow(euclidean(F.col(vector), F.array(*map(F.lit, centroid))), 2))).first()[0] if centroid else 0.0
        return df.withColumn("cluster", F.lit(0)), [centroid], inertia
    return model.transform(x).drop("__x"), [list(map(float, c)) for c in model.clusterCenters()], model.summary.trainingCost


def assign(df: DataFrame, centroids: DataFrame, vector: str = "embedding", centroid_id: str = "cluster", centroid: str = "centroid") -> DataFrame:
    """df with cluster and distance of the nearest of some centroids (few, so broadcast)."""
    from curatrix.functions.vectors import euclidean

    every = centroids.agg(F.collect_list(F.struct(F.col(centroid_id).alias("k"), F.col(centroid).alias("c"))).alias("__cs"))
    near = F.array_min(F.transform("__cs", lambda s: F.struct(F.round(euclidean(F.col(vector), s["c"]), 9).alias("r"), s["k"].alias("k"), euclidean(F.col(vector), s["c"]).alias("d"))))
    return df.join(F.broadcast(every)).withColumn("__near", near).withColumns({"cluster": F.col("__near.k"), "distance": F.col("__near.d")}).drop("__near", "__cs")


def coreset(df: DataFrame, size: int = CORESET, seed: int = 42, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights): about `size` rows at most that stand for all, for k-means with any k.

    Half of a row's chance is even, half goes by its share of the squared distances to the mean, so
    far rows aren't missed; its weight is one over its chance. Rows are drawn by a seeded hash.
    All rows, with weight 1, where there are no more than `size`.
    """
    d = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = d.mapInArrow(lambda batches: _sums(batches, None), "n long, s array<double>, q double")
    n, mean, _ = _totals(parts)
    if not n:
        return np.zeros((0, 0)), np.zeros(0)
    if n <= size:
        return matrix(d.toArrow().column("v")), np.ones(n)
    _, _, spread = _totals(d.mapInArrow(lambda batches: _sums(batches, mean), "n long, s array<double>, q double"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v")) if b.num_rows else np.zeros((0, len(mean)))
            chance = np.minimum(1.0, size * (0.5 / n + 0.5 * ((v - mean) ** 2).sum(axis=1) / spread if spread else 1 / n))
            take = (b.column("h").to_numpy() + 0.5) / (1 << 30) < chance
            yield pa.RecordBatch.from_arrays([b.column("v").filter(pa.array(take)), pa.array(1 / chance[take])], names=["v", "w"])

    # Equal vectors are told apart by their place in the table, so that they aren't drawn together.
    drawn = d.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "v", F.monotonically_increasing_id()), F.lit(1 << 30))).mapInArrow(draw, "v array<double>, w double").toArrow()
    return matrix(drawn.column("v")), drawn.column("w").to_numpy()


def _sums(batches: Iterator[pa.RecordBatch], mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row a task: rows, sum of the vectors, sum of squared distances to the mean."""
    n, s, q = 0, None, 0.0
    for b in batches:
        if b.num_rows:
            v = matrix(b.column("v"))
            n, s = n + len(v), v.sum(axis=0) + (0 if s is None else s)
            q += 0.0 if mean is None else float(((v - mean) ** 2).sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s if s is not None else []], pa.list_(pa.float64())), pa.array([q])], names=["n", "s", "q"])


def _totals(parts: DataFrame) -> tuple[int, np.ndarray, float]:
    parts = stored(parts, "coreset-sums")
    one = parts.agg(F.sum("n").alias("n"), F.sum("q").alias("q")).first()
    s = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # one row a dimension
    return one.n or 0, np.array([r.x for r in s]) / max(1, one.n or 0), one.q or 0.0


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int = 42, steps: int = 20, tries: int = 3) -> tuple[np.ndarray, float]:
    """(centroids, inertia) of weighted rows: the best of some runs from centroids drawn far apart."""
    best: tuple[np.ndarray, float] | None = None
    for t in range(tries):
        rng = np.random.default_rng([seed, t])
        c = x[[rng.choice(len(x), p=w / w.sum())]]
        d = ((x - c[0]) ** 2).sum(axis=1)
        while len(c) < k:
            p = w * d
            c = np.vstack([c, x[rng.choice(len(x), p=p / p.sum() if p.sum() > 0 else None)]])
            d = np.minimum(d, ((x - c[-1]) ** 2).sum(axis=1))
        for _ in range(steps):
            at = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            of = np.zeros((len(x), k))
            of[np.arange(len(x)), at] = w
            n = of.sum(axis=0)
            new = np.where(n[:, None] > 0, of.T @ x / np.where(n > 0, n, 1)[:, None], c)
            if np.array_equal(new, c):
                break
            c = new
        inertia = float((w * np.maximum(((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T).min(axis=1), 0)).sum())
        if best is None or inertia < best[1]:
            best = c, inertia
    return best


def elbow(inertia: list[float], low: int, high: int) -> int:
    """Where the second difference of the inertias of low to high clusters is largest."""
    if len(inertia) < 3:
        return low
    best = low + int(np.argmax(np.diff(inertia, 2))) + 1
    return min(3, high) if best < 3 else high if best > high - 2 else best


def choose_k(df: DataFrame, low: int = 2, high: int = 15, seed: int = 42, vector: str = "embedding", size: int = CORESET) -> int:
    """The elbow of the inertia over k, 1 under `low` rows. One coreset serves all k: the rows are read for its draw only, and fits run on the draw."""
    x, w = coreset(df, size, seed, vector)
    n = round(w.sum())
    if n < low:
        return 1
    high = min(high, n)
    if high <= low:
        return low
    return elbow([weighted_kmeans(x, w, k, seed)[1] for k in range(low, high + 1)], low, high)


def final_k(elbow: Column, n: Column, least: int = 6, most: int = 12, size: int = 60) -> Column:
    """Clusters of a class: the elbow, but no fewer than its size asks for."""
    return F.greatest(F.least(F.lit(most), F.greatest(F.lit(least), whole(n / size))), elbow)


def smote_pairs(df: DataFrame, anchors: DataFrame, n: int, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", group: str | None = None, seed: int = 42) -> DataFrame:
    """(i, anchor, neighbour, by, synthetic): n interpolations, anchors in turn, a neighbour and a share each drawn by a hash of (seed, i)."""
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(what), F.lit(str(seed)), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    ranked = numbered(anchors.select(F.col(id_col).alias("anchor")), [], ["anchor"], "a", "m").select("anchor", (F.col("a") - 1).alias("a"))
    count = ranked.agg(F.count(F.lit(1)).alias("m"))
    turns = df.sparkSession.range(n).select(F.col("id").alias("i")).join(F.broadcast(count)).withColumn("a", F.col("i") % F.col("m")).join(ranked, "a")
    near = nearest(df.join(anchors.select(id_col), id_col, "left_semi"), df, k, "euclidean", id_col, id_col, vector, group, group).select(F.col("q").alias("anchor"), F.col("c").alias("neighbour"), (F.col("rank") - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("q")).alias("m"))
    both = turns.drop("m").withColumn("x", draw("neighbour")).join(near, "anchor").filter(F.col("x") % F.col("m") == F.col("r")).withColumn("by", draw("share") / 4294967296.0)
    v = lambda name, c: df.select(F.col(id_col).alias(name), F.col(vector).alias(c))
    return both.join(v("anchor", "p"), "anchor").join(v("neighbour", "q"), "neighbour").select("i", "anchor", "neighbour", "by", interpolate(F.col("p"), F.col("q"), F.col("by")).alias("synthetic"))


def weighted_support(queries: DataFrame, corpus: DataFrame, k: int = 8, most: int = 12, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, c, rank, repeats, pos): the k nearest rows of each query, nearer ones repeated up to 3 times by their share of 1 / (distance + 0.01); at most 12 places."""
    near = nearest(queries, corpus, k, "cosine", id_col, id_col, vector)
    w = 1 / (1 - F.col("score") + 0.01)
    part = Window.partitionBy("q")
    d = near.withColumn("w", w).withColumn("share", F.col("w") / F.sum("w").over(part)).withColumn("m", F.count(F.lit(1)).over(part))
    d = d.withColumn("repeats", clip(whole(F.round(F.col("share") * F.col("m") * 2, 9)), 1, 3).cast("int"))
    each = d.select("q", "c", "rank", "repeats", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("e"))
    return each.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("rank", "e"))).filter(F.col("pos") <= most).drop("e")


def mixup(df: DataFrame, n: int, alpha: float = 0.2, label: str = "label", id_col: str = "vec_id", vector: str = "embedding", within: bool = True, seed: int = 42) -> DataFrame:
    """(label, a, b, by, synthetic): n mixes for each label of pairs of rows (of the label, or of any) with a Beta(alpha, alpha) share; seeded by label."""
    other = df.select(F.col(label).alias("ob"), F.col(id_col).cast("long").alias("b"), F.col(vector).cast("array<double>").alias("vb"))
    rank = lambda d, g, k: d.withColumn("r", F.row_number().over(Window.partitionBy(*g).orderBy(F.xxhash64(F.lit(seed), k))))
    one = rank(df.select(label, F.col(id_col).cast("long").alias("a"), F.col(vector).cast("array<double>").alias("va")), [label], "a").filter(F.col("r") <= n)
    two = rank(other, ["ob"], F.concat(F.lit("b"), F.col("b"))).filter(F.col("r") <= n) if within else rank(other.withColumn("ob", F.lit(None)), ["ob"], F.concat(F.lit("b"), F.col("b"))).filter(F.col("r") <= n)
    both = one.join(two.withColumnRenamed("r", "s"), (F.col("r") == F.col("s")) & (F.col(label) == F.col("ob") if within else F.lit(True)))

    def run(batches):
        for p in batches:
            by = np.array([np.random.default_rng([seed, int(a), int(b)]).beta(alpha, alpha) for a, b in zip(p["a"], p["b"], strict=True)])
            p["synthetic"] = [(s * np.asarray(x) + (1 - s) * np.asarray(y)).tolist() for s, x, y in zip(by, p["va"], p["vb"], strict=True)]
            yield pd.DataFrame({label: p[label], "a": p["a"], "b": p["b"], "by": by, "synthetic": p["synthetic"]})

    return both.select(label, "a", "b", "va", "vb").mapInPandas(run, f"`{label}` {df.schema[label].dataType.simpleString()}, a long, b long, by double, synthetic array<double>")


def contrastive(df: DataFrame, label: str = "label", id_col: str = "vec_id", vector: str = "embedding", steps: int = 200, rate: float = 0.01, gap: float = 0.5, seed: int = 42, sample: int | None = None) -> DataFrame:
    """(id, refined): vectors drawn to a row of their class and pushed from one of another, step by step. The rows of each step are drawn from all (or, if given, the `sample` first in hash order); the at most 3 × steps drawn are refined in one task, the others stay as they are."""
    every = df.select(F.lit(0).alias("g"), F.col(id_col).cast("long").alias("i"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    pool = every.select("i", "l") if sample is None else every.select("i", "l").orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(sample)
    sizes = sorted(((r.l, r["count"]) for r in pool.groupBy("l").count().collect()), key=lambda x: (x[0] is not None, x[0]))  # one row a class
    ends = np.cumsum([n for _, n in sizes], dtype=np.int64)
    total, rng, draws = int(ends[-1]) if sizes else 0, np.random.default_rng(seed), []
    for _ in range(steps if total else 0):  # places in order of class and identifier
        i = int(rng.integers(total))
        c = int(np.searchsorted(ends, i, side="right"))
        n, start = sizes[c][1], int(ends[c]) - sizes[c][1]
        same = start + int(rng.integers(n))
        other = int(rng.integers(total - n)) if total > n else None
        draws.append((i, same, other + n if other is not None and other >= start else other))
    places = sorted({x for d in draws for x in d if x is not None})
    of = [int(np.searchsorted(ends, x, side="right")) for x in places]
    keys = df.sparkSession.createDataFrame([(sizes[c][0], x - int(ends[c]) + sizes[c][1] + 1, x) for x, c in zip(places, of, strict=True)], "kl string, kr long, place long")
    ranked = numbered(pool, ["l"], ["i"], "r", "m")
    few = ranked.join(F.broadcast(keys), F.col("l").eqNullSafe(F.col("kl")) & (F.col("r") == F.col("kr"))).select("i", "place")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        x, at = np.stack(p["v"]).copy(), {place: k for k, place in enumerate(p["place"])}
        for one, same, other in draws:
            i = at[one]
            x[i] += rate * (x[at[same]] - x[i])
            if other is not None:
                d = x[i] - x[at[other]]
                if (size := np.linalg.norm(d)) < gap and size > 0:
                    x[i] += rate * d / size
        return pd.DataFrame({id_col: p["i"], "refined": list(x)})

    done = every.join(F.broadcast(few), "i").groupBy("g").applyInPandas(run, f"`{id_col}` long, refined array<double>")
    rest = every.join(F.broadcast(few.select("i")), "i", "left_anti").select(F.col("i").alias(id_col), F.col("v").alias("refined"))
    return done.unionByName(rest)


def cells_of(df: DataFrame, most: int = CELL, id_col: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(id, g, v) of the rows with a vector; g names a cell of at most `most` rows near each other.

    Coarse centroids deal the rows out; cells that hold more are dealt again under centroids of
    their own, fitted on a hash sample of each (in its own task), until none is left. Equal vectors,
    and what LEVELS such rounds couldn't part, are dealt by a hash of the identifier.
    """
    every = vectors(df, id_col, vector)
    n = every.count()
    index = build(df, "euclidean", max(1, -(-2 * n // most)), id_col, vector, None, seed) if n else None
    at, done, depth = (index.lists if index else every).select("id", "g", "v"), None, 0
    kind = at.schema["v"].dataType.simpleString()
    while True:
        h = F.xxhash64("v")
        sizes = stored(at.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min(h).alias("lo"), F.max(h).alias("hi")), "cell-sizes")
        full = sizes.filter(F.col("c") > most).select(F.col("g").alias("fg"), "c", ((F.col("lo") == F.col("hi")) | F.lit(depth >= LEVELS)).alias("equal"))
        fits = at.join(full, F.col("g") == F.col("fg"), "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if full.isEmpty():
            return done
        depth += 1
        over = stored(at.join(full, F.col("g") == F.col("fg")), "cells-over")
        salt = F.pmod(F.xxhash64(F.lit(seed + depth), "id", "v"), F.lit(1 << 30))
        by_hash = over.filter("equal").withColumn("g", F.concat_ws(".", "g", F.pmod(salt, F.ceil(2 * F.col("c") / most)).cast("string")))
        fan = lambda c: F.least(F.lit(FAN), F.ceil(2 * c / most))
        sample = over.filter(~F.col("equal")).filter(salt < fan(F.col("c")) * PER_CELL / F.col("c") * (1 << 30)).select("g", "v", fan(F.col("c")).alias("k"))

        def centres(t: pa.Table) -> pa.Table:
            x = matrix(t.column("v"))
            c = lloyd(x, min(len(x), t.column("k")[0].as_py()), seed)
            return pa.table({"cg": pa.array([t.column("g")[0].as_py()], pa.string()), "cs": pa.array([c.tolist()], pa.list_(pa.list_(pa.float64())))})

        told = stored(sample.groupBy("g").applyInArrow(centres, "cg string, cs array<array<double>>"), "cell-centres")  # at most FAN a cell

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, names = (matrix(b.column("v")) if b.num_rows else None), b.column("g").to_pylist()
                out, held = [], {}
                for i, (g, cs) in enumerate(zip(names, b.column("cs"), strict=True)):
                    if g not in held:
                        held[g] = np.array(cs.as_py() or [[0.0] * v.shape[1]])
                    out.append(f"{g}.{((held[g] - v[i]) ** 2).sum(axis=1).argmin()}")
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string()), b.column("v")], names=["id", "g", "v"])

        dealt = over.filter(~F.col("equal")).join(told, F.col("g") == F.col("cg"), "left").select("id", "g", "v", "cs").mapInArrow(near, f"id long, g string, v {kind}")
        at = stored(dealt.unionByName(by_hash.select("id", "g", "v")), "cells")


def representatives(df: DataFrame, share: float = 0.1, method: str = "centroid", id_col: str = "vec_id", vector: str = "embedding", seed: int = 42, most: int = CELL) -> DataFrame:
    """(cluster, id): of about n × share clusters one row each, the nearest to the centroid or the first.

    Two levels: cells of at most `most` rows (cells_of), and clusters of a share of its rows within each
    cell, each cell in a task of its own. No centroid of a cluster leaves its task.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_start"))
        x = matrix(t.column("v"))
        c = lloyd(x, max(1, round(len(x) * share)), seed)
        d = np.round(np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)), 9)
        at, low = d.argmin(axis=1), d.min(axis=1)
        order = np.lexsort((np.arange(len(x)), low if method == "centroid" else np.zeros(len(x)), at))
        first = order[np.unique(at[order], return_index=True)[1]]
        name = t.column("g")[0].as_py()
        return pa.table({"cluster": pa.array([f"{name}/{k}" for k in at[first]], pa.string()), "id": t.column("id").take(pa.array(first))})

    found = cells_of(df, most, id_col, vector, seed).groupBy("g").applyInArrow(run, "cluster string, id long")
    return found.select("cluster", F.col("id").alias(id_col))


__all__ = ["assign", "by_density", "cells_of", "choose_k", "contrastive", "coreset", "elbow", "final_k", "kmeans", "mixup", "representatives", "smote_pairs", "vector_to_array", "weighted_kmeans", "weighted_support"]
