"""Anchor selection: representative rows of a class or cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions.ladders import uniform
from curatrix.functions.vectors import cosine, mean_vector
from curatrix.operators.dedup import greedy_similar
from curatrix.operators.neighbors import cosine_spread, nearest, purity
from curatrix.operators.ranks import numbered, quantiles, with_totals
from curatrix.sources.storage import stored


def to_centroid(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """df with sim: cosine similarity to the centroid of its group."""
    c = mean_vector(df, [group], vector, "__c")
    return df.join(F.broadcast(c), group).withColumn("sim", cosine(F.col(vector), F.col("__c"))).drop("__c")


def first_by(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__r = 1").drop("__r")


def centroid_nearest(df: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, id, sim): the row most similar to its group's centroid, ties to the smallest identifier."""
    return first_by(to_centroid(df, group, vector), group, F.round("sim", 9).desc(), id_col).select(group, id_col, "sim")


def _total_distance(df: DataFrame, group: str, id_col: str, vector: str) -> DataFrame:
    """(group, id, total, n): sum of cosine distances to the rows of its group, from the group's sum of unit vectors: linear in the rows."""
    v = F.col(vector).cast("array<double>")
    unit = df.select(group, id_col, F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))).alias("u"))
    sums = mean_vector(unit, [group], "u", "m").join(unit.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
    both = unit.join(F.broadcast(sums), group)
    dot = F.aggregate(F.zip_with("u", "m", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.select(group, id_col, (F.col("n") * (1 - dot)).alias("total"), "n")


def medoid(df: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, id, total): the row with the least sum of cosine distances to its group."""
    return first_by(_total_distance(df, group, id_col, vector), group, F.round("total", 9), id_col).select(group, id_col, "total")


def quality_gated(df: DataFrame, group: str, text: str, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.5) -> DataFrame:
    """(group, id, sim): the most central row; in a group whose mean similarity is low, the most central readable one if there is any."""
    d = with_totals(to_centroid(df, group, vector), group, {"__m": F.avg("sim")})
    ok = F.when(F.col("__m") < least, T.readable(F.col(text)).cast("int")).otherwise(F.lit(1))
    return first_by(d.withColumn("__ok", ok), group, F.col("__ok").desc(), F.round("sim", 9).desc(), id_col).select(group, id_col, "sim")


def purity_gated(df: DataFrame, group: str, label: str, id_col: str = "vec_id", vector: str = "embedding", k: int = 15, least: float = 0.6) -> DataFrame:
    """(group, id, purity): of groups whose centroid's k nearest rows are pure enough, the row nearest the centroid."""
    c = mean_vector(df, [group, label], vector, vector).withColumn(id_col, F.lit(-1) - F.row_number().over(Window.orderBy(group, label)))
    p = purity(c, df.select(id_col, label, vector), k, "cosine", id_col, vector, label)
    good = p.filter(F.col("purity") >= least).join(c.select(id_col, group), id_col).select(group, "purity")
    return centroid_nearest(df, group, id_col, vector).join(F.broadcast(good), group).select(group, id_col, "purity")


def diverse_midband(df: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, id, diversity): of rows between the quartiles of distance to the centroid, the one with the largest mean distance to its group."""
    d = stored(to_centroid(df, group, vector).withColumn("__d", 1 - F.col("sim")), "midband")
    q = quantiles(d, [group], "__d", {"__l": 0.25, "__h": 0.75}).drop("__n")
    mid = d.join(q, group).filter("__d >= __l - 1e-12 and __d <= __h + 1e-12").select(group, id_col)
    t = _total_distance(df, group, id_col, vector).withColumn("diversity", F.col("total") / F.col("n"))
    return first_by(t.join(mid, [group, id_col]), group, F.round("diversity", 9).desc(), id_col).select(group, id_col, "diversity")


def farthest_first(df: DataFrame, group: str, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, id, step): farthest-first traversal by cosine distance from the smallest identifier.

    Each step is one pass: the distance of every row to the nearest chosen one goes down by
    the row chosen last (one per group, broadcast), and the farthest row is found by a partial
    aggregation. Exact, k passes, no group in one task.
    """
    near = stored(df.select(group, F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), F.lit(4.0).alias("d")), "farthest")
    best = near.groupBy(group).agg(F.min_by(F.struct("i", "v"), "i").alias("x"))
    out = None
    for step in range(k):
        best = stored(best, "farthest-best")
        this = best.select(group, F.col("x.i").alias(id_col), F.lit(step).alias("step"))
        out = this if out is None else out.unionByName(this)
        if step + 1 < k:
            met = near.join(F.broadcast(best), group).select(group, "i", "v", F.least("d", F.round(1 - cosine(F.col("v"), F.col("x.v")), 12)).alias("d"), (F.col("i") == F.col("x.i")).alias("own"))
            near = stored(met.filter(~F.col("own")).drop("own"), "farthest")
            best = near.groupBy(group).agg(F.max_by(F.struct("i", "v"), F.struct(F.col("d"), -F.col("i"))).alias("x"))
    return out


def hard(df: DataFrame, label: str, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(label, id, distance, rank): the k rows of each class nearest to another class."""
    near = nearest(df, df, 1, "cosine", id_col, id_col, vector, label, label, same=False)
    d = near.select(F.col("q").alias(id_col), (1 - F.col("score")).alias("distance")).join(df.select(id_col, label), id_col)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.round("distance", 9), id_col))).filter(F.col("rank") <= k).select(label, id_col, "distance", "rank")


def random_anchors(df: DataFrame, group: str, k: int, id_col: str = "vec_id", seed: int = 42) -> DataFrame:
    """(group, id): k rows of each group in the order of a seeded hash."""
    order = Window.partitionBy(group).orderBy(uniform(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).select(group, id_col)


def dedup_anchors(anchors: DataFrame, rank: str, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchors with kept: in order of rank, an anchor goes if a kept one is as similar as the threshold."""
    return greedy_similar(anchors, threshold, "cosine", id_col, vector, strict=False, order=rank)


def ensemble_scores(anchors: DataFrame, df: DataFrame, label: str = "label", id_col: str = "vec_id", vector: str = "embedding", k: int = 15, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """(label, id, diversity, purity, hardness, stability, score, rank) of anchors within their class.

    diversity: mean cosine distance to the other anchors (1 if alone); purity of the k nearest
    rows, the anchor's own row included; hardness e^(-2 d) of the nearest row of another class
    (0 if none); stability 1 / (1 + deviation of the distances to the class), from the class's moments.
    """
    a = anchors.select(id_col, label, vector)
    t = _total_distance(a, label, id_col, vector)
    diversity = t.select(id_col, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(1.0).alias("diversity"))
    p = purity(a, df.select(id_col, label, vector), k, "cosine", id_col, vector, label, exclude_self=False).select(id_col, "purity")
    enemy = nearest(a, df, 1, "cosine", id_col, id_col, vector, label, label, same=False).select(F.col("q").alias(id_col), F.exp(-2.0 * (1 - F.col("score"))).alias("hardness"))
    stability = cosine_spread(a, df, id_col, vector, label).select(F.col("id").alias(id_col), (1 / (1 + F.col("deviation"))).alias("stability"))
    out = a.select(id_col, label).join(diversity, id_col).join(p, id_col).join(enemy, id_col, "left").join(stability, id_col).na.fill({"hardness": 0.0})
    score = sum(w * F.col(c) for w, c in zip(weights, ("diversity", "purity", "hardness", "stability"), strict=True))
    out = out.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.round("score", 9).desc(), id_col)))


def central(df: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding", ratio: float = 0.7, method: str = "iqr", threshold: float = 1.5, least: int = 3) -> DataFrame:
    """(group, id, sim, rank): the most central rows after outliers below the interquartile (or z-score) bound go; small groups are taken whole."""
    d = stored(to_centroid(df, group, vector), "central")
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.avg("sim").alias("__m"), F.stddev_pop("sim").alias("__s"))
    g = g.join(quantiles(d, [group], "sim", {"__l": 0.25, "__h": 0.75}).drop("__n"), group)
    d = d.join(g, group)
    if method not in ("iqr", "zscore"):
        raise ValueError(f"method: {method!r}")
    inside = F.col("sim") >= (F.col("__l") - threshold * (F.col("__h") - F.col("__l")) if method == "iqr" else F.col("__m") - threshold * F.col("__s"))
    d = with_totals(d.withColumn("__in", inside), group, {"__k": F.sum(F.col("__in").cast("int"))})
    d = d.withColumn("__in", F.when(F.col("__k") < least, F.lit(True)).otherwise(F.col("__in")))
    d = numbered(d, [group], [~F.col("__in"), -F.round("sim", 9), F.col(id_col)], "rank", "__size")
    many = F.when(F.col("__n") <= least, F.col("__n")).when(F.col("__k") < least, F.lit(least)).otherwise(F.greatest(F.lit(least), F.floor(F.col("__k") * ratio)))
    return d.filter(F.col("rank") <= many).select(group, id_col, "sim", "rank")


def ensemble_metrics(ranked: DataFrame, strategy: str) -> DataFrame:
    """One row: anchors, strategies, mean, least and most purity, mean diversity."""
    return ranked.agg(F.count(F.lit(1)).alias("anchors"), F.countDistinct(strategy).alias("strategies"), F.avg("purity").alias("mean_purity"), F.min("purity").alias("least_purity"), F.max("purity").alias("most_purity"), F.avg("diversity").alias("diversity"))


def recommended(texts: DataFrame, group: str, id_col: str, text: str, ask, most: int = 10, chars: int = 200) -> DataFrame:
    """(group, id): the row that a generator names. ask: prompt -> reply, injected; the first integer of a reply counts, from 1; otherwise the first row."""
    order = Window.partitionBy(group).orderBy(id_col)
    few = texts.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most)
    lists = few.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("__r", F.col(id_col).cast("long").alias("i"), F.substring(text, 1, chars).alias("t")))).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for p in batches:
            ids = []
            for x in p["x"]:
                m = re.search(r"\d+", ask("Which text is typical? Answer with its number.\n" + "\n".join(f"{r['__r']}. {r['t']}" for r in x)) or "")
                ids.append(x[int(m[0]) - 1]["i"] if m and 0 < int(m[0]) <= len(x) else x[0]["i"])
            yield pd.DataFrame({group: p[group], id_col: ids})

    return lists.mapInPandas(run, f"`{group}` {texts.schema[group].dataType.simpleString()}, `{id_col}` long")
