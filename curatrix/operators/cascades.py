"""Filter cascades that report one reason for each row.

A cascade is a CASE over measures that are computed for all rows in one plan: the first
failing test names the reason, later tests don't run on the row's account. Only what depends
on rows accepted before (duplicates within a batch) needs another step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions.vectors import argmax, cosine, euclidean, margin, mean_vector
from curatrix.operators.dedup import greedy_shingles
from curatrix.operators.neighbors import nearest, pair_distances
from curatrix.operators.ranks import quantiles, with_totals
from curatrix.sources.storage import stored


def nearest_other(df: DataFrame, label: str, centroids: DataFrame, vector: str = "embedding", name: str = "other_sim") -> DataFrame:
    """df with the largest cosine similarity to a centroid of another class. Classes are few, so they travel as one broadcast array."""
    every = centroids.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias("__cs"))
    sims = F.transform(F.filter("__cs", lambda s: s["l"] != F.col(label)), lambda s: cosine(F.col(vector), s["c"]))
    return df.join(F.broadcast(every)).withColumn(name, F.array_max(sims)).drop("__cs")


def confusers_of(edges: DataFrame, k: int = 3) -> DataFrame:
    """(label, other) of the first k entries of an ordered adjacency list (label, other, place)."""
    return edges.filter(F.col("place") <= k).select("label", "other")


def nearest_confuser(df: DataFrame, label: str, centroids: DataFrame, edges: DataFrame, vector: str = "embedding", name: str = "confuser_sim") -> DataFrame:
    """df with the largest cosine similarity to a centroid of the class's confusers (null without)."""
    c = edges.join(centroids.select(F.col(label).alias("other"), "centroid"), "other").groupBy(F.col("label").alias("__l")).agg(F.collect_list("centroid").alias("__cs"))
    both = df.join(F.broadcast(c), F.col(label) == F.col("__l"), "left")
    return both.withColumn(name, F.array_max(F.transform("__cs", lambda x: cosine(F.col(vector), x)))).drop("__cs", "__l")


def similar_enough(sim: Column, anchor: Column, neighbour: Column, floor: Column, threshold: float = 0.70, slack: float = 0.08, to_anchor: float = 0.50) -> Column:
    return (sim >= F.greatest(floor, F.lit(threshold - slack))) | (F.greatest(anchor, neighbour) >= to_anchor)


def classifier_ok(proba: Column, target: Column, floor: Column, least: float = 0.6, most: float = 1.0, least_margin: float = 0.10) -> Column:
    """The predicted class is the target, with enough confidence and margin, and not over the upper bound."""
    p = F.get(proba, target)
    return F.coalesce((argmax(proba) == target) & (p >= F.least(F.lit(least), floor)) & (p <= most) & (margin(proba) >= least_margin), F.lit(False))


def reason(tests: list[tuple[str, Column]]) -> Column:
    """The name of the first test that fails (or is null), else "accepted"."""
    out = None
    for name, ok in tests:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("accepted")


def main_cascade(df: DataFrame, tokens: str = "tokens", sim: str = "sim", anchor: str = "anchor_sim", neighbour: str = "neighbour_sim", other: str = "other_sim", confuser: str = "confuser_sim", semantic: str = "nearest_sim", proba: str = "proba", target: str = "target", knn: str = "knn_sim", text_dup: str = "text_dup", floor: Column | None = None, min_tokens: int = 15, max_tokens: int = 180, threshold: float = 0.70, slack: float = 0.08, to_anchor: float = 0.50, repel: float = 0.60, dedup: float = 0.95, knn_least: float = 0.45, mode: str = "hybrid", contrast: bool = True, least: float = 0.6, least_margin: float = 0.10) -> DataFrame:
    """df with reason: length, similarity, repel, contrastive, semdup, classifier, dup_ref or accepted."""
    c = lambda x: F.col(x)
    by_class, by_knn = classifier_ok(c(proba), c(target), F.lit(least), least, 1.0, least_margin), c(knn) >= knn_least
    chosen = {"classifier": by_class, "knn": by_knn, "hybrid": by_class | F.coalesce(by_knn, F.lit(False))}[mode]
    tests = [
        ("length", c(tokens).between(min_tokens, max_tokens)), ("similarity", similar_enough(c(sim), c(anchor), c(neighbour), floor if floor is not None else F.lit(-1.0), threshold, slack, to_anchor)),
        ("repel", F.coalesce(c(other) < repel, F.lit(True))), ("contrastive", F.coalesce(c(confuser) <= c(sim), F.lit(True)) if contrast else F.lit(True)),
        ("semdup", F.coalesce(c(semantic) < dedup, F.lit(True))), ("classifier", chosen), ("dup_ref", ~F.coalesce(c(text_dup), F.lit(False))),
    ]
    return df.withColumn("reason", reason(tests))


def batch_duplicates(df: DataFrame, batch: str, id_col: str, order: str, text: str = "text", n: int = 3, threshold: float = 0.85) -> DataFrame:
    """df with kept: within a batch, in order, a row goes if its shingles are nearly those of a kept one."""
    return greedy_shingles(df, batch, id_col, order, text, n, threshold)


def grace(df: DataFrame, spec: str, id_col: str, k: int = 1, tokens: str = "tokens", sim: str = "sim", anchor: str = "anchor_sim", neighbour: str = "neighbour_sim", proba: str = "proba", target: str = "target", other: str = "other_sim", min_tokens: int = 15, max_tokens: int = 180, least_anchor: float = 0.35, least_score: float = 0.45, least_conf: float = 0.35, least_margin: float = 0.10, repel: float = 0.60) -> DataFrame:
    """Of specs with no accepted row (column reason), the k best rejected rows by 0.6 nearest + 0.4 centroid similarity that pass relaxed tests."""
    to = F.greatest(anchor, neighbour)
    d = with_totals(df.withColumn("grace_score", 0.6 * to + 0.4 * F.col(sim)), spec, {"__any": F.max((F.col("reason") == "accepted").cast("int"))})
    ok = F.col(tokens).between(min_tokens, max_tokens) & ((to >= least_anchor) | (F.col("grace_score") >= least_score)) & classifier_ok(F.col(proba), F.col(target), F.lit(1.0), least_conf, 1.0, least_margin) & F.coalesce(F.col(other) < repel, F.lit(True))
    rank = F.row_number().over(Window.partitionBy(spec).orderBy(F.round("grace_score", 9).desc(), id_col))
    return d.filter((F.col("__any") == 0) & ok).withColumn("grace_rank", rank).filter(F.col("grace_rank") <= k).drop("__any")


def contamination_aware(anchor: Column, knn: Column, conf: Column, thresholds: Column, purity: Column, ratio: Column, weight: float = 0.2) -> Column:
    """Struct (accepted, reason, score): three tests against risk thresholds; a rejected row's confidence is reduced by its contamination."""
    bad = F.filter(F.array(F.when(anchor < thresholds["to_anchor"], "anchor_similarity"), F.when(knn < thresholds["min_similarity"], "knn_similarity"), F.when(conf < thresholds["min_confidence"], "classifier_confidence")), lambda x: x.isNotNull())
    why = F.when(F.size(bad) == 0, "accepted").when(F.size(bad) == 1, F.concat(F.lit("failed_"), F.get(bad, F.lit(0)))).otherwise(F.concat(F.lit("failed_multiple ("), F.array_join(bad, ", "), F.lit(")")))
    return F.struct((F.size(bad) == 0).alias("accepted"), why.alias("reason"), F.when(F.size(bad) == 0, conf).otherwise(conf * (1.0 - weight * ratio * (1.0 - purity))).alias("score"))


def knn_similarity(df: DataFrame, corpus: DataFrame, k: int, label: str = "label", metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, knn): mean cosine similarity (or distance) of each row to its k nearest corpus rows of its class."""
    near = nearest(df, corpus, k, metric, id_col, id_col, vector, label, label)
    return near.groupBy(F.col("q").alias(id_col)).agg(F.avg("score").alias("knn"))


def hard_filters(df: DataFrame, group: str, distance: str, sim: str, knn: str, least_sim: float = 0.63, most_knn: float = 0.5, quantile: float = 0.90, drop_share: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """df with reason of the hard cascade: distance under its group's quantile, similarity, neighbour distance, and (if asked) a share rejected by hash."""
    df = stored(df, "hard-filters")
    q = quantiles(df, [group], distance, {"__q": quantile}).drop("__n")
    tests = [("length", F.round(distance, 9) < F.round("__q", 9)), ("similarity", F.col(sim) > least_sim), ("knn", F.coalesce(F.col(knn) <= most_knn, F.lit(True)))]
    if drop_share is not None:
        from curatrix.functions.ladders import uniform

        tests.append(("confidence", uniform(F.col(id_col)) >= drop_share))
    return df.join(q, group).withColumn("reason", reason(tests)).drop("__q")


def quality_scores(df: DataFrame, group: str, distance: str, sim: str, knn: str, to_centroid: str, how: str = "product") -> DataFrame:
    """df with score of a candidate: product (of exponential neighbour scores), geometric (mean of the four) or reciprocal (of the candidate alone)."""
    d, s, n, c = map(F.col, (distance, sim, knn, to_centroid))
    df = with_totals(df, group, {"__md": F.max(distance), "__mc": F.max(to_centroid)})
    length, conf = 1 - d / (F.col("__md") + 1e-6), 1 - c / (F.col("__mc") + 1e-6)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    out = {
        "product": length * inside * F.coalesce(F.exp(-n), F.lit(0.5)) * conf, "geometric": F.pow(length * inside * F.coalesce(1 / (1 + n), F.lit(0.0)) * F.coalesce(conf, F.lit(0.5)), F.lit(0.25)),
        "reciprocal": F.pow(1 / (1 + d) * F.greatest(F.lit(0.0), s) * F.coalesce(1 / (1 + n), F.lit(0.5)) * (1 / (1 + c)), F.lit(0.25)),
    }[how]
    return df.withColumn("score", out).drop("__md", "__mc")


def top_quota(df: DataFrame, group: str, score: str, k: int, floor: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """The k best rows of each group, ties by identifier; with a floor, only rows that reach it. With rank."""
    d = df if floor is None else df.filter(F.col(score) >= floor)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.round(score, 9).desc(), id_col))).filter(F.col("rank") <= k)


def percentile_cascade(df: DataFrame, group: str, steps: list[tuple[str, str, float]]) -> DataFrame:
    """Rows that survive steps (column, "under" | "from", quantile) in turn, each quantile taken over the survivors of the step before."""
    df = stored(df, "percentiles")
    for column, side, q in steps:
        limit = quantiles(df, [group], column, {"__q": q}).drop("__n")
        a, b = F.round(column, 9), F.round("__q", 9)
        df = df.join(limit, group).filter(a < b if side == "under" else a >= b).drop("__q")
    return df


def relaxed(df: DataFrame, group: str, sim: str, start: Column, k: int = 5, floor: float = 0.40, step: float = 0.10, id_col: str = "vec_id") -> DataFrame:
    """The k most similar rows of each group at the first threshold, from `start` down by steps to the floor, that k rows reach; otherwise all at the floor; otherwise the k best. With used: the threshold. start is one value for each group."""
    df = stored(df, "relaxed")
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.round(sim, 9).desc(), id_col))
    top = df.withColumn("__rank", first).filter(F.col("__rank") <= k)  # cut before the shuffle
    least = top.withColumn("__s", start).groupBy(F.col(group).alias("__g")).agg(F.max("__s").alias("__s"), F.max(F.when(F.col("__rank") == k, F.col(sim))).alias("__kth"), F.max(sim).alias("__best"))
    tries = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.round(F.col("__s") - i * step, 6))
    fit = F.array_max(F.filter(tries, lambda t: (t >= floor - 1e-6) & (F.col("__kth") >= t)))
    used = F.when(fit.isNotNull(), fit).when(F.col("__best") >= floor, F.lit(floor)).otherwise(F.lit(None))
    least = stored(least.select("__g", used.alias("used"), (fit.isNull() & (F.col("__best") >= floor)).alias("__all")), "relaxed-groups")
    with_used = lambda d: d.join(least, d[group].eqNullSafe(F.col("__g")))
    best, rest = with_used(top).filter(~F.coalesce("__all", F.lit(False))), with_used(df).filter(F.col("__all") & (F.col(sim) >= floor))
    return best.select(*df.columns, "used").unionByName(rest.select(*df.columns, "used"))


def centroid_features(df: DataFrame, label: str = "label", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df with sim and distance to its class's centroid."""
    c = mean_vector(df, [label], vector, "__c")
    return df.join(F.broadcast(c), label).withColumns({"sim": cosine(F.col(vector), F.col("__c")), "distance": euclidean(F.col(vector), F.col("__c"))}).drop("__c")


def trusted(df: DataFrame, confidence: str, predicted: str, label: str, least: float = 0.7, agreement: bool = True) -> DataFrame:
    """Rows of high confidence that the baseline agrees with."""
    d = df.filter(F.col(confidence) >= least)
    return d.filter(F.col(predicted) == F.col(label)) if agreement else d


def discriminator_weight(p_synthetic: Column, threshold: float = 0.7, upper: float = 0.9) -> Column:
    """Struct (zone_weight, weight): 1 below the threshold, 0.5 up to `upper`, 0 above; and 1 - p."""
    return F.struct(F.when(p_synthetic < threshold, 1.0).when(p_synthetic < upper, 0.5).otherwise(0.0).alias("zone_weight"), (1.0 - p_synthetic).alias("weight"))


def class_diversity(df: DataFrame, label: str = "label", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(label, diversity): mean Euclidean distance of the pairs of a class, exact, in cells of blocks."""
    sums = pair_distances(df, vector, label, id_col)
    return sums.select(F.nullif("g", F.lit("\0")).cast(df.schema[label].dataType).alias(label), (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("diversity"))
