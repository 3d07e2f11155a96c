"""Class profiles: counts, lengths, centroids, cohesion, separation, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions.ladders import whole
from curatrix.functions.vectors import cosine, dot, euclidean, mean_vector
from curatrix.operators.neighbors import distance_sums, purity
from curatrix.operators.ranks import quantiles
from curatrix.sources.storage import stored


def dataset_profile(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, classes, smallest, largest and median class, and their imbalance."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"), (F.max("n") / F.min("n")).alias("imbalance"))


def minority(df: DataFrame, label: str, percentile: float = 0.5, explicit: list | None = None) -> DataFrame:
    """(label, n) of the classes up to a quantile of the class sizes, or of the classes named."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if explicit is not None:
        found = {r[0] for r in counts.filter(F.col(label).isin(explicit)).select(label).collect()}
        if missing := [x for x in explicit if x not in found]:
            raise ValueError(f"no rows of {missing}")
        return counts.filter(F.col(label).isin(explicit))
    limit = counts.agg(F.percentile("n", percentile).alias("__limit"))
    return counts.join(F.broadcast(limit)).filter("n <= __limit").drop("__limit")


def word_stats(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Mean, median, deviation, least and most words by class."""
    w = df.select(label, T.word_count(F.col(text)).alias("w"))
    return w.groupBy(label).agg(F.avg("w").alias("mean"), F.percentile("w", 0.5).alias("median"), F.stddev_pop("w").alias("std"), F.min("w").alias("least"), F.max("w").alias("most"))


def length_bounds(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Word statistics with quartiles, and the target length with its bounds."""
    w = df.select(label, T.word_count(F.col(text)).alias("w"))
    g = w.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.percentile("w", 0.5).alias("median"), F.percentile("w", 0.25).alias("p25"), F.percentile("w", 0.75).alias("p75"), F.stddev_pop("w").alias("std"))
    return g.withColumns({"target": whole(F.col("median")), "low": F.greatest(F.lit(50), whole(F.col("p25") * 0.8)), "high": whole(F.col("p75") * 1.2)})


def cohesion(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, n, cohesion): mean cosine similarity of the pairs of a class, from the sum of its unit vectors: (|sum|² - n) / (n (n - 1)). Linear in the rows; null under 2."""
    v = F.col(vector).cast("array<double>")
    unit = df.select(label, F.posexplode(F.transform(v, lambda x: x / F.nullif(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(0.0)))).alias("i", "x"))
    sums = unit.groupBy(label, "i").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    return sums.groupBy(label).agg(F.max("n").alias("n"), ((F.sum(F.col("s") * F.col("s")) - F.max("n")) / F.nullif(F.max("n") * (F.max("n") - 1), F.lit(0))).alias("cohesion"))


def separation(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, separation): least cosine distance of a class's centroid to another's; 1 for a single class. Joins classes, not rows."""
    c = mean_vector(df, [label], vector)
    other = c.select(F.col(label).alias("__l"), F.col("centroid").alias("__c"))
    near = c.join(F.broadcast(other), F.col(label) != F.col("__l"), "left").groupBy(label).agg(F.min(1 - cosine(F.col("centroid"), F.col("__c"))).alias("separation"))
    return near.withColumn("separation", F.coalesce("separation", F.lit(1.0)))


def anchor_quality(df: DataFrame, label: str = "label", vector: str = "embedding", id_col: str = "vec_id", k: int = 10, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), threshold: float = 0.6) -> DataFrame:
    """By class: cohesion, neighbour purity, separation, their weighted quality and whether it reaches the threshold; under 3 rows 0 and no."""
    p = purity(df, df, k, "cosine", id_col, vector, label).groupBy(label).agg(F.avg("purity").alias("purity"))
    out = cohesion(df, label, vector).join(p, label, "left").join(separation(df, label, vector), label, "left")
    small = F.col("n") < 3
    q = weights[0] * F.col("cohesion") + weights[1] * F.col("purity") + weights[2] * F.col("separation")
    return out.withColumn("quality", F.when(small, 0.0).otherwise(q)).withColumn("generate", ~small & (F.col("quality") >= threshold))


def silhouette(df: DataFrame, cluster: str = "label", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, cluster, silhouette) by Euclidean distance, exact; 0 for a cluster of one. Sums of distances to clusters are taken in cells of blocks."""
    sums = distance_sums(df, id_col, vector, cluster)
    sizes = df.filter(F.col(vector).isNotNull()).groupBy(F.coalesce(F.col(cluster).cast("string"), F.lit("\0")).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    both = sums.join(sizes, "other")
    own = F.col("other") == F.col("g")
    each = both.groupBy("id", "g").agg(F.max(F.when(own, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return each.select(F.col("id").alias(id_col), F.nullif("g", F.lit("\0")).alias(cluster), s.alias("silhouette"))


def silhouette_squared(df: DataFrame, cluster: str = "label", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, cluster, silhouette) by squared Euclidean distance, exact and linear in the rows; 0 for a cluster of one.

    The mean squared distance of x to a cluster is |x|² - 2 x·m + q, with the cluster's mean m and mean
    squared length q; these, one row a cluster, travel as one broadcast array.
    """
    d = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(cluster).cast("string"), F.lit("\0")).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    d = d.withColumn("q", dot(F.col("v"), F.col("v")))
    told = mean_vector(d, ["g"], "v", "m").join(d.groupBy("g").agg(F.avg("q").alias("q"), F.count(F.lit(1)).alias("n")), "g")
    every = told.agg(F.collect_list(F.struct("g", "m", "q", "n")).alias("cs"))
    mean = lambda s: F.greatest(F.lit(0.0), F.col("q") - 2 * dot(F.col("v"), s["m"]) + s["q"])
    own = F.array_max(F.transform(F.filter("cs", lambda s: s["g"] == F.col("g")), lambda s: mean(s) * s["n"] / F.nullif(s["n"] - 1, F.lit(0))))
    other = F.array_min(F.transform(F.filter("cs", lambda s: s["g"] != F.col("g")), mean))
    each = d.join(F.broadcast(every)).select("id", "g", own.alias("a"), other.alias("b"))
    s = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return each.select(F.col("id").alias(id_col), F.nullif("g", F.lit("\0")).alias(cluster), s.alias("silhouette"))


def coherence(df: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """(cluster, coherence, rescaled): 1 / (1 + mean distance to the centroid), and stretched around 0.5."""
    c = mean_vector(df, [cluster], vector)
    d = df.join(F.broadcast(c), cluster).groupBy(cluster).agg(F.avg(euclidean(F.col(vector), F.col("centroid"))).alias("d"))
    x = 1.0 / (1.0 + F.col("d"))
    return d.select(cluster, x.alias("coherence"), (0.6 + (x - 0.5) * 0.6).alias("rescaled"))


def confidence_floor(df: DataFrame, label: str, p_true: str, q: float = 0.2) -> DataFrame:
    """(label, floor): a quantile of the true class's probability; under 5 rows the least less 0.2, but 0.4 at least."""
    df = stored(df.select(label, p_true), "floors")
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(p_true).alias("__m")).join(quantiles(df, [label], p_true, {"__q": q}).drop("__n"), label, "left")
    return g.select(label, "n", F.when(F.col("n") < 5, F.greatest(F.lit(0.4), F.col("__m") - 0.2)).otherwise(F.col("__q")).alias("floor"))


def prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, tp, fp, fn, precision, recall, f1) by class; 0 where undefined. Classes come from either column."""
    both = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p"))
    long = both.select(F.explode(F.array(F.struct(F.col("t").alias("label"), (F.col("t") == F.col("p")).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col("t") != F.col("p")).cast("int").alias("fn"), F.lit(1).alias("s")), F.struct(F.col("p").alias("label"), F.lit(0).alias("tp"), (F.col("t") != F.col("p")).cast("int").alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("s")))).alias("x")).select("x.*")
    g = long.groupBy("label").agg(F.sum("s").alias("support"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "f1": safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def averages(report: DataFrame) -> DataFrame:
    """One row: macro and weighted F1 and accuracy of a prf() report."""
    return report.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"), (F.sum("tp") / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"))


def top_keywords(df: DataFrame, label: str, text: str = "text", k: int = 20) -> DataFrame:
    """(label, word, n, rank): the k most frequent lower-cased alphabetic words of over 3 letters; ties by word. Counted with partial aggregation."""
    w = df.select(label, F.explode(T.words(F.col(text))).alias("w")).filter(F.length("w") > 3).filter(F.col("w").rlike(r"^\p{L}+$"))
    n = w.groupBy(label, F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.col("n").desc(), "word"))).filter(F.col("rank") <= k)


def vocabulary_diversity(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(label, distinct_words, total_words, diversity) of ASCII words."""
    n = df.select(label, F.explode(T.letters(F.col(text))).alias("w")).groupBy(label, "w").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(label).agg(F.count(F.lit(1)).alias("distinct_words"), F.sum("n").alias("total_words"), (F.count(F.lit(1)) / F.sum("n")).alias("diversity"))


def rejections(df: DataFrame, label: str, reason: str) -> DataFrame:
    """(label, reason, n, share) for each class and, with a null label, overall: a rollup."""
    n = df.withColumn("__r", F.col(reason)).groupBy("__r", label).agg(F.count(F.lit(1)).alias("n"))
    every = n.unionByName(n.groupBy("__r").agg(F.sum("n").alias("n")).withColumn(label, F.lit(None).cast(df.schema[label].dataType)))
    return every.select(label, F.col("__r").alias(reason), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(label))).alias("share"))


def distribution(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Mean, deviation, least, most and quartiles of a value by group."""
    d = stored(df.select(*by, value.alias("x")), "distribution")
    g = d.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))
    return g.join(quantiles(d, by, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("__n"), by, "left")
