"""Sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.ladders import below, clip

#: Tier bounds of F1 and what a tier's class weight is multiplied by.
TIERS = [(0.15, "very_low"), (0.20, "low"), (0.45, "mid")]
BOOSTS = {"very_low": 2.5, "low": 2.0, "mid": 1.5, "high": 1.0}


def synthetic_weight(is_synthetic: Column, weight: float = 0.5, confidence: Column | None = None, otherwise: Column | float = 1.0) -> Column:
    """1 for real rows; for synthetic ones flat, or by confidence clipped to 0..1 (null: `otherwise`, e.g. the mean)."""
    w = F.lit(weight) if confidence is None else weight * clip(F.coalesce(confidence, otherwise if isinstance(otherwise, Column) else F.lit(otherwise)), 0.0, 1.0)
    return F.when(is_synthetic, w).otherwise(1.0)


def adaptive_weight(confidence: Column, quality: Column, base: float = 0.3, by_confidence: float = 1.5, by_quality: float = 1.0, low: float = 0.1, high: float = 1.0) -> Column:
    return clip(base * F.pow(F.coalesce(confidence, F.lit(0.5)), F.lit(by_confidence)) * F.pow(F.coalesce(quality, F.lit(0.5)), F.lit(by_quality)), low, high)


def f1_weight(f1: Column, default: float = 0.5) -> Column:
    """Synthetic weight of a class by its F1: weak classes take more; unknown F1 the default."""
    return F.when(f1.isNull() | (f1 < 0), default).otherwise(below(f1, [(0.15, 0.5), (0.30, 0.3), (0.45, 0.1)], 0.05))


def tier(f1: Column) -> Column:
    return below(f1, TIERS, "high")


def band(f1: Column, low: float = 0.20, mid: float = 0.45) -> Column:
    return below(f1, [(low, "LOW"), (mid, "MID")], "HIGH")


def class_weights(df: DataFrame, label: str, f1: DataFrame, boosts: dict | None = None, balanced: bool = True) -> DataFrame:
    """(label, n, tier, weight): balanced weight n / (classes × n of the class), times the tier's boost; a class of unknown F1 counts as 0.5. f1: (label, f1)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    d = counts.join(F.broadcast(f1), label, "left").join(F.broadcast(total)).withColumn("tier", tier(F.coalesce("f1", F.lit(0.5))))
    base = F.col("__t") / (F.col("__k") * F.col("n")) if balanced else F.lit(1.0)
    times = F.coalesce(*(F.when(F.col("tier") == k, F.lit(v)) for k, v in (boosts or BOOSTS).items()), F.lit(1.0))
    return d.select(label, "n", "tier", (base * times).alias("weight"))


def to_mean_one(df: DataFrame, weight: str, out: str, mean: float = 1.0) -> DataFrame:
    """df with the weight scaled to a mean of `mean`; the mean is one aggregate, broadcast."""
    m = df.agg(F.avg(weight).alias("__m"))
    return df.join(F.broadcast(m)).withColumn(out, F.col(weight) / (F.col("__m") + 1e-8) * mean).drop("__m")


def focal(df: DataFrame, p_true: str, gamma: float = 2.0, out: str = "focal") -> DataFrame:
    """(1 - p)^gamma, scaled to a mean of 1."""
    return to_mean_one(df.withColumn(out, F.pow(1.0 - F.col(p_true), F.lit(gamma))), out, out)


def combined(df: DataFrame, class_weight: str, is_synthetic: str, focal_weight: str | None = None, times: float = 0.5, out: str = "weight") -> DataFrame:
    """Class weight × synthetic factor × focal weight, scaled to a mean of 1."""
    w = F.col(class_weight) * F.when(F.col(is_synthetic), times).otherwise(1.0)
    return to_mean_one(df.withColumn(out, w * F.col(focal_weight) if focal_weight else w), out, out)


def stage_two(df: DataFrame, confidence: str, times: float = 0.5, scaled: bool = True, out: str = "weight") -> DataFrame:
    """Weights of a second training stage: the multiplier, in proportion to confidence if scaled."""
    return to_mean_one(df.withColumn(out, F.col(confidence) * times), out, out, times) if scaled else df.withColumn(out, F.lit(times))


def vote(df: DataFrame, row: str, model: str, proba: str, f1: DataFrame, temperature: float = 5.0) -> DataFrame:
    """(row, proba, predicted): soft vote of models weighted by softmax(temperature × F1). f1: (model, f1)."""
    top = f1.agg(F.max("f1").alias("__x"))
    e = f1.join(F.broadcast(top)).select(model, F.exp(temperature * (F.col("f1") - F.col("__x"))).alias("e"))
    w = e.join(F.broadcast(e.agg(F.sum("e").alias("s")))).select(model, (F.col("e") / F.col("s")).alias("w"))
    parts = df.join(F.broadcast(w), model).select(row, "w", F.posexplode(proba).alias("i", "p")).groupBy(row, "i").agg(F.sum(F.col("w") * F.col("p")).alias("p"))
    out = parts.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("proba"))
    return out.withColumn("predicted", F.array_position("proba", F.array_max("proba")) - 1)


def majority(df: DataFrame, row: str, predicted: str) -> DataFrame:
    """(row, predicted): the most frequent prediction, ties to the smallest."""
    n = df.groupBy(row, predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(row).orderBy(F.col("n").desc(), predicted))).filter("r = 1").select(row, predicted)
