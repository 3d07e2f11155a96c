"""Vector columns (array<float> or array<double>) without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def interpolate(a: Column, b: Column, by: Column) -> Column:
    """a + by (b - a)."""
    return F.zip_with(_d(a), _d(b), lambda x, y: x + by * (y - x))


def margin(p: Column) -> Column:
    """Difference of the two largest probabilities; of one, itself; of none, 0."""
    s = F.sort_array(p, asc=False)
    return F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def argmax(p: Column) -> Column:
    """Index of the first largest element; null if there is none."""
    return F.nullif(F.array_position(p, F.array_max(p)), F.lit(0)) - 1


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The mean vector of each group, with partial aggregation by component."""
    parts = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"])
    return parts.groupBy(*keys).agg(ordered.alias(out))
