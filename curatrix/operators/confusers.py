"""The ordered confusers of the 16 personality classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each class with the classes it is most confused with, most confused first.
CONFUSERS = {
    "INFP": ("ENFP", "INTP", "INFJ", "ISFP"),
    "INFJ": ("ENFJ", "INTJ", "INFP", "ISFJ"),
    "INTP": ("ENTP", "INFP", "INTJ", "ISTP"),
    "INTJ": ("ENTJ", "INFJ", "INTP", "ISTJ"),
    "ISFP": ("ESFP", "INFP", "ISTP", "ISFJ"),
    "ISFJ": ("ESFJ", "INFJ", "ISTJ", "ISFP"),
    "ISTP": ("ESTP", "INTP", "ISTJ", "ISFP"),
    "ISTJ": ("ESTJ", "INTJ", "ISTP", "ISFJ"),
    "ENFP": ("INFP", "ENTP", "ENFJ", "ESFP"),
    "ENFJ": ("INFJ", "ENTJ", "ENFP", "ESFJ"),
    "ENTP": ("INTP", "ENFP", "ENTJ", "ESTP"),
    "ENTJ": ("INTJ", "ENFJ", "ENTP", "ESTJ"),
    "ESFP": ("ISFP", "ENFP", "ESTP", "ESFJ"),
    "ESFJ": ("ISFJ", "ENFJ", "ESTJ", "ESFP"),
    "ESTP": ("ISTP", "ENTP", "ESTJ", "ESFP"),
    "ESTJ": ("ISTJ", "ENTJ", "ESTP", "ESFJ"),
}


def edges(spark: SparkSession) -> DataFrame:
    """(label, place, other): the adjacency list as a dimension table."""
    return spark.createDataFrame([(k, i + 1, o) for k, v in CONFUSERS.items() for i, o in enumerate(v)], "label string, place int, other string")


def confusers(label: str, k: int = 3) -> list[str]:
    return list(CONFUSERS.get(label.upper(), ())[:k])


def primary(label: str) -> str | None:
    """The class that a class is most confused with; None for an unknown one."""
    return next(iter(confusers(label, 1)), None)


def descriptions(traits: DataFrame, opening: str = "How {} differs from the classes near it:", unlike: str = "  - Not like {}: ", core: str = "  - At its core: ") -> DataFrame:
    """(label, description) from a caller's table of traits (label, other, trait): a line for each confuser in order of its place, then other ones by name, last the trait without other. Null traits and labels are left out, repeated rows make one line."""
    t = traits.filter("trait is not null and label is not null").select(F.upper("label").alias("label"), F.upper("other").alias("other"), "trait").distinct()
    t = t.join(F.broadcast(edges(traits.sparkSession)), ["label", "other"], "left")  # 64 rows
    line = F.concat(F.when(F.col("other").isNull(), core).otherwise(F.replace(F.lit(unlike), F.lit("{}"), F.col("other"))), F.col("trait"))
    place = F.coalesce("place", F.when(F.col("other").isNull(), 1 << 30).otherwise(1 << 20))
    lines = F.sort_array(F.collect_list(F.struct(place.alias("place"), F.coalesce("other", F.lit("")).alias("other"), line.alias("line"))))
    one = t.groupBy("label").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))
    return one.select("label", F.concat(F.replace(F.lit(opening), F.lit("{}"), F.col("label")), F.lit("\n"), F.col("lines")).alias("description"))
