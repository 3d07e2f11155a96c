"""Queries over the shared tables and their DuckDB equivalents.

``query(name, sql)`` registers a function of (spark, sf_dir); sql is None where SQL can't
express the operator. Importing the ``q_*`` modules fills QUERIES and ORACLES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class profile for the ladders: groups of parts with ratios that spread over all brackets."""
    ratio = lambda e, m: F.pmod(F.sum(e), F.lit(m)) / F.lit(float(m - 1))
    part = table(spark, sf_dir, "part").withColumn("label", F.concat_ws("-", "p_brand", F.col("p_size") % 4))
    return part.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_samples"), ratio(F.col("p_size"), 71).alias("f1"), ratio(F.col("p_size") * 3 + 1, 61).alias("quality"),
        ratio(F.col("p_partkey"), 53).alias("purity"), ratio(F.col("p_partkey") * 7, 47).alias("cohesion"), (1 + F.pmod(F.sum("p_size"), F.lit(12))).alias("n_clusters"),
    )


PROFILE = """p AS (SELECT label, count(*) AS n_samples, (sum(p_size) % 71) / 70.0::DOUBLE AS f1, (sum(p_size * 3 + 1) % 61) / 60.0::DOUBLE AS quality,
  (sum(p_partkey) % 53) / 52.0::DOUBLE AS purity, (sum(p_partkey * 7) % 47) / 46.0::DOUBLE AS cohesion, 1 + sum(p_size) % 12 AS n_clusters
  FROM (SELECT *, p_brand || '-' || (p_size % 4) AS label FROM part) GROUP BY label)"""
#: Vectors as doubles.
EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: Class mean vectors.
CENTROIDS = EMB + """, cp AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM cp GROUP BY label)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last digits of different summation orders don't count."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
