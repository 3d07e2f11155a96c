"""Exact dedup by content sort.

Texts are normalised (A-Z lower-cased). A range partitioning by (first characters, hash of the
whole text, salt), whose splitters Spark samples, deals them out; within a partition an
external sort by that key and then the whole normalised text places equals adjacent, and a
window compares neighbours in full. The sort key's short head keeps the sampled splitters
small however long the texts are; the hash only orders, the full text decides. Normalising and
digests come after the one shuffle of texts.

Hot groups: hashes with more than 1/HOT_SHARE of all rows or of all bytes (so fewer than
2 HOT_SHARE of them, which bounds their broadcast) are salted by identifier over `salts`
partitions. One representative text per salted run then meets the others of its group in a
small second comparison, whose outcome meets the rows by broadcast if its size is small,
otherwise in a join by digest, salt and identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, quoted, shuffle_partitions, stored, table

#: A group with more than this share of the rows or bytes is hot, but at least HOT_ROWS rows.
HOT_SHARE, HOT_ROWS = 10_000, 64
SALTS = 64
HEAD = 24
#: The outcome for hot runs is broadcast up to so many bytes, at so many a run.
BROADCAST_BYTES, RUN_BYTES = 16 << 20, 160


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "smallest", salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. keep: "smallest" or "largest"
    identifier of a group stays. A null text counts as empty. A null identifier counts as
    smaller than all others and may only stay where its group has no other. Repeated rows
    (same identifier and text) each count in group_size and share one verdict. An empty
    table gives an empty result; other columns of df are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    best = F.min if keep == "smallest" else F.max
    rows = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("raw"))
    # Texts that are equal after lower-casing A-Z are equal after lower-casing all letters.
    hashed = rows.withColumn("h", F.xxhash64(F.lower("raw")))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw").cast("long")).alias("b"))
    total = rows.agg(F.count(F.lit(1)).alias("all_n"), F.sum(F.octet_length("raw").cast("long")).alias("all_b"))
    hot = counts.filter(F.col("n") > hot_rows).join(F.broadcast(total)).filter((F.col("n") * HOT_SHARE > F.col("all_n")) | (F.col("b") * HOT_SHARE > F.col("all_b"))).select("h", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    keyed = hashed.join(F.broadcast(hot), "h", "left").withColumn("salt", salt).withColumn("head", lower_ascii(F.substring("raw", 1, HEAD)))
    dealt = keyed.repartitionByRange(shuffle_partitions(df.sparkSession), "head", "h", "salt").withColumn("text", lower_ascii(F.col("raw"))).drop("raw")
    run = Window.partitionBy("head", "h", "salt", "text")
    runs = dealt.select("id", "hot", "salt", "text", best("id").over(run).alias("best"), F.count(F.lit(1)).over(run).alias("size"))
    # Of a hot run only the row that stays keeps its text, to meet the representatives of the other salts.
    lean = F.when(F.col("hot") & F.col("id").eqNullSafe(F.col("best")), F.col("text"))
    runs = stored(runs.select("id", "hot", "salt", "best", "size", F.sha2("text", 256).alias("sha"), lean.alias("text")), "exact-runs")
    reps = runs.filter(F.col("text").isNotNull()).dropDuplicates(["sha", "salt", "text"])
    merged = reps.groupBy("sha", "text").agg(best("best").alias("keep"), F.sum("size").alias("total"))
    of_run = reps.select("sha", "salt", "text", F.col("best").alias("b")).join(merged, ["sha", "text"]).select(F.col("sha").alias("s"), F.col("salt").alias("t"), "b", F.lit(True).alias("met"), "keep", "total")
    of_run = stored(of_run, "exact-hot")
    of_run = F.broadcast(of_run) if RUN_BYTES * of_run.count() <= BROADCAST_BYTES else of_run
    final = runs.drop("text").join(of_run, F.col("hot") & (F.col("sha") == F.col("s")) & (F.col("salt") == F.col("t")) & F.col("best").eqNullSafe(F.col("b")), "left")
    keep_id = F.when(F.col("met"), F.col("keep")).otherwise(F.col("best"))
    return final.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("total", "size").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
