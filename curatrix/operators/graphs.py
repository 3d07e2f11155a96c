"""Connected components and the greedy keep-first choice over a table of edges.

The greedy choice walks rows in order and keeps one unless a kept earlier row is its
neighbour. Its outcome depends on neighbours within a component only, so components of at most `small`
edges are solved whole, many to a task. What is in larger ones goes in rounds: rows without an
undecided earlier neighbour are kept and their neighbours go, which cuts large components into
small ones. Where a round decides little, as along a chain in order, the edges of the first rows
in order, at most `small` of them, are walked in one task instead. So the rounds are at most
about log(edges) + edges / small, however long chains are.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.sources.storage import discard, source_of, stored

#: Edges that one task walks.
SMALL = 500_000
#: A round that leaves more than this share of the edges has decided little.
SLOW = 0.75


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node reachable.

    Alternating steps: every node hands its larger neighbours to its smallest neighbour, then its
    smaller ones. Both keep connectivity and end in stars.
    """
    spark = edges.sparkSession
    edges, sign = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components"), None
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        up = stored(edges.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).filter("u <> v").distinct(), "components")
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct()
        down = stored(down, "components")
        discard(spark, *source_of(edges), *source_of(up))
        edges, before = down, sign
        sign = tuple(down.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if sign == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _walked(edges: pa.Table) -> pa.Table:
    """(id) of the rows that go, among all edges (first, second, place) of some components or of the first rows in order."""
    order = pc.sort_indices(edges, sort_keys=[("place", "ascending"), ("second", "ascending")], null_placement="at_start")
    gone: dict = {}
    for a, b in zip(edges.column("first").take(order).to_pylist(), edges.column("second").take(order).to_pylist(), strict=True):
        if a not in gone:
            gone[b] = True
    return pa.table({"id": pa.array(list(gone), edges.schema.field("second").type)})


def _walk(edges: DataFrame, key: Column) -> DataFrame:
    return edges.select("first", "second", "place", key.alias("task")).groupBy("task").applyInArrow(_walked, f"id {edges.schema['second'].dataType.simpleString()}")


def greedy_dropped(edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, int]:
    """((id) of the rows that go, rounds). edges: (first, second, place), first before second in the order (place, second), place being the second's."""
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = stored(edges.select("first", "second", "place").distinct(), "greedy-edges")
    dropped, rounds, left = spark.createDataFrame([], f"id {edges.schema['second'].dataType.simpleString()}"), 0, edges.count()
    while left > small:
        rounds += 1
        comp = components(edges.select(F.col("first").alias("a"), F.col("second").alias("b")))
        tagged = stored(edges.join(comp.withColumnRenamed("node", "first"), "first"), "greedy-tagged")
        large = stored(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > small).select("component"), "greedy-large")
        light = stored(tagged.join(large, "component", "left_anti"), "greedy-light")
        inside = light.count()
        dropped = dropped.unionByName(stored(_walk(light, F.pmod(F.xxhash64("component"), F.lit(max(parts, -(-inside // small))))), "greedy-out"))
        old, before = edges, left - inside
        edges = stored(tagged.join(large, "component", "left_semi").select("first", "second", "place"), "greedy-edges")
        discard(spark, *source_of(old), *source_of(tagged), *source_of(light), *source_of(large))
        # A row that is nobody's second is kept; its partners go, and with them their edges.
        heads = edges.select("first").distinct().join(edges.select(F.col("second").alias("first")).distinct(), "first", "left_anti")
        edges, left, out = _decide(edges, heads, None)
        dropped = dropped.unionByName(out)
        if left > max(small, SLOW * before):
            top = stored(edges.orderBy("place", "second").limit(small), "greedy-first")
            last = top.orderBy(F.desc("place"), F.desc("second")).first()
            end = F.struct(F.lit(last.place).cast(edges.schema["place"].dataType).alias("place"), F.lit(last.second).alias("second"))
            known = top.filter(F.struct("place", "second") < end)  # of the last row not all edges may have been taken
            gone = stored(_walk(known, F.lit(0)), "greedy-out")
            # Earlier rows than these are decided: all edges to them are known.
            kept = known.select("first").unionByName(known.select(F.col("second").alias("first"))).distinct().join(gone.withColumnRenamed("id", "first"), "first", "left_anti")
            edges, left, out = _decide(edges, kept, gone)
            dropped = dropped.unionByName(gone).unionByName(out)
    if left:
        rounds += 1
        dropped = dropped.unionByName(stored(_walk(edges, F.lit(0)), "greedy-out"))
    return dropped.distinct(), rounds


def _decide(edges: DataFrame, kept: DataFrame, gone: DataFrame | None) -> tuple[DataFrame, int, DataFrame]:
    """(edges between rows still undecided, how many, (id) of the partners of kept rows, which go): kept (first), gone (id)."""
    out = stored(edges.join(kept, "first").select(F.col("second").alias("id")).distinct(), "greedy-out")
    every = out if gone is None else out.unionByName(gone)
    lost = lambda k: every.withColumnRenamed("id", k)
    rest = stored(edges.join(lost("first"), "first", "left_anti").join(lost("second"), "second", "left_anti").join(kept, "first", "left_anti"), "greedy-edges")
    discard(edges.sparkSession, *source_of(edges))
    return rest, rest.count(), out
