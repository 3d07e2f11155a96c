"""SimHash near-dedup by covering locality-sensitive hashing.

1. Every text becomes a 64-bit fingerprint: a bit is set if it is set in over half of the
   XXH64 hashes of the text's word shingles. Equal fingerprints collapse to one node.
2. Covering masks. Each bit position gets a class, a non-zero vector of radius + 1 bits; for
   every non-zero vector v the mask of table v keeps the positions whose class has an odd
   product with v. Positions in which two fingerprints differ have at most `radius` classes, and
   some v is orthogonal to all of them: so every pair within the radius agrees under the mask of some
   table, by construction and not by chance. With radius 2 that is 7 tables of 36 or 37 bits.
3. A pair that agrees in table v differs only in positions that v's mask leaves out. Nodes that
   share a bucket with another one send themselves and their variants with one such position
   flipped; nodes that meet in a variant are at most two flips apart, and every pair within two
   flips of each other meets. So a bucket of any size costs its members at most 65 rows each, a
   variant is met by at most 65 nodes, and no pairs of a bucket are made.
4. Nodes of a variant point to their smallest; components come from alternating stars.

Rows travel as identifier and fingerprint only, 16 bytes; buckets are counted with map-side
combining before they meet their nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored, table
from .jaccard_join import components
from .wordhash import pieces

BITS, SEED = 64, 42
#: Bytes of a text that are cut into words at a time.
CHUNK = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def masks(radius: int) -> list[int]:
    """The covering masks of 64-bit fingerprints, as signed 64-bit numbers: 2^(radius + 1) - 1 of them."""
    kinds = (1 << radius + 1) - 1
    out = [sum(1 << i for i in range(BITS) if ((1 + i % kinds) & v).bit_count() % 2) for v in range(1, kinds + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _words(raw: bytes, n: int) -> Iterator[list[bytes]]:
    """The words of raw in lists, each beginning with the last n - 1 words of the one before."""
    at, carry = 0, []
    while at < len(raw):
        cut = _SPACE.search(raw, at + CHUNK)
        end = cut.start() if cut else len(raw)
        words = carry + raw[at:end].split()  # bytes.split() parts at U+0020 and U+0009 to U+000D
        yield words
        carry, at = words[-(n - 1) :] if n > 1 else [], end


def fingerprint(raw: bytes, n: int) -> int:
    """The fingerprint of a text in UTF-8, A-Z lower-cased; signed."""
    counts, total = np.zeros(BITS, np.int64), 0
    words: list[bytes] = []
    for words in _words(raw, n):
        if len(words) >= n:
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(size) - 1
            joined = b" ".join(words)
            digest = xxhash.xxh64_intdigest
            h = np.array([digest(joined[i:j], SEED) for i, j in zip((ends - size + 1)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)
            counts += _bit_counts(h)
            total += len(h)
    if not total and words:
        counts, total = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)), 1
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    each = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
    return (each @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)).reshape(-1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(id long, fp long) of each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            fps = [fingerprint(t.encode().lower() if t else b"", n) for t in b.column(1).to_pylist()]  # bytes.lower() knows A-Z only
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    small_batches(df.sparkSession)
    return df.select(quoted(id_col).cast("long").alias("id"), quoted(text).alias("text")).mapInArrow(run, "id long, fp long")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints (fp) of nodes whose components are those of all pairs within the radius."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(~m).alias("free"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))))
    posts = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.*")
    shared = posts.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    met = posts.join(shared, ["t", "key"]).groupBy("fp").agg(F.bit_or("free").alias("free"))
    at = F.filter(F.array(*map(F.lit, range(BITS))), lambda i: F.call_function("bit_get", F.col("free"), i) == 1)
    variants = F.concat(F.array("fp"), F.transform(at, lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    groups = met.select("fp", F.explode(variants).alias("y")).groupBy("y").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    if radius == 1:  # one flip apart: from the variant itself, where it is a node, to the others
        groups = groups.filter(F.array_contains("fps", F.col("y"))).withColumn("a", F.col("y"))
    else:
        groups = groups.withColumn("a", F.array_min("fps"))
    return groups.select("a", F.explode("fps").alias("b")).filter("a <> b").distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of df: id_col (long), fingerprint string (16 hex digits), component_id long.

    A-Z are lower-cased; words are runs of characters other than U+0020 and U+0009 to U+000D;
    shingles are n words joined by one space, repeats included; a text under n words is one
    shingle, one without words and a null one have the fingerprint zero, which links like any
    other. Fingerprints link at `radius` (0 to 2) or fewer differing bits; component_id is the
    smallest identifier reachable by links, itself included. A null identifier links like
    others but names a component only where there is no other (component_id is null then).
    Repeated rows and rows that share an identifier get their own text's answer each. An empty
    table gives an empty result. Other columns of df are ignored.
    """
    if radius not in (0, 1, 2):
        raise ValueError(f"radius: {radius}")
    rows = stored(fingerprints(df, id_col, text, n), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    named = nodes.select("fp", F.col("id").alias("component_id"))
    if radius:
        comps = components(links(nodes, radius)).withColumnRenamed("node", "fp")
        known = stored(comps.join(nodes, "fp"), "simhash-linked")
        least = known.groupBy("component").agg(F.min("id").alias("least"))
        linked = known.join(least, "component").select("fp", "least", F.lit(True).alias("linked"))
        named = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    return rows.join(stored(named, "simhash-named"), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
