"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size M: slot
(offset + j * skip) mod M for j = 0, 1, ...; M prime makes it a permutation. Shards take
turns, each claiming its first preferred slot still free, until the table is full; a shard
of weight w claims w times a turn. A key's slot is its hash modulo M, so placement is one
lookup in the broadcast table, with no shuffle. Adding or removing a shard moves few keys
beyond its own. The table is filled on the driver: its size M is a parameter, at most
MAX_SLOTS, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted, table, unused

SLOTS, MAX_SLOTS = 65_537, 1_000_003
#: The shards of the registered query; one has double weight.
SHARDS = {f"shard-{i:03d}": 2 if i == 0 else 1 for i in range(120)}


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. Shards: names, in the order of their turns, or name -> weight."""
    weights = list(shards.values()) if isinstance(shards, Mapping) else [1] * len(shards)
    names = list(shards)
    if not _prime(slots) or slots > MAX_SLOTS or not 0 < sum(weights) <= slots or min(weights) < 1 or len({*names}) < len(names):
        raise ValueError("slots must be a prime up to MAX_SLOTS, no less than the weights' sum; names distinct, weights positive")
    digest = [int.from_bytes(hashlib.sha256(n.encode()).digest()[:16], "big") for n in names]
    at, skip = [d % slots for d in digest], [(d >> 64) % (slots - 1) + 1 for d in digest]
    entry, left = [-1] * slots, slots
    while True:
        for i, w in enumerate(weights):
            for _ in range(w):
                while entry[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                entry[at[i]] = i
                left -= 1
                if not left:
                    return entry


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo slots; null counts as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> DataFrame:
    """df with the columns slot int and shard string; columns of those names are replaced.

    Equal keys go to one shard; a null key counts as the empty text, so it and '' share one.
    Every row is kept, repeated ones too. An empty table stays empty.
    """
    names, entry = list(shards), fill(shards, slots)
    lookup = F.split(F.lit(",".join(map(str, entry))), ",")
    at, name = unused(df, "__slot", "__shard")
    claimed = df.sparkSession.range(0, slots, 1, 1).select(
        F.col("id").cast("int").alias(at), F.element_at(F.split(F.lit(",".join(names)), ","), F.element_at(lookup, F.col("id").cast("int") + 1).cast("int") + 1).alias(name)
    )
    keep = [quoted(c) for c in others(df, "slot", "shard")]
    placed = df.withColumn(at, slot_of(quoted(key), slots))
    return placed.join(F.broadcast(claimed), at).select(*keep, F.col(at).alias("slot"), F.col(name).alias("shard"))


def op2_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every document by its identifier, with its text's length (bytes) for balance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return shard(docs, "doc_id", SHARDS)


OP2_SQL = f"""
WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, n_bytes, slot, 'shard-' || lpad(string_split('{",".join(map(str, fill(SHARDS)))}', ',')[slot + 1], 3, '0') AS shard FROM h
"""
