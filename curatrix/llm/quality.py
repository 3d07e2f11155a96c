"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

Features are the word 1-grams and 2-grams of a text, hashed to 2^BITS weights; the value of
each is the square root of its share of the text's n-grams, so every text has length 1. Words are kept in two forms, as they are and as a
shape (letters, upper-case, digits, marks), so that words never seen in training still say
something. Training is a follow-the-regularised-leader pass over the labelled sample, a few
epochs, in one task: the sample is bounded by `sample` rows (a parameter; smallest hash of the
identifier first), so that task does not grow with the data. Scoring is a narrow map: the
weights (4 bytes x 2^BITS, fixed) are broadcast and a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, others, quoted, small_batches, table
from .wordhash import Words, buffers, mix, ngrams, pieces

BITS = 20
SAMPLE = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1


def _shapes() -> np.ndarray:
    """Class of each byte: marks by themselves, others by kind."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 97, 65, 48, 97
    return out


SHAPES = _shapes()


def shape_hashes(words: Words) -> np.ndarray:
    """Hash of each word's shape: its byte classes without repeats next to each other."""
    kinds = SHAPES[words.data]
    n = words.ends - words.starts
    last = kinds[words.ends - 1].astype(np.uint64)
    first = kinds[words.starts].astype(np.uint64)
    change = np.zeros(len(kinds) + 1, np.int64)
    change[2:] = np.cumsum(kinds[1:] != kinds[:-1])
    changes = change[words.ends] - change[words.starts + 1]
    marks = np.zeros(len(kinds) + 1, np.int64)
    marks[1:] = np.cumsum(~np.isin(kinds, (97, 65, 48)))
    odd = marks[words.ends] - marks[words.starts]
    return mix(((first * 256 + last) * 16 + np.minimum(changes, 15).astype(np.uint64)) * 8 + np.minimum(odd, 4).astype(np.uint64) + (n == 1) * np.uint64(1 << 40))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices of each text (distinct, ascending), concatenated, their values, and offsets."""
    data, offsets = buffers(column)
    words = Words(data, offsets)
    h, s = words.hashes(), shape_hashes(words)
    pair = words.doc[1:] == words.doc[:-1] if len(words) else np.zeros(0, bool)
    same = mix((h[1:] == h[:-1])[pair].astype(np.uint64) + np.uint64(5)) if len(words) else h
    parts = [(h, words.doc), (s, words.doc), (ngrams(h, 2)[pair], words.doc[1:][pair]), (ngrams(s, 2)[pair], words.doc[1:][pair]), (same, words.doc[1:][pair])] if len(words) else []
    count = len(offsets) - 1
    every = [np.arange(count, dtype=np.int64) << bits]  # index 0: the intercept
    every += [doc.astype(np.int64) << bits | (mix(x + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k, (x, doc) in enumerate(parts)]
    keys, times = np.unique(np.concatenate(every), return_counts=True)
    off = np.searchsorted(keys, np.arange(count + 1, dtype=np.int64) << bits)
    total = np.add.reduceat(times, off[:-1]) if count else times
    return keys & ((1 << bits) - 1), np.sqrt(times / np.repeat(total, np.diff(off))), off


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (feature indices, values, label 0 or 1), in the order given; the weights."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    w = np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in examples:
            wi = weights(at)
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * wi
            n[at] += g * g
    w[:] = weights(np.arange(1 << bits))
    return w.astype(np.float32)


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most `sample` rows with a label of 0 or 1, those with the smallest hash of identifier.

    Rows of one label or none, and an empty table, give zero weights (score 0.5). Null texts
    count as empty, very long ones are whole; rows without a label of 0 or 1 are left out,
    repeated ones count as often as they come. Ties of the hash go by label, then text.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.xxhash64(id_col).alias("k"), F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    keyed = rows.orderBy("k", "y", F.xxhash64("t")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in pieces(batches, 2):
            at, x, off = features(b.column(2), bits)
            found += [(k, at[i:j].astype(np.int32), x[i:j].astype(np.float32), y) for i, j, k, y in zip(off[:-1], off[1:], b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        found.sort(key=lambda x: x[0])
        w = fit([x[1:] for x in found], bits, epochs) if {x[3] for x in found} == {0, 1} else np.zeros(1 << bits, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    found = keyed.coalesce(1).mapInArrow(run, "w binary").first()
    return np.frombuffer(found[0], np.float32) if found else np.zeros(1 << bits, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """df with the column `out` double, the chance that the text's label is 1.

    A column of that name is replaced. A null text counts as empty; empty texts get the
    intercept's score. Repeated rows get equal scores; an empty table stays empty.
    """
    spark = df.sparkSession
    small_batches(spark)
    bits = len(weights).bit_length() - 1
    given = spark.sparkContext.broadcast(weights)
    kept = others(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, len(kept)):
            at, x, off = features(b.column(len(kept)), bits)
            total = np.add.reduceat(given.value[at] * x, off[:-1])
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(p)], names=[*kept, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*(df.schema[c] for c in kept), StructField(out, DoubleType())])
    return numbered(df, kept, quoted(text)).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, held_out: bool = True) -> DataFrame:
    """The labelled rows of docs to learn from, without those held out, already cut to `sample` so that the join moves only their texts."""
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias(label)).dropna().dropDuplicates(["doc_id"])
    if held_out:
        known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    few = known.orderBy(F.xxhash64("doc_id")).limit(sample)  # bounded by the parameter, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(training_rows(docs, table(spark, sf_dir, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    out = score(docs, weights)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
