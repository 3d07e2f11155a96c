"""Vectors of texts, cached row by row under the digest of the text.

A cache is a folder with one folder a model; each append is a Parquet folder of its own, which
counts once its commit marker is there. So appends are atomic, a failed one leaves nothing that is
read, and writers don't wait for each other; of a text that two of them encoded one row is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.corpus import re_safe
from curatrix.sources.generators import encode
from curatrix.sources.storage import discard, shared_dir, source_of, stored

SCHEMA = "digest string, vector array<float>"
#: Tables of missing digests are broadcast up to so many bytes, at so many a row.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 128


class VectorCache:
    def __init__(self, spark: SparkSession, model: str, root: str | None = None):
        self.spark, self.root = spark, f"{(root or shared_dir(spark) + '/vector-cache').rstrip('/')}/{re_safe(model)}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def appends(self) -> list[str]:
        """The committed appends."""
        fs, path = self._fs()
        found = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))

    def _every(self) -> DataFrame:
        """(digest, vector) as appended; of texts that two writers encoded there are two rows."""
        paths = self.appends()
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """(digest, vector) of all cached texts, each once."""
        return self._every().dropDuplicates(["digest"]) if len(self.appends()) > 1 else self._every()

    def _needed(self, texts: DataFrame) -> tuple[DataFrame, int]:
        """((digest) of the distinct texts (text) that aren't cached, how many); texts stay where they are."""
        digests = texts.filter(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("digest")).distinct()
        need = stored(digests.join(self._every().select("digest"), "digest", "left_anti"), "vectors-missing")
        return need, need.count()

    def _texts(self, texts: DataFrame, need: DataFrame, n: int) -> DataFrame:
        """(digest, text) of the needed digests. A text travels once, and only needed ones do where the digests' table is small."""
        each = texts.filter(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("digest"), "text")
        return each.join(F.broadcast(need) if n * ROW_BYTES <= BROADCAST_BYTES else need, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))

    def missing(self, texts: DataFrame) -> DataFrame:
        """(digest, text) of the distinct texts (text) that aren't cached; only digests meet the cache."""
        return self._texts(texts, *self._needed(texts))

    def fill(self, df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list]], normalize: bool = True) -> int:
        """Encode and append what is missing of df's texts; how many texts that were. Nothing is written, and no text travels, if there is none."""
        texts = df.select(F.col(text).alias("text"))
        need, n = self._needed(texts)
        if n:
            encode(self._texts(texts, need, n), "text", make, "vector", normalize).select("digest", "vector").write.parquet(f"{self.root}/{uuid.uuid4().hex}")
        discard(self.spark, *source_of(need))
        return n

    def get(self, df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list]], out: str = "embedding", normalize: bool = True) -> DataFrame:
        """df with the vectors of its texts, encoded only where they aren't cached; a null text has none."""
        self.fill(df, text, make, normalize)
        known = self.rows().select(F.col("digest").alias("__digest"), F.col("vector").alias(out))
        # The digest is a column before the join, or the join would carry the text where nobody asks for it.
        return df.withColumn("__of", F.sha2(F.col(text), 256)).join(known, F.col("__of") == F.col("__digest"), "left").drop("__of", "__digest")

    def compact(self) -> None:
        """One append in place of all. The old ones go once the new one is there, so readers see each text at any time."""
        old = self.appends()
        if len(old) > 1:
            self.rows().write.parquet(f"{self.root}/{uuid.uuid4().hex}")
            fs, _ = self._fs()
            for p in old:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), True)

    def stats(self) -> dict:
        fs, path = self._fs()
        return {"texts": self.rows().count(), "appends": len(self.appends()), "bytes": fs.getContentSummary(path).getLength() if fs.exists(path) else 0}

    def clear(self) -> int:
        """Delete the model's vectors; how many appends there were."""
        n = len(self.appends())
        fs, path = self._fs()
        fs.delete(path, True)
        return n
