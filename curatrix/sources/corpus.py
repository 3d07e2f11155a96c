"""Labelled corpora, result files and caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.storage import shared_dir

#: Accepted column pairs of a corpus file, as (label, text).
LAYOUTS = [("label", "text"), ("type", "posts")]


def as_corpus(df: DataFrame) -> DataFrame:
    """(label, text) without nulls, from either layout."""
    for label, text in LAYOUTS:
        if label in df.columns and text in df.columns:
            return df.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).dropna()
    raise ValueError(f"expected the columns {' or '.join(map(str, LAYOUTS))}, found {df.columns}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus from CSV (with header, quoted fields may span lines) or Parquet."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return as_corpus(df)


def read_split(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both parts of a corpus that comes split, with the column part."""
    return read_corpus(spark, train).withColumn("part", F.lit("train")).unionByName(read_corpus(spark, test).withColumn("part", F.lit("test")))


def read_overrides(spark: SparkSession, path: str | None) -> dict[str, dict]:
    """Settings by class from a JSON document, or a YAML one if the path ends so, at its top level or under "overrides"; {} without a path or if it isn't a map."""
    if not path:
        return {}
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    data = _yaml(text) if path.rstrip("/").endswith((".yaml", ".yml")) else json.loads(text)
    found = data.get("overrides", data) if isinstance(data, dict) else {}
    return found if isinstance(found, dict) else {}


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML overrides need the yaml package; give them as JSON") from e
    return yaml.safe_load(text)


def write_synthetic(df: DataFrame, path: str, header: bool = True) -> None:
    """Synthetic rows as CSV, all quality columns kept even where they are null."""
    df.write.mode("overwrite").csv(path, header=header, quote='"', escape='"', quoteAll=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics rows as JSON lines, nested columns and maps included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str, pattern: str = r"([A-Za-z]+[A-Za-z0-9_]*?)_s(\d+)(?:_(\d{8}))?") -> DataFrame:
    """Result JSON files as rows, with config, seed and date taken from the file's name."""
    df = spark.read.json(path, multiLine=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    part = lambda i: F.nullif(F.regexp_extract("file", pattern, i), F.lit(""))
    return df.withColumns({"config": part(1), "seed": part(2).cast("int"), "date": part(3)})


def compile_results(spark: SparkSession, root: str, categories: list[str]) -> DataFrame:
    """The results of several folders, with the column category."""
    out = None
    for c in categories:
        part = read_results(spark, f"{root.rstrip('/')}/{c}").withColumn("category", F.lit(c))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


class EmbeddingCache:
    """Vectors stored as Parquet under a key of source, split and model, in a folder that executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_dir(spark) + "/embedding-cache").rstrip("/")

    @staticmethod
    def key(source: str, model: str, seed: int, split: str, test_size: float, val_size: float | None = None) -> str:
        parts = [hashlib.md5(source.encode()).hexdigest()[:8], str(seed), split, f"{test_size:g}", re_safe(model)]
        return "_".join(parts + ([f"val{val_size:g}"] if val_size else []))

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def list(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def has(self, key: str) -> bool:
        fs, _ = self._fs()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}/_SUCCESS"))

    def save(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{key}")

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{key}")

    def get_or_compute(self, key: str, compute) -> DataFrame:
        if not self.has(key):
            self.save(key, compute())
        return self.load(key)

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path, True)

    def stats(self) -> dict:
        fs, path = self._fs()
        return {"entries": len(self.list()), "bytes": fs.getContentSummary(path).getLength() if fs.exists(path) else 0}


def re_safe(name: str) -> str:
    return "".join(c if c.isalnum() or c in "-." else "-" for c in name)
