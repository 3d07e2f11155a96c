"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts: U+0020 and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (local tests) a temporary one is made and set."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What stored() and bucketed() have written: path -> table's name, or None.
_WRITTEN: dict[str, str | None] = {}


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go once it is: nothing reads them again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors, and is computed once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = None
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """What the operators have written so far and not discarded."""
    return {*_WRITTEN}


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete such folders, with their tables. Results that haven't been computed yet read from them."""
    for path in paths:
        if path in _WRITTEN:
            if (name := _WRITTEN.pop(path)) is not None:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def source_of(df: DataFrame) -> set[str]:
    """The folder that stored() gave df."""
    return {p for p in _WRITTEN for f in df.inputFiles()[:1] if f"{p.split(':', 1)[-1].lstrip('/')}/" in f}


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until df has no column of that name in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """df's columns without those of such names, in any case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like stored(), in a table bucketed by key: joins on it don't move its rows. The table's files are in the shared folder too."""
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}"
    with _tidy(df.sparkSession):
        df.write.bucketBy(buckets or shuffle_partitions(df.sparkSession), key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    _WRITTEN[path] = name
    return df.sparkSession.table(name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a batch of very long texts stays small in a Python worker. The session keeps the setting: plans read it when they run."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The columns of those names as c0, c1, ..., then more: input of a function on Arrow batches, which can't name every column."""
    return df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(names)), *(c.alias(f"c{len(names) + i}") for i, c in enumerate(more)))
