"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders that the operators of this thread's scope have written.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, in local mode, a temporary folder is made and set."""
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="curatrix-"))
    return context.getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again: lineage is cut and executors may be lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_of(df: DataFrame) -> list[str]:
    """The folders of the files that a stored table reads."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete such folders of the shared folder. Results that haven't been computed yet read from them."""
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for path in paths:
        if not path.split(":", 1)[-1].lstrip("/").startswith(root.rstrip("/") + "/"):
            raise ValueError(f"not in the shared folder: {path}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators store within goes at the end: write their result, or collect it, before. Other threads' tables stay."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        discard(spark, *mine)
