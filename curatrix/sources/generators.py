"""Text generators and encoders as injected functions.

A generator is any object with generate(prompt, temperature) -> (text, usage). It is called on
executors, one partition at a time, with retries; nothing here opens a network connection.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    def generate(self, prompt: str, temperature: float = 1.0) -> tuple[str, dict]: ...


class EchoGenerator:
    """A stand-in that needs no model: its lines depend on the prompt and the temperature alone."""

    def __init__(self, lines: int = 3):
        self.lines = lines

    def generate(self, prompt: str, temperature: float = 1.0) -> tuple[str, dict]:
        h = hashlib.md5(f"{prompt}/{temperature:g}".encode()).hexdigest()
        text = "\n".join(f"{i + 1}. text {h[i * 4 : i * 4 + 8]} of some words" for i in range(self.lines))
        return text, {"prompt_tokens": len(prompt.split()), "completion_tokens": len(text.split())}


#: Generators by name; register() adds to it.
FACTORIES: dict[str, Callable[..., Generator]] = {"echo": EchoGenerator}


def register(name: str, factory: Callable[..., Generator]) -> None:
    FACTORIES[name] = factory


def create(name: str, **options) -> Generator:
    if name not in FACTORIES:
        raise ValueError(f"no generator {name!r}; known: {sorted(FACTORIES)}")
    return FACTORIES[name](**options)


def generate(df: DataFrame, prompt: str, make: Callable[[], Generator], temperatures: tuple[float, ...] = (1.0,), retries: int = 3, wait: float = 0.5, concurrency: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Rows of df (columns keep) for each temperature with response, error, prompt_tokens, completion_tokens and attempts.

    make builds a generator once per partition. A failing call is repeated up to `retries`
    times with growing waits, then reported in error with a null response. concurrency: calls
    in flight per partition.
    """
    kept = [c for c in (keep or df.columns) if c != prompt] if keep else [c for c in df.columns if c != prompt]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def call(job: tuple[str, float]) -> tuple:
            for attempt in range(1, retries + 1):
                try:
                    text, usage = client.generate(*job)
                    return text, None, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), attempt
                except Exception as e:  # the client's errors are its own
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(wait * (2 ** (attempt - 1)) if attempt < retries else 0)
            return None, error, 0, 0, retries

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for p in batches:
                for t in temperatures:
                    found = list(pool.map(call, [(x, t) for x in p[prompt]]))
                    out = p[kept].reset_index(drop=True)
                    out["temperature"] = t
                    out[["response", "error", "prompt_tokens", "completion_tokens", "attempts"]] = pd.DataFrame(found, columns=["response", "error", "prompt_tokens", "completion_tokens", "attempts"])
                    yield out

    schema = ", ".join(filter(None, [cols, "temperature double, response string, error string, prompt_tokens long, completion_tokens long, attempts int"]))
    return df.select(*kept, prompt).mapInPandas(run, schema)


def candidates(responses: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, pos, text): distinct cleaned lines of the responses of each key, over temperatures in their order, at most so many."""
    from pyspark.sql import Window

    from curatrix.functions import text as T

    lines = responses.select(*keys, "temperature", F.posexplode(T.response_lines(F.col("response"), 1000)).alias("__i", "line")).withColumn("text", T.strip_number(F.col("line")))
    first = Window.partitionBy(*keys, "text").orderBy("temperature", "__i")
    once = lines.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return once.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("temperature", "__i"))).filter(F.col("pos") <= most).select(*keys, "pos", "text")


def encode(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list]], out: str = "embedding", normalize: bool = True) -> DataFrame:
    """df with vectors of an injected encoder (texts -> vectors), built once per worker and called by Arrow batch; unit length unless normalize is False."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = make()
        for s in batches:
            v = np.asarray(model(s.fillna("").tolist()), np.float64)
            if normalize and len(v):
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v.astype(np.float32)))

    return df.withColumn(out, run(F.col(text)))


def generation_log(responses: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failures and tokens by group."""
    return responses.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
