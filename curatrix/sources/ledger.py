"""Generation that can be stopped and resumed: answers are rows of a table, keyed by the prompt's digest.

Requests are the distinct (prompt, temperature) of a table. They go out in waves; a wave's results, answers and
failures, are committed together as one Parquet folder. A restart reads the folders, skips requests that
have an answer or have used up their budget of calls, and goes on with the rest. At most the calls of the
wave that was running are made again; of several answers to a request the first attempt's counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.generators import Generator
from curatrix.sources.storage import shared_dir, stored

SCHEMA = "digest string, temperature double, attempt int, response string, error string, prompt_tokens long, completion_tokens long, seconds double"


class Ledger:
    """name: a run's folder. budget: calls a request may take over all restarts. tries: calls in a row within a wave, with waits that double from `wait` seconds."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None, budget: int = 6, tries: int = 2, wait: float = 0.5, longest: float = 30.0, concurrency: int = 25, wave: int = 10_000):
        self.spark, self.root = spark, f"{(root or shared_dir(spark) + '/ledger').rstrip('/')}/{name}"
        self.budget, self.tries, self.wait, self.longest, self.concurrency, self.wave = budget, tries, wait, longest, concurrency, wave

    def results(self) -> DataFrame:
        """All calls' results so far, of committed waves."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []
        paths = sorted(p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def answers(self) -> DataFrame:
        """(digest, temperature, response, prompt_tokens, completion_tokens, attempt) of answered requests, each once."""
        good = self.results().filter("error is null")
        first = F.min(F.struct("attempt", "response", "prompt_tokens", "completion_tokens")).alias("a")
        return good.groupBy("digest", "temperature").agg(first).select("digest", "temperature", "a.response", "a.prompt_tokens", "a.completion_tokens", "a.attempt")

    def pending(self, requests: DataFrame) -> DataFrame:
        """(digest, temperature, prompt, used): requests without an answer that have calls left, and how many they have used."""
        done = self.results().groupBy("digest", "temperature").agg(F.max("attempt").alias("used"), F.max(F.col("error").isNull()).alias("answered"))
        left = requests.join(done, ["digest", "temperature"], "left").filter(~F.coalesce("answered", F.lit(False)) & (F.coalesce("used", F.lit(0)) < self.budget))
        return left.select("digest", "temperature", "prompt", F.coalesce("used", F.lit(0)).alias("used"))

    def run(self, df: DataFrame, prompt: str, make: Callable[[], Generator], temperatures: tuple[float, ...] = (1.0,), waves: int | None = None) -> int:
        """Send out what is pending of df's prompts, wave by wave; the number of waves. waves: stop after so many."""
        every = df.filter(F.col(prompt).isNotNull()).select(F.sha2(F.col(prompt), 256).alias("digest"), F.col(prompt).alias("prompt")).dropDuplicates(["digest"])
        requests = stored(every.withColumn("temperature", F.explode(F.array(*(F.lit(float(t)) for t in temperatures)))), "requests")
        sent = 0
        while waves is None or sent < waves:
            now = stored(self.pending(requests), "pending")
            n = now.count()
            if not n:
                break
            some = now if n <= self.wave else now.filter(F.pmod(F.xxhash64("digest", "temperature", F.lit(sent)), F.lit(1 << 30)) < self.wave / n * (1 << 30))
            some.repartition("digest", "temperature").mapInPandas(self._calls(make), SCHEMA).write.parquet(f"{self.root}/{uuid.uuid4().hex}")
            sent += 1
        return sent

    def _calls(self, make: Callable[[], Generator]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        budget, tries, wait, longest, concurrency = self.budget, self.tries, self.wait, self.longest, self.concurrency

        def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make()

            def one(digest: str, temperature: float, text: str, used: int) -> tuple:
                began, error = time.time(), None
                last = min(budget, used + tries)
                for attempt in range(used + 1, last + 1):
                    try:
                        response, usage = client.generate(text, temperature)
                        return digest, temperature, attempt, response, None, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), time.time() - began
                    except Exception as e:  # the client's errors are its own
                        error = f"{type(e).__name__}: {e}"
                        if attempt < last:
                            time.sleep(min(longest, wait * 2 ** (attempt - used - 1)))
                return digest, temperature, last, None, error, 0, 0, time.time() - began

            with ThreadPoolExecutor(max(1, concurrency)) as pool:
                for b in batches:
                    rows = list(pool.map(one, b["digest"], b["temperature"], b["prompt"], b["used"].astype(int)))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        return calls

    def answered(self, df: DataFrame, prompt: str) -> DataFrame:
        """df's rows for each answered temperature of their prompt, with response, tokens and attempt; rows without an answer have null ones."""
        found = self.answers().withColumnRenamed("digest", "__digest")
        return df.join(found, F.sha2(F.col(prompt), 256) == F.col("__digest"), "left").drop("__digest")
