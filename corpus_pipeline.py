"""A pipeline over the documents: quality, line dedup, near copies, contamination, tokens.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that the stage before
kept; stages before the last return the columns of documents. ``run`` applies them, writing
each result as Parquet in the shared folder and reading it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.byte_bpe import byte_bpe
from curatrix.llm.common import discard, quoted, source_of, stored, table, unused, written
from curatrix.llm.decontaminate import decontaminate
from curatrix.llm.jaccard_join import keep_one
from curatrix.llm.line_dedup import line_dedup
from curatrix.llm.quality import score, train, training_rows


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*map(quoted, docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score 0.5 or more); it learns from the labels of the documents given.

    Null and empty texts have the intercept's score. Without labels of both kinds, as with an
    empty table, every score is 0.5 and all stay. Repeated rows share one verdict.
    """
    weights = train(training_rows(docs, table(spark, sf_dir, "labels"), held_out=False))
    (name,) = unused(docs, "score")
    return _columns(score(docs, weights, out=name).filter(quoted(name) >= 0.5), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line passages; a document of which nothing is left goes, n_chars is counted again.

    Null, empty and short texts stay as they are. Rows with equal identifier and text don't
    repeat each other. Of equal passages the one of the smallest identifier, then place, stays.
    """
    thin = line_dedup(docs).filter("n_removed = 0 or length(trim(text)) > 0")
    return _columns(thin.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest identifier.

    Rows without words or identifier stay. Rows with equal identifier and text share one verdict;
    rows that share only the identifier are told apart by their texts.
    """
    return _columns(keep_one(docs, n=5, num=8, den=10), docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; without a benchmark all stay. Repeated rows share one verdict.
    """
    return _columns(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document (packed unsigned 32-bit integers), their number and digest.

    A null or empty text has no token. Every row has a result, repeated ones too.
    """
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return byte_bpe(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("contamination", contamination), ("tokens", tokens)]

#: The classifier, the contamination check and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages after each other over documents. What a stage has written for itself goes once its result is stored, and that once the next one's is."""
    docs, held = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *(written() - held - source_of(docs)))
    return STAGES[-1][1](spark, docs, sf_dir)
