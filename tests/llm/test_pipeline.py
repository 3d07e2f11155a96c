import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_leaks
from test_jaccard import brute as brute_near
from test_native import brute_lines

import corpus_pipeline
from curatrix.llm.byte_bpe import Codec

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, SF).write.parquet(at)
        out.append((docs, spark.read.parquet(at)))
        docs = out[-1][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(b.columns == a.columns for a, b in steps[:-1])


def test_quality(spark, steps):
    given, kept = map(rows, steps[0])
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(kept[i] == given[i] for i in kept)
    right = [(i in kept) == (q == 1) for i, q in label.items() if i in given]
    assert sum(right) / len(right) > 0.95
    assert sum(i not in kept for i, q in label.items() if q == 1 and i in given) <= 0.02 * len(label)


def test_lines(steps):
    given, kept = map(rows, steps[1])
    want = brute_lines([(i, r.text) for i, r in given.items()])
    assert {i: r.text for i, r in kept.items()} == {k[1]: t for k, (t, n) in want.items() if not n or t.strip(" ")}


def test_near_copies(steps):
    given, kept = map(rows, steps[2])
    want = brute_near([(i, r.text) for i, r in given.items()], 5, 8, 10)
    assert {*kept} == {i for i, (_, c) in want.items() if c == i} and len(kept) < len(given)


def test_contamination(spark, steps):
    given, kept = map(rows, steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {*given} - {*kept} == {d for d, _ in brute_leaks([(i, r.text) for i, r in given.items()], items)}


def test_tokens(steps):
    import public_tokenizers as P

    given, out = map(rows, steps[4])
    codec = Codec(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert {*given} == {*out}
    for i, r in out.items():
        assert r.round_trip and bytes(r.token_ids) == codec.encode(given[i].text) and r.n_tokens == len(r.token_ids) // 4


def test_run(spark, steps):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in steps[-1][1].collect()}


def test_stages_take_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a\nb\nc\n" * 3, "en", "s", None), (2, "a\nb\nc\n" * 3, "en", "s", None), (3, "w " * 40_000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for df in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            f(spark, df, SF).collect()
