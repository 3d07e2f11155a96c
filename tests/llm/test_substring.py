import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from curatrix.llm import substring_dedup as S
from curatrix.llm.substring_dedup import op6_substring_dedup, substring_dedup
from curatrix.llm.wordhash import Words, buffers, pieces


def brute(docs, window=20):
    """docs: [(id, text)] with distinct identifiers."""
    words = {i: (t or "").encode().split() for i, t in docs}
    first, out = {}, {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (i, s)) != (i, s):
                gone |= {*range(s, s + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_words():
    texts = ["a b", None, "", "  x\ty z ", "end", "end"]
    arr = pa.array(texts)
    data, off = buffers(arr)
    w = Words(data, off)
    got = [bytes(data[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)]
    assert got == [x.decode() for t in texts for x in (t or "").encode().split()]
    h = w.hashes()
    assert h[-1] == h[-2] and len(np.unique(h)) == len(h) - 1 and not (w.hashes(1) == h).any()
    b = pa.RecordBatch.from_arrays([arr], names=["t"])
    assert [x for p in pieces(iter([b, b.slice(2)]), 0, 3) for x in p.column(0).to_pylist()] == texts + texts[2:]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, sf).collect()}
    assert got == brute(docs) and sum(x[1] for x in got.values())


@pytest.mark.parametrize("window,mer", [(5, 2), (4, 4), (6, 1)])
def test_cases(spark, window, mer):
    r = random.Random(window)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "q " * 3000), (103, "\n".join(["a b c a b c d"] * 9)), (-5, "a b c a b c"), (104, "é" * 70_000 + " a b c a b c")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, start string, row int").repartition(3)
    for size in (1 << 20, 64):
        got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in substring_dedup(df, window=window, mer=mer, bucket_bytes=size).collect()}
        assert got == brute(docs, window)
    same = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(None, "a b c d e f g h"), (2, "x")], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.n_removed) for x in substring_dedup(same, window=window, mer=mer).collect())
    assert got == [(-1, 0), (1, 7), (1, 7), (1, 7), (2, 0)]
    assert substring_dedup(df.limit(0)).count() == 0


def test_a_phrase_in_every_text_is_split(spark):
    """Texts with nothing in common but four words of low hash: their strings share a minimiser."""
    r = random.Random(8)
    low = min((tuple(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(4)) for _ in range(20_000)), key=lambda w: int(S.ngrams(Words(*buffers(pa.array([" ".join(w)]))).hashes(), 4)[0]))
    docs = [(i, " ".join([*(f"u{r.randrange(10**9)}" for _ in range(25)), *low, *(f"u{r.randrange(10**9)}" for _ in range(25))])) for i in range(3000)]
    docs += [(5000 + i, docs[i][1] + " z") for i in range(0, 3000, 100)]
    df = spark.createDataFrame([(i, 0, t) for i, t in docs], "doc long, row long, text string").repartition(8)
    size = sum(len(t) for _, t in docs)
    buckets, meant = 16, size // 16
    hot = S.hot_buckets(df, 20, 4, buckets, meant)
    assert len(hot.which) >= 1 and hot.parts.max() > 3

    def most(hot):
        packed = df.mapInArrow(lambda it: S._map(it, 20, 4, hot), "bucket long, packed binary, strings boolean, cover binary")
        held = {}
        for x in packed.filter("packed is not null").collect():
            y = S._unpack(x.packed, S._PACKED if x.strings else S._WINDOWS)
            held[x.bucket] = held.get(x.bucket, 0) + (len(y["text"]) if x.strings else 20 * len(y["doc"]))
        return max(held.values())

    whole = most(S.Hot(buckets, np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert whole > 3 * S.HOT * meant and most(hot) <= S.HOT * meant
    got = {x.doc_id: x.n_removed for x in substring_dedup(df.withColumnRenamed("doc", "doc_id"), bucket_bytes=meant).collect()}
    assert got == {i: x[1] for i, x in brute(docs).items()}


def test_earliest():
    r = np.random.default_rng(4)
    for two in (np.zeros(400, np.uint64), r.integers(0, 3, 400).astype(np.uint64)):
        x = {"doc": r.integers(0, 9, 400), "row": r.integers(0, 2, 400), "start": r.integers(0, 30, 400).astype(np.int32), "one": r.integers(0, 40, 400).astype(np.uint64), "two": two}
        place = list(zip(x["doc"].tolist(), x["row"].tolist(), x["start"].tolist(), strict=True))
        key = list(zip(x["one"].tolist(), x["two"].tolist(), strict=True))
        first = {k: min(p for p, q in zip(place, key, strict=True) if q == k) for k in key}
        sent, again = S._earliest(x)
        assert [i for i in range(400) if place[i] != first[key[i]]] == again.tolist()
        assert sorted(key[i] for i in sent) == sorted(first) and all(place[i] == first[key[i]] for i in sent)
