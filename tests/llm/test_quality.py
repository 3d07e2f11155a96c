import math
import zlib

import numpy as np
import pyarrow as pa

from curatrix.llm.quality import features, fit, op4_quality, score, train


def test_features():
    texts = ["a b a b", "", None, "Zz!! 12"]
    at, x, off = features(pa.array(texts), 10)
    for i in range(4):
        assert math.isclose((x[off[i] : off[i + 1]] ** 2).sum(), 1)
        one = features(pa.array(texts[i : i + 1], pa.string()), 10)
        assert (one[0] == at[off[i] : off[i + 1]]).all() and np.allclose(one[1], x[off[i] : off[i + 1]])
    assert off[2] - off[1] == off[3] - off[2] == 1


def test_fit_follows_the_update_rule():
    """One coordinate, by hand."""
    from curatrix.llm.quality import ALPHA, BETA, L1, L2

    z = n = w = 0.0
    labels = [1, 1, 0, 1, 1]
    for y in labels:
        w = 0.0 if abs(z) <= L1 else -(z - math.copysign(L1, z)) / ((BETA + math.sqrt(n)) / ALPHA + L2)
        g = 1 / (1 + math.exp(-w)) - y
        z += g - (math.sqrt(n + g * g) - math.sqrt(n)) / ALPHA * w
        n += g * g
    w = -(z - math.copysign(L1, z)) / ((BETA + math.sqrt(n)) / ALPHA + L2)
    got = fit([(np.array([3]), np.array([1.0]), y) for y in labels], 4, 1)
    assert math.isclose(got[3], w, rel_tol=1e-6) and not got[:3].any()


def test_cases(spark):
    rows = [(i, "good words here" if i % 2 else "BAD!! BAD!! BAD!!", i % 2, "x") for i in range(60)] + [(None, None, 1, "y"), (99, "", None, None), (98, "w " * 50_000, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, score string")
    w = train(df, bits=12)
    out = score(df, w).collect()
    assert len(out) == len(rows) and out[0].quality == 0
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in out[:60]) and all(0 < r.score < 1 for r in out)
    assert score(df.limit(0), w).count() == 0
    assert not train(df.filter("quality = 1"), bits=8).any() and not train(df.limit(0), bits=8).any()


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 80 and sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.93


def test_query_by_plain_dictionaries(spark, sf):
    """The whole query again: features by name, weights in dictionaries, one coordinate at a time."""
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from curatrix.llm.quality import ALPHA, BETA, BITS, EPOCHS, L1, L2, shape_hashes
    from curatrix.llm.wordhash import Words, buffers

    m64 = (1 << 64) - 1

    def mix(x):
        x &= m64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    pair = lambda a, b: mix((a * 0x2545F4914F6CDD1D + b & m64) + 2)
    seen = {}

    def of(word):
        if word not in seen:
            w = Words(*buffers(pa.array([word])))
            seen[word] = int(w.hashes()[0]), int(shape_hashes(w)[0])
        return seen[word]

    def vector(text):
        words = [of(w.decode()) for w in (text or "").encode().split()]
        near = list(zip(words, words[1:], strict=False))
        names = [(0, w) for w, _ in words] + [(1, s) for _, s in words] + [(2, pair(a[0], b[0])) for a, b in near] + [(3, pair(a[1], b[1])) for a, b in near] + [(4, mix(5 + (a[0] == b[0]))) for a, b in near]
        counts = Counter([0] + [mix(h + k) >> 64 - BITS for k, h in names])
        return {i: math.sqrt(c / sum(counts.values())) for i, c in counts.items()}

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.xxhash64("doc_id").alias("k")).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learn = [(vector(r.text), label[r.doc_id]) for r in sorted(docs, key=lambda r: r.k) if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= L1 else -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)
    for _ in range(EPOCHS):
        for x, y in learn:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / ALPHA * w[i]
                n[i] += g * g
    want = {r.doc_id: 1 / (1 + math.exp(-sum(weight(i) * v for i, v in vector(r.text).items()))) for r in docs}
    got = {r.doc_id: r.score for r in op4_quality(spark, sf).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-4) for i in want)
