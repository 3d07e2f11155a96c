import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm.common import written
from curatrix.llm.suffix_tree import _press, _unpress, op1_suffix_tree, score


def brute(docs, depth, least, mu, gain):
    """docs: [(id, learned from, text)]; the same model with plain dictionaries."""
    seqs = [(i, t, [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in (x or "").encode().split()] + [None]) for i, t, x in docs]
    c = Counter()
    for _, t, s in seqs:
        full = ["<b>", *s]
        if t:
            c[("<b>",)] += 1
            for p in range(1, len(full)):
                for n in range(min(depth, p) + 1):
                    c[tuple(full[p - n : p + 1])] += 1
    c_types = [k[0] for k in c if len(k) == 1 and k != ("<b>",)]
    total, types = sum(c[(k,)] for k in c_types), len(c_types)

    def chain(full, p, one):
        out = [(max(c[(full[p],)] - one, 0) + 0.1) / (total - one + 0.1 * (types + 1))]
        for n in range(1, min(depth, p) + 1):
            s = tuple(full[p - n : p])
            out.append((max(c[(*s, full[p])] - one, 0) + mu[min(n, len(mu)) - 1] * out[-1]) / (max(c[s] - one, 0) + mu[min(n, len(mu)) - 1]) if c[s] >= least else out[-1])
        return out

    follows = defaultdict(set)
    for k in c:
        if k != ("<b>",):
            follows[k[:-1]].add(k[-1])
    gains = defaultdict(float)
    for _, t, s in seqs:
        full = ["<b>", *s]
        for p in range(1, len(full)) if t else ():
            q = chain(full, p, 1)
            for n in range(1, len(q)):
                if len(follows[tuple(full[p - n + 1 : p])]) > 1:  # else the longer context can't diverge
                    gains[tuple(full[p - n : p])] += round(256 * (math.log(q[n]) - math.log(q[n - 1]))) / 256
    out = {}
    for i, _, s in seqs:
        full, base, best, known = ["<b>", *s], 0.0, 0.0, 0
        for p in range(1, len(full)):
            q = chain(full, p, 0)
            base += math.log10(q[0])
            known += c[(full[p],)] > 0
            best += math.log10(next(q[n] for n in range(len(q) - 1, -1, -1) if n == 0 or (c[tuple(full[p - n : p])] >= least and gains[tuple(full[p - n : p])] >= gain)))
        out[i] = (len(s), known, total, base, best)
    return out


def compare(rows, want):
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-6), (r, w)


def test_press():
    a, b = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)), np.arange(50, dtype=np.uint32)
    x, y = _unpress(_press(a, b), np.uint64, np.uint32)
    assert (x == a).all() and (y == b).all() and not len(_unpress(_press(a[:0]), np.uint64)[0])


@pytest.mark.parametrize("depth,size", [(2, 1 << 20), (3, 300), (1, 1), (6, 900), (4, 400)])
def test_cases(spark, depth, size):
    r = random.Random(depth)
    docs = [(i, i % 10 != 0, " ".join(r.choice(["a b c", "a", "B", "c d", "x y z w"]) for _ in range(r.randrange(12)))) for i in range(80)]
    docs += [(100, True, None), (101, True, ""), (102, False, "never seen"), (103, True, "é " * 9000)]
    df = spark.createDataFrame([(i, t, x, "n", 1) for i, t, x in docs], "doc_id long, t boolean, text string, block string, train int").repartition(3)
    rows = score(df, F.col("t"), depth=depth, least=2, mu=(3.0, 1.5), gain=1.0, block_bytes=size).collect()
    assert len(rows) == len(docs) and {r.doc_id: r.train for r in rows} == {i: t for i, t, _ in docs}
    compare(rows, brute(docs, depth, 2, (3.0, 1.5), 1.0))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    rows = score(df, F.col("doc_id") == 1).collect()
    assert sorted((r.n_tokens, r.train) for r in rows) == [(2, False), (3, True), (3, True)]
    none = score(df, F.lit(False)).collect()
    assert all(math.isclose(r.score, 0.0, abs_tol=1e-9) and r.n_known == 0 for r in none)  # one unseen type has all the root's share
    assert score(df.limit(0), F.lit(True)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10 != 0, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    from curatrix.llm.suffix_tree import DEPTH, GAIN, LEAST, MU

    rows = op1_suffix_tree(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    compare(rows, brute(docs, DEPTH, LEAST, MU, GAIN))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_cut_takes_time_by_its_hashes():
    import time

    import numpy as np

    from curatrix.llm.suffix_tree import _cut, _unpress

    uniq = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    for buckets in (1, 7, 4096, 1 << 31):
        parts = list(_cut(uniq, np.arange(5000, dtype=np.uint32), 2, 0, buckets))
        assert [p[1] for p in parts] == sorted({p[1] for p in parts}) and all(0 <= p[1] < buckets for p in parts)
        assert (np.concatenate([_unpress(p[3], np.uint64, np.uint32)[0] for p in parts]) == uniq).all()
        assert all(p[1] == int(x) * buckets >> 64 or p[1] == (int(x) >> 32) * buckets >> 32 for p in parts for x in _unpress(p[3], np.uint64, np.uint32)[0])
    began = time.time()
    assert len(list(_cut(uniq[::100], np.arange(50, dtype=np.uint32), 2, 0, 62_500))) == 50 and time.time() - began < 0.05
    assert list(_cut(uniq[:0], np.zeros(0, np.uint32), 2, 0, 9)) == []


def test_no_longer_grams_asked(spark):
    """Contexts of one word are judged in the last round, also where a round before has nothing to ask."""
    docs = [(i, i % 7 != 0, f"{'pq'[i % 2]} {'pq'[i % 2]}{i // 4}") for i in range(120)]
    rows = score(spark.createDataFrame(docs, "doc_id long, t boolean, text string"), F.col("t"), least=6, mu=(3.0, 1.5), gain=1.0, block_bytes=99).collect()
    compare(rows, brute(docs, 4, 6, (3.0, 1.5), 1.0))
    assert any(r.mean_depth > 0 for r in rows)


def test_stored_bytes(spark):
    """What stays on disk: token numbers in about as many bits as their frequencies need, no hashes of words."""
    n = np.random.default_rng(3)
    docs = [(i, True, " ".join(f"w{x}" for x in n.zipf(1.3, 2000) % 1_000_000)) for i in range(400)]
    before = written()
    score(spark.createDataFrame(docs, "doc_id long, t boolean, text string"), F.col("t")).collect()
    of = Counter(w for *_, x in docs for w in x.split())
    need = sum(c * math.log2(800_000 / c) for c in of.values()) / 8
    blocks = [p for p in written() - before if "lm_blocks" in p]
    assert sum(f.stat().st_size for p in blocks for f in Path(p.split(":", 1)[-1]).rglob("*.parquet")) < 1.25 * need and len(blocks) == 1
    assert not [p for p in written() - before if "lm_packed" in p]
