import random
from collections import defaultdict

import numpy as np
import pytest
from oracle import assert_same

from curatrix.llm.exact_dedup import exact_dedup
from curatrix.llm.line_dedup import line_dedup
from curatrix.llm.quality import score
from curatrix.llm.registry import ORACLES, QUERIES
from curatrix.llm.sharding import fill, shard

S = "doc_id long, text string, __n string, slot int"


@pytest.mark.parametrize("name", ["op2_shard_lookup", "op9_line_dedup", "op10_exact_dedup"])
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_exact_dedup_cases(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["A", "a", "b" * 9000, "", None, "é", "É", "a "]), "x", 1) for i in range(300)] + [(None, "a", None, None), (7, "same", "", 0), (7, "same", "", 0), (None, "alone", "", 0)]
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    for keep, pick, hot in (("smallest", min, 2), ("largest", max, 10_000)):
        out = exact_dedup(spark.createDataFrame(rows, S), keep=keep, hot_rows=hot, salts=3).collect()
        assert len(out) == len(rows)
        want = sorted(((i, pick((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=repr)
        assert sorted(((x.doc_id, x.keep_id, x.group_size) for x in out), key=repr) == want
        assert all(x.kept == (x.doc_id == x.keep_id) for x in out)
    assert exact_dedup(spark.createDataFrame([], S)).count() == 0


def brute_lines(rows, n=3):
    docs, first = {(i is not None, i or 0, t): t for i, t in rows if t is not None}, {}
    import hashlib

    at = sorted(((k[0], k[1], hashlib.md5(k[2].encode()).hexdigest()), k) for k in docs)
    strip = lambda x: x.strip("\t\n\x0b\x0c\r ")
    wins = [(tuple(map(strip, t.split("\n")[p : p + n])), k, p) for k, t in ((k, docs[k]) for _, k in at) for p in range(len(t.split("\n")) - n + 1)]
    for w, k, p in wins:
        first.setdefault(w, (k, p))
    gone = defaultdict(set)
    for w, k, p in wins:
        if len("\n".join(w)) >= n and first[w] != (k, p):
            gone[k] |= {*range(p, p + n)}
    return {k: ("\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]), len(gone[k])) for k, t in docs.items()}


def test_line_dedup_cases(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["a", "b", "", " a ", "c\t"]) for _ in range(r.randrange(12)))) for i in range(80)]
    rows += [(90, None), (91, ""), (None, "a\nb\na\nb\na\nb"), (5, "x\ny\nz\nw"), (5, "x\ny\nz\nw"), (5, "x\ny\nz"), (92, "a\n" * 5000)]
    df = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], S)
    for hot in (0, 1000):
        out = line_dedup(df, hot_rows=hot).collect()
        assert len(out) == len(rows)
        want = brute_lines(rows)
        got = sorted(((x.doc_id, x.text or "", x.n_removed) for x in out), key=repr)
        assert got == sorted(((i, *((t or "", 0) if t is None else want[(i is not None, i or 0, t)])) for i, t in rows), key=repr)
        assert {x.text for x in out if x.doc_id == 90} == {None} and out[0].slot == 3
    assert line_dedup(df.limit(0)).count() == 0


NAMES = ["__key", "__raw", "__m2", "__gone", "__id", "__m", "__k", "__h", "__w", "__lines", "__slot", "__shard", "__text", "__TEXT", "id", "raw", "h", "salt", "head", "best", "size", "sha", "keep", "total", "N_LINES", "n_removed", "a.b", "Score", "slot", "ids_sha256"]


@pytest.mark.parametrize("name", NAMES)
def test_no_name_clashes(spark, name):
    rows = [(1, "a\nb\nc\nd", "x"), (2, "A\na\nb\nc", None), (None, None, "y")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string")
    assert sorted(r.n_removed for r in line_dedup(df).collect()) == [0, 0, 3]
    assert exact_dedup(df).count() == 3 and shard(df, "doc_id", ["p", "q"], 7).count() == 3
    assert [r[-1] for r in score(df, np.zeros(16, np.float32)).collect()] == [0.5] * 3
    given = {str(r[0]): r[2] for r in df.collect()}
    if name not in ("N_LINES", "n_removed", "slot"):
        for out in (line_dedup(df), shard(df, "doc_id", ["p", "q"], 7)):
            assert {str(r.doc_id): r[name] for r in out.collect()} == given


def test_shards(spark):
    names = [f"s{i}" for i in range(20)]
    a, b = fill(names, 1009), fill(names[:-1], 1009)
    sizes = [a.count(i) for i in range(20)]
    assert max(sizes) - min(sizes) <= 1
    assert sum(x != y and x != 19 for x, y in zip(a, b, strict=True)) < 0.25 * 1009
    heavy = fill({"x": 3, "y": 1}, 101)
    assert heavy.count(0) in (75, 76)
    for bad in (([], 7), (names, 15), (["a", "a"], 7), ({"a": 0}, 7)):
        with pytest.raises(ValueError):
            fill(*bad)
    df = spark.createDataFrame([(i, "t", "q", 1) for i in [*range(50), None, 3]], S)
    out = shard(df, "doc_id", names, 1009).collect()
    assert len(out) == 52 and all(x.shard == names[a[x.slot]] for x in out) and len({x.shard for x in out if x.doc_id == 3}) == 1
    assert shard(df.limit(0), "doc_id", names, 1009).count() == 0
