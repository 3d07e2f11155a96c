import random
import re

import pytest

from curatrix.llm import jaccard_join
from curatrix.llm.jaccard_join import components, jaccard_components, keep_one, op5_jaccard_join


def brute(docs, n=3, num=9, den=10):
    def shingles(t):
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    s = {i: shingles(t) for i, t in docs}
    comp = {i: i for i in s}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and min(len(s[a]), len(s[b])) * den >= num * max(len(s[a]), len(s[b])) and len(s[a] & s[b]) * den >= num * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s[i]), root(i)) for i in s}


@pytest.mark.parametrize("num,den,hot", [(9, 10, 64), (6, 10, 3)])
def test_cases(spark, num, den, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
    r = random.Random(num)
    base = [[r.choice("abcdefghijklmnop") + str(r.randrange(9)) for _ in range(r.choice([2, 3, 8, 40, 90]))] for _ in range(9)]
    docs = []
    for i in range(170):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice("xyz") + str(r.randrange(50))
        docs.append((i, r.choice([" ", "\n"]).join(w).replace("a", r.choice("aA"))))
    docs += [(500, None), (501, ""), (502, " \t"), (503, "one"), (504, "ONE"), (505, "two words"), (506, "z " * 30_000), (507, "z Z z"), (508, "É é É"), (509, "é é é")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, rep string, n int").repartition(3)
    rows = jaccard_components(df, num=num, den=den).collect()
    assert len(rows) == len(docs)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == brute(docs, 3, num, den)


def test_edges(spark):
    df = spark.createDataFrame([(2, "a b c d")] * 2 + [(None, "a b c d"), (1, "a b c d"), (5, "q"), (5, "w")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in jaccard_components(df).collect()), key=repr)
    assert got == sorted([(2, 1), (2, 1), (None, None), (1, 1), (5, 5), (5, 5)], key=repr)
    assert sorted((x.doc_id or 0) for x in keep_one(df).collect()) == [0, 1, 5, 5]
    assert jaccard_components(df.limit(0)).count() == 0


def test_shared_identifiers(spark):
    """Rows are placed by their texts, not by their identifiers."""
    t = " ".join(f"w{i}" for i in range(60))
    docs = [(3, t), (5, t + " more"), (5, "quite another text of some words here"), (7, t + " more"), (7, "q r s t u v"), (7, "q r s t u v"), (9, "x " + t), (9, t + " y"), (None, t), (None, None), (11, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"gone": df_lit(1), "id": df_lit("x"), "hash": df_lit(2)})
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in jaccard_components(df).collect())
    assert got == sorted([(3, 58, 3), (5, 59, 3), (5, 5, 5), (7, 59, 3), (7, 4, 7), (7, 4, 7), (9, 59, 3), (9, 59, 3), (0, 58, 0), (0, 0, 0), (11, 0, 11)])
    kept = sorted((x.doc_id or 0, x.text or "") for x in keep_one(df).collect())
    assert kept == sorted([(3, t), (5, docs[2][1]), (7, "q r s t u v"), (7, "q r s t u v"), (0, t), (0, ""), (11, "")])
    assert keep_one(df).columns == df.columns
    # One identifier, several linked texts: the smallest hash stays.
    assert keep_one(spark.createDataFrame([(1, t), (1, t + " a"), (1, t + " b")], "doc_id long, text string")).count() == 1


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200)] + [(r.randrange(300, 320), r.randrange(300, 320)) for _ in range(12)]
    comp = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in comp.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in op5_jaccard_join(spark, sf).collect()} == brute(docs)
