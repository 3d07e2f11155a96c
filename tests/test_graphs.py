import random

import pytest

from curatrix.operators import dedup as D
from curatrix.operators import graphs as G
from curatrix.operators.ranks import quantiles


def walk(n, pairs, place=lambda i: i):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept = set()
    for i in sorted(range(n), key=lambda i: (place(i), i)):
        if not near.get(i, set()) & kept:
            kept.add(i)
    return kept


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        comp[y] = x
    got = {x.node: x.component for x in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("small,order", [(1_000_000, "o"), (1_000_000, None), (45, "o")])
def test_greedy_equals_walk(spark, small, order):
    r = random.Random(small)
    n = 220
    pairs = [(i, i + 1) for i in range(60)] + [(a, b) for a, b in ((r.randrange(60, 140), r.randrange(60, 140)) for _ in range(90)) if a != b] + [(200, i) for i in range(140, 200)] + [(3, 3)]
    pairs += [(b, a) for a, b in pairs[::7]]
    nodes = spark.createDataFrame([(i, (i * 37) % 5 if i % 9 else None) for i in range(n)], "id long, o long")
    out = D.greedy_keep(nodes, spark.createDataFrame(pairs, "a long, b long"), "id", order, small=small).collect()
    place = (lambda i: -1 if i % 9 == 0 else (i * 37) % 5) if order else (lambda i: 0)
    assert {x.id for x in out if x.kept} == walk(n, [p for p in pairs if p[0] != p[1]], place) and len(out) == n


@pytest.mark.parametrize("small", [1_000_000, 6_000])
def test_long_chain_in_few_rounds(spark, small):
    chain = spark.range(10_000).selectExpr("id as first", "id + 1 as second", "0 as place")
    gone, rounds = G.greedy_dropped(chain, small)
    assert sorted(x.id for x in gone.collect()) == list(range(1, 10_001, 2)) and rounds < 30


def exact_quantile(values, q):
    values = sorted(values, key=lambda x: (x != x, x))
    at = q * (len(values) - 1)
    lo, hi = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return lo if at == int(at) or lo == hi else lo + (at - int(at)) * (hi - lo)


@pytest.mark.parametrize("small,bins", [(10_000, 1024), (20, 4), (0, 2)])
def test_quantiles(spark, small, bins):
    r = random.Random(9)
    groups = {
        "normal": [r.gauss(0, 1) for _ in range(400)], "ties": [float(r.randrange(3)) for _ in range(300)], "one": [7.5], "same": [2.0] * 90, None: [r.random() * 1e300 * r.choice([-1, 1]) for _ in range(120)],
        "skewed": [10.0 ** r.randrange(-300, 300) for _ in range(150)], "ends": [float("-inf")] * 30 + [1.0, 2.0, 3.0] * 20 + [float("inf")] * 15 + [float("nan")] * 5,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0, "f": 0.333}
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted, small, bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["__n"] == len(vs)
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(exact_quantile(vs, q), rel=1e-12, nan_ok=True), (g, name)
    every = quantiles(spark.createDataFrame(rows, "g string, v double").filter("v is not null and not isnan(v)"), [], "v", {"m": 0.5}, small, bins).collect()
    assert every[0].m == pytest.approx(exact_quantile([v for vs in groups.values() for v in vs if v == v], 0.5), rel=1e-12)
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", wanted).count() == 0


@pytest.mark.parametrize("head,how", [(40, "group"), (40, "component"), (40, "order"), (7, None), (100_000, None)])
def test_greedy_similar_equals_walk_without_pairs(spark, monkeypatch, head, how):
    r = random.Random(head)
    rows = [(i * 3, r.choice([1, 2, 3, None]), [r.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(2000 + i, 2, list(rows[i][2])) for i in range(0, 90, 3)] + [(5000, 1, [0.0] * 4), (5001, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    unit = {i: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] for i, _, v in rows if v}
    place = lambda x: ((-1 if x[1] is None else x[1]) if how in ("order", "component") else 0, x[0])
    ok = {"group": lambda a, b: a == b, "component": lambda a, b: None not in (a, b) and a != b}.get(how, lambda a, b: True)
    kept = []
    for x in sorted(rows, key=place):
        if x[2] is None or not any(y[2] and ok(x[1], y[1]) and round(sum(p * q for p, q in zip(unit[x[0]], unit[y[0]], strict=True)), 12) > 0.8 for y in kept):
            kept.append(x)

    def none(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(D, "greedy_dropped", none)
    args = {how: "label"} if how else {}
    out = D.greedy_similar(df, 0.8, order="label" if how == "component" else None, head=head, **args) if how != "order" else D.greedy_similar(df, 0.8, order="label", head=head)
    out = out.collect()
    assert len(out) == len(rows) and {x.vec_id for x in out if x.kept} == {x[0] for x in kept}


def near_copies(seed, n, groups):
    """(id, group, place, text): texts of a few originals with a word or two changed, many of them equal, and texts of their own."""
    r = random.Random(seed)
    originals, out = [[f"w{r.randrange(400)}" for _ in range(r.choice([2, 30, 60]))] for _ in range(4)], []
    for i in range(n):
        words = list(r.choice(originals)) if r.random() < 0.8 else [f"v{r.randrange(90)}" for _ in range(r.randrange(12))]
        for _ in range(r.choice([0, 0, 1, 2]) if len(words) > 5 else 0):
            words[r.randrange(len(words))] = f"x{r.randrange(3)}"
        out.append((i, r.choice(groups), r.choice([None, 0, 1, 2]), " ".join(words) if i % 17 else None))
    return out


@pytest.mark.parametrize("few", [0, 8, 10**6])
def test_greedy_shingles_equals_walk(spark, few):
    rows = near_copies(5, 260, ["g", "h", None])
    words = [(t or "").split() for *_, t in rows]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else set(w) for w in words]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] is not None and rows[a][1] == rows[b][1] and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.85]
    wanted = walk(len(rows), pairs, lambda i: -1 if rows[i][2] is None else rows[i][2])
    out = D.greedy_shingles(spark.createDataFrame(rows, "i long, g string, o int, text string"), "g", "i", "o", few=few).collect()
    assert {x.i for x in out if x.kept} == wanted and len(out) == len(rows) and len(pairs) > 400


def test_near_copies_do_not_meet_in_pairs(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, "g", " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in ((i, (i * 7) % 200) for i in range(300))]
    left, met = [], D._met
    monkeypatch.setattr(D, "_met", lambda posts, *a: (left.append(posts.count()), met(posts, *a))[1])
    kept = D.greedy_shingles(spark.createDataFrame(rows, "i long, g string, text string"), "g", "i", "i").filter("kept").collect()
    assert [x.i for x in kept] == [0] and sum(left) < 300


@pytest.mark.parametrize("threshold", [0.3, 0.85])
def test_sketches_rule_out_no_similar_pair(spark, threshold):
    r = random.Random(5)
    sets = []
    for m in (1, 3, 60, 64, 65, 700, 40_000):
        base = [r.getrandbits(64) - 2**63 for _ in range(m)]
        sets += [base, base[: -(-m * 9 // 10)], base + [r.getrandbits(64) - 2**63 for _ in range(m // 9)], [r.getrandbits(64) - 2**63 for _ in range(m)]]
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(sets)], "i long, s array<long>, m int")
    ids = df.select("i")
    near = {(x.a, x.b) for x in D._near(ids.withColumnRenamed("i", "a").crossJoin(ids.withColumnRenamed("i", "b")).filter("a < b"), D._sketches(df), threshold).collect()}
    pairs = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    assert {p for p, j in pairs.items() if j > threshold} <= near
    assert not [p for p in near if pairs[p] == 0 and p[0] // 4 == p[1] // 4 in range(2, 6) and threshold > 0.5]
    assert {x.i for x in D._sieved(df, ids.filter("i in (2, 7)")).collect()} == {2, 7}


def test_sets_of_pairs_that_only_share_rare_shingles_do_not_travel(spark, monkeypatch):
    rows = [(i, "g", " ".join([f"same{j}" for j in range(12)] + [f"w{i}x{j}" for j in range(88)])) for i in range(40)]
    rows += [(100 + i, "g", rows[i][2] + " more") for i in range(3)]
    met, jaccard = [], D._jaccard
    monkeypatch.setattr(D, "_jaccard", lambda pairs, left, *a: (met.append((pairs.count(), left.count())), jaccard(pairs, left, *a))[1])
    kept = D.greedy_shingles(spark.createDataFrame(rows, "i long, g string, text string"), "g", "i", "i", few=1e9).filter("kept").collect()
    assert sorted(x.i for x in kept) == list(range(40))
    assert met == [(3, 6)]
