import numpy as np
import pytest

from curatrix.operators import index as I
from curatrix.operators import neighbors as N


@pytest.fixture(scope="module")
def clustered(spark):
    """600 vectors around 12 centres, a third around the first; a zero vector, repeated ones, a null one."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    at = np.where(np.arange(600) % 3 == 0, 0, r.integers(0, 12, 600))
    v = centres[at] + 0.15 * r.normal(size=(600, 16))
    rows = [(i, list(map(float, x)), int(i % 4)) for i, x in enumerate(v)] + [(700, [0.0] * 16, 1), (701, rows7 := list(map(float, v[7])), 2), (702, rows7, 3), (703, None, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).cache()


def found(df):
    return {(x.q, x.c): (round(x.score, 9), x.rank) for x in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_all_probes_are_exact(clustered, metric):
    index = I.build(clustered, metric, cells=9, value="label")
    assert index.rows == 603 and index.lists.count() == 603 and index.lists.select("g").distinct().count() <= 9
    queries = clustered.filter("vec_id % 50 = 0 or vec_id > 699")
    got = found(I.search(index, queries, 5, 9, value="label"))
    assert got == found(N.nearest(queries, clustered, 5, metric))
    for same in (True, False):
        assert found(I.search(index, queries, 3, 9, value="label", same=same)) == found(N.nearest(queries, clustered, 3, metric, query_group="label", corpus_group="label", same=same))


def test_recall(clustered, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)  # lists are cut into blocks
    index = I.build(clustered, value="label")
    probes = I.tune(index, clustered, 10, 0.95)
    assert 1 <= probes < len(index.centroids)  # clusters need few of the cells
    queries = clustered.filter("vec_id % 50 = 0")
    exact = N.nearest(queries, clustered, 10)
    r = I.recall(I.search(index, queries, 10, probes), exact).first()
    assert r.queries == 12 and r.recall >= 0.9
    assert I.recall(I.search(index, queries, 10, len(index.centroids)), exact).first().recall == 1


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    index = I.build(none, value="label")
    assert I.search(index, none, 3, 2, value="label").count() == 0 and I.similar_pairs(none, 0.5).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert I.search(I.build(one), one, 3, 2).count() == 0 and I.search(index, one, 3, 2).count() == 0


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.99), ("cosine", 0.9), ("cosine", 0.2), ("euclidean", 0.5), ("euclidean", -3.0)])
@pytest.mark.parametrize("dense", [0.9, 1.0])
def test_pairs_equal_all_pairs(clustered, metric, threshold, dense, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    got = I.similar_pairs(clustered, threshold, metric, cells=15, dense=dense).collect()
    want = N.similar_pairs(clustered, threshold, metric).collect()
    key = lambda rows: sorted((x.a, x.b, round(x.score, 9)) for x in rows)
    assert key(got) == key(want) and (threshold < 0 or len(want) > 0)


def test_far_cells_are_not_visited(clustered):
    few, many = I.visits(clustered, 0.99, cells=15), I.visits(clustered, 0.1, cells=15)
    assert few.rows == 603 and few.visits < 3 * few.rows and few.share < 0.4 < many.share <= 1
    assert few.visitors.count() == few.visits and few.visitors.filter("value").count() == few.rows


def test_empty_cells_take_far_rows():
    x = np.vstack([np.zeros((200, 5)), np.eye(5)])
    c = I.lloyd(x, 6, seed=3)
    assert sorted(map(tuple, c)) == sorted(set(map(tuple, x)))


def test_visits_are_sent_few_at_a_time(spark, clustered, monkeypatch):
    want = I.visits(clustered, 0.3, cells=15)
    rows = {(x.id, x.g, x.value) for x in want.visitors.collect()}
    monkeypatch.setattr(I, "VISITS", 30)
    plan = I.visits(clustered, 0.3, cells=15)
    assert plan.visits == want.visits == len(rows) and {(x.id, x.g, x.value) for x in plan.visitors.collect()} == rows


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_few_are_settled_and_none_is_lost(metric):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(700, 8)), np.zeros((2, 8))])
    x[300:340] = x[5]
    x[400:420] = x[6] * (1 + 1e-14)
    q, ids = x[:60].copy(), r.permutation(len(x))
    q[3] = 0
    s = N.similarities(N.prepared(q, metric), N.prepared(x, metric), metric)
    s[7] = -np.inf
    s[np.arange(60), np.arange(60)] = -np.inf
    for k in (1, 5, 15, 701, 900):
        row, col, score = N.nearest_of(s, ids, k, metric)
        full = N.settled(s, metric)
        want = N.best(full, ids, k)
        assert (row == want[0]).all() and (col == want[1]).all() and (score == full[want]).all()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("kind", ["plain", "copies", "zeros", "tiny", "huge", "grid"])
def test_single_precision_loses_none(metric, kind):
    r = np.random.default_rng(3)
    x = {"plain": lambda: r.normal(size=(700, 24)), "copies": lambda: np.repeat(r.normal(size=(70, 24)), 10, 0), "zeros": lambda: np.where(r.random((700, 1)) < 0.3, 0, r.normal(size=(700, 24))), "tiny": lambda: 1e-12 * r.normal(size=(700, 24)), "huge": lambda: 1e17 * r.normal(size=(700, 24)), "grid": lambda: r.integers(0, 2, (700, 3)).astype(float)}[kind]()
    p, ids, mask, doubles = N.prepared(x, metric), r.permutation(700), r.random((256, 700)) < 0.1, []
    off, light = N._single(p, p, metric), p.astype(np.float32)
    full = N.scores(x[:256], x, metric) if metric == "cosine" else N.settled(-np.stack([((a - x) ** 2).sum(1) for a in x[:256]]), metric)
    full[mask] = -np.inf

    def masked(s):
        doubles.append(s.dtype == np.float64)
        s[mask] = -np.inf

    for k in (1, 5, 15, 800):
        row, col, score = N.nearest_rows(p[:256], p, ids, k, metric, None if off is None else (light[:256], light, off[:256]), masked)
        want = N.best(full, ids, k)
        assert (row == want[0]).all() and (col == want[1]).all() and np.allclose(score, full[want], rtol=1e-12, atol=1e-7 * max(1e-4, np.abs(p).max()))  # as near as squares in double tell
    assert kind != "plain" or not any(doubles[:3])


def test_two_blocks_meet_once_for_both_sides(spark, monkeypatch):
    r = np.random.default_rng(4)
    x, g = r.normal(size=(90, 5)), [f"g{i % 4}" if i % 11 else None for i in range(90)]
    df = spark.createDataFrame([(i, g[i], x[i].tolist()) for i in range(90)], "vec_id long, label string, embedding array<double>")
    rights, cells = [], N.cells
    monkeypatch.setattr(N, "cells", lambda left, right, *a: (rights.append(right), cells(left, right, *a))[1])
    monkeypatch.setattr(N, "BLOCK", 20)
    got = {(o.id, o.g, o.other): o.total for o in N.distance_sums(df, "vec_id", "embedding", "label").collect()}
    d, name = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), [z or "\0" for z in g]
    want = {(i, name[i], c): sum(d[i, j] for j in range(90) if name[j] == c) for i in range(90) for c in set(name)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and rights == [None]
