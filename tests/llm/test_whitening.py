import math
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import whitening
from curatrix.llm.whitening import jacobi, op12_whitening, triangle, whiten

S = "vec_id long, embedding array<double>, n string, id int, deviation string"


def usable(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in good)
    d = max(lengths, key=lambda k: (lengths[k], k))
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == d]


def brute(rows):
    """Identifiers, exact deviations, eigenvalues (falling) and eigenvectors of the covariance."""
    good = usable(rows)
    n, sums = len(good), [sum(c) for c in zip(*(x for _, x in good), strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in good]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for _, x in good])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in good], deviations, e[::-1], v[:, ::-1], centred


@pytest.mark.parametrize("d,rows", [(1, 5), (2, 2), (7, 40), (16, 9), (33, 500)])
def test_triangle_and_rotations(d, rows):
    r = np.random.default_rng(d)
    a = r.normal(size=(rows, d)) @ np.diag(10.0 ** -r.integers(0, 9, d))
    tri = triangle(iter([a[:3], a[3:3], a[3:]]), d)
    assert np.allclose(tri.T @ tri, a.T @ a, atol=1e-12)
    size, v = jacobi(tri)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and (np.diff(size) <= 0).all()
    assert np.allclose(size[: min(d, rows)], np.linalg.svd(a, compute_uv=False)[: min(d, rows)], rtol=1e-12, atol=1e-13)
    assert np.allclose(tri @ v @ v.T, tri)


def test_small_deviations_are_accurate():
    """Columns of very different length keep relative accuracy, which a covariance matrix would lose."""
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(50, 6)))[0]
    want = 10.0 ** -np.arange(0, 18, 3)
    assert np.allclose(jacobi(triangle(iter([q * want]), 6))[0], want, rtol=1e-10)


@pytest.mark.parametrize("fan", [2, 16])
def test_cases(spark, fan, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", fan)
    r = np.random.default_rng(3)
    rows = [(i, list(map(float, v))) for i, v in enumerate(r.normal(size=(300, 5)) @ np.diag([9, 4, 1, 0.5, 0.1]))]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (400, None), (401, []), (402, [1.0]), (403, [math.nan] * 5), (404, [1.0, None, 1.0, 1.0, 1.0]), (405, [math.inf] * 5), (406, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], S).repartition(7)
    out = whiten(df, top=3).collect()
    ids, deviations, e, v, centred = brute(rows)
    assert sorted(((x.vec_id, x.deviation) for x in out), key=repr) == sorted(zip(ids, deviations, strict=True), key=repr)
    w = centred @ v[:, :3] / np.sqrt(e[:3])
    want = {i: x for i, x in zip(ids, w, strict=True)}
    sign = np.sign(np.array(next(x.whitened for x in out if x.vec_id == 0)) * want[0])
    for x in out:
        assert np.allclose(np.array(x.whitened) * sign, want[x.vec_id], atol=1e-9)
        assert np.allclose(x.explained, e[:3] / e.sum(), rtol=1e-10) and x.n == len(ids) and x.identity_error < 1e-9


def test_no_variance(spark):
    same = whiten(spark.createDataFrame([(i, [1.0, 2.0], "x", 1, "y") for i in range(3)], S)).collect()
    assert [(x.deviation, x.whitened, x.explained, x.identity_error) for x in same] == [(0, [None, None], [None, None], None)] * 3
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0, 3.0], "x", 1, "y") for i in range(4)], S)).collect()
    assert all(x.whitened[1:] == [None, None] and x.explained[0] == 1 and x.identity_error < 1e-12 for x in flat)
    assert whiten(spark.createDataFrame([], S)).count() == 0
    assert whiten(spark.createDataFrame([(1, [], "x", 1, "y"), (2, None, "x", 1, "y")], S)).count() == 0
    big = whiten(spark.createDataFrame([(i, [float(i % 2) * 1e10, 0.0], "x", 1, "y") for i in range(40)], S)).collect()
    assert {x.deviation for x in big} == {None}


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, deviations, e, v, centred = brute(rows)
    out = op12_whitening(spark, sf).collect()
    assert len(out) == 32 * len(ids) and {x.vec_id: x.deviation for x in out} == dict(zip(ids, deviations, strict=True))
    got = np.zeros((len(ids), 32))
    at = {i: k for k, i in enumerate(ids)}
    for x in out:
        got[at[x.vec_id], x.component - 1] = x.whitened
        assert abs(x.explained - e[x.component - 1] / e.sum()) < 1e-10 and x.identity_error < 1e-9
    want = centred @ v[:, :32] / np.sqrt(e[:32])
    assert np.allclose(got * np.sign(got[0] * want[0]), want, atol=1e-8)
