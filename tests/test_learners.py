"""Learners against plain numpy, and caches and ledgers that are stopped and go on."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from curatrix.operators import clusters as K
from curatrix.operators import index as I
from curatrix.operators import learners as L
from curatrix.operators import models as M


def frame(spark, x, y, w=None):
    return spark.createDataFrame([(i, [float(v) for v in r], int(k), float(1 if w is None else w[i])) for i, (r, k) in enumerate(zip(x, y, strict=True))], "vec_id long, x array<double>, y int, w double").repartition(4, "vec_id")


def rings(n, seed):
    r = np.random.default_rng(seed)
    y = np.arange(n) % 2
    a, size = r.uniform(0, 2 * np.pi, n), np.where(y == 0, 1.0, 2.5) + 0.15 * r.normal(size=n)
    return np.stack([size * np.cos(a), size * np.sin(a)], axis=1), y


def test_features_come_near_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(40, 5))
    z = L.Fourier(5, 20_000, 0.3, "v", "z", 7).transform(frame(spark, x, np.zeros(40)).withColumn("v", array_to_vector("x")))
    z = np.array([r.z for r in z.orderBy("vec_id").select(vector_to_array("z").alias("z")).collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.05


def kernel_machine(x, y, c, gamma, steps=3000):
    """A support vector machine on the kernel itself (no offset): projected ascent of the dual."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.where(y == 1, 1.0, -1.0)
    q, a = k * s[:, None] * s[None], np.zeros(len(x))
    for _ in range(steps):
        a = np.clip(a + (1 - q @ a) / len(x), 0, c)
    return lambda t: (a * s) @ np.exp(-gamma * ((x[:, None] - t[None]) ** 2).sum(-1))


def test_kernel_machine_parts_rings(spark):
    x, y = rings(160, 1)
    t, u = rings(120, 2)
    train, test = frame(spark, x, y).coalesce(1), frame(spark, t, u)
    got = {r.vec_id: r.predicted for r in M.predict(M.fit(train, kind="rbf", vector="x", gamma=0.5, width=300), test, "x").collect()}
    got = np.array([got[i] for i in range(120)])
    mean, std = x.mean(0), x.std(0, ddof=1)
    want = kernel_machine((x - mean) / std, y, 1.0, 0.5)((t - mean) / std) > 0
    assert (got == u).mean() > 0.97 and (got == want).mean() > 0.97
    line = {r.vec_id: r.predicted for r in M.predict(M.fit(train, kind="svc", vector="x"), test, "x").collect()}
    assert (np.array([line[i] for i in range(120)]) == u).mean() < 0.75


def plain_boosting(x, y, w, edges, rounds, depth, rate, reg, least):
    """Row by row, node by node."""
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    classes = y.max() + 1
    prior = np.log([w[y == k].sum() / w.sum() for k in range(classes)])
    f, losses = np.tile(prior, (len(y), 1)), []
    for _ in range(rounds):
        p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
        losses.append(-(w * np.log(p[np.arange(len(y)), y])).sum() / w.sum())
        new = f.copy()
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])

            def grow(rows, level, g=g, h=h, k=k):
                best = None
                for j in range(b.shape[1]) if level < depth else []:
                    for cut in range(len(edges[j])):
                        lo, hi = rows[b[rows, j] <= cut], rows[b[rows, j] > cut]
                        if h[lo].sum() >= least and h[hi].sum() >= least:
                            gain = round(g[lo].sum() ** 2 / (h[lo].sum() + reg) + g[hi].sum() ** 2 / (h[hi].sum() + reg) - g[rows].sum() ** 2 / (h[rows].sum() + reg), 9)
                            if best is None or gain > best[0]:
                                best = gain, lo, hi
                if best is None or best[0] <= 1e-9:
                    if level:
                        new[rows, k] -= rate * g[rows].sum() / (h[rows].sum() + reg)
                    return
                grow(best[1], level + 1)
                grow(best[2], level + 1)

            grow(np.arange(len(y)), 0)
        f = new
    return np.exp(f) / np.exp(f).sum(1, keepdims=True), losses


@pytest.mark.parametrize("one_task,keep", [(20_000, 10), (0, 2)])
def test_boosting_equals_plain(spark, one_task, keep, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)  # sums of four tasks are added up in two steps
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(150, 3)), 2)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)).astype(int)
    w = 1 + (np.arange(150) % 3)
    model = L.boost(frame(spark, x, y, w), rounds=5, depth=3, rate=0.3, bins=12, keep=keep, one_task=one_task)
    want, losses = plain_boosting(x, y, w, model.edges, 5, 3, 0.3, 1.0, 1e-3)
    assert np.allclose(model.proba(x), want, atol=1e-9) and np.allclose(model.losses, losses) and losses == sorted(losses, reverse=True)


def test_full_rounds(spark):
    x, y = rings(200, 3)
    t, u = rings(100, 4)
    model = M.fit(frame(spark, x, y), kind="boosted", vector="x")
    out = M.predict(model, frame(spark, t, u), "x").collect()
    assert np.mean([r.predicted == r.y for r in out]) > 0.95 and all(abs(sum(r.proba) - 1) < 1e-9 for r in out)
    with pytest.raises(ValueError):
        L.boost(frame(spark, x[:0], y[:0]))


def test_one_gradient_round(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 2)
    r = np.random.default_rng(2)
    x, y, w = r.normal(size=(90, 6)), r.integers(0, 3, 90), r.uniform(0.5, 2, 90)
    ws = L.initial([6, 5, 4, 3], 1)
    rows = frame(spark, x, y, w).withColumnRenamed("vec_id", "k")
    got = L.batch_sums(rows, ws, 0, None, 1, 0.0, 1)
    assert np.allclose(got, L.gradients(ws, x, y, w))
    loss = lambda s: -(w * np.log(L.forward(s, x)[np.arange(90), y])).sum()
    flat = np.concatenate([np.concatenate([a.reshape(-1), b]) for a, b in ws])
    for i in r.integers(0, len(flat), 40):  # the gradient is that of the loss
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert (loss(L._shaped(flat + step, ws)) - loss(L._shaped(flat - step, ws))) / 2e-5 == pytest.approx(got[2 + i], abs=1e-4)
    parts = [L.batch_sums(rows, ws, 3, b, 4, 0.0, 1) for b in range(4)]
    assert np.allclose(np.sum(parts, axis=0), got)
    assert not np.allclose(L.batch_sums(rows, ws, 0, None, 1, 0.5, 1)[2:], got[2:])


@pytest.mark.parametrize("one_task", [20_000, 0])
def test_network_stops_early(spark, one_task):
    x, y = rings(200, 6)
    t, u = rings(100, 7)
    settings = {"hidden": (16, 8), "rate": 0.02, "batches": 2, "one_task": one_task, "dropout": 0.1}
    ws, losses = L.network(frame(spark, x, y), frame(spark, t, u), epochs=60 if one_task else 25, patience=5, **settings)
    assert (L.forward(ws, t).argmax(1) == u).mean() > 0.9 and losses[-1] < losses[0]
    _, flat = L.network(frame(spark, x, y), frame(spark, t, 1 - u), epochs=40, patience=3, least=10.0, **settings)
    assert len(flat) == 4  # nothing falls by 10: the first epoch and three more


def test_two_levels_of_clusters(spark):
    r = np.random.default_rng(8)
    v = np.vstack([r.normal(size=(300, 4)), np.tile(r.normal(size=4), (120, 1)), 9 + 0.1 * r.normal(size=(200, 4))])
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3, "vec_id")
    cells = K.cells_of(rows, 60).collect()
    assert sorted(c.id for c in cells) == list(range(620))
    sizes = {}
    for c in cells:
        sizes.setdefault(c.g, []).append(c.id)
    assert max(map(len, sizes.values())) <= 60
    near = np.mean([((v[i] - v[ids].mean(0)) ** 2).sum() for ids in sizes.values() for i in ids])
    assert near < 0.5 * v.var(axis=0).sum()
    found = K.representatives(rows, 0.1, most=60).collect()
    assert len({f.vec_id for f in found}) == len(found) == len({f.cluster for f in found})
    assert abs(len(found) - 62) <= len(sizes)
    # One cell: the plain clustering of all rows.
    few = rows.filter("vec_id < 50")
    c = I.lloyd(v[:50], 5, 42)
    d = np.round(np.sqrt(((v[:50, None] - c[None]) ** 2).sum(-1)), 9)
    want = {min(np.flatnonzero(d.argmin(1) == k), key=lambda i: (d[i, k], i)) for k in range(5)}
    assert {x.vec_id for x in K.representatives(few, 0.1).collect()} == want
    assert {x.vec_id for x in K.representatives(few, 0.1, "first").collect()} == {np.flatnonzero(d.argmin(1) == k)[0] for k in range(5)}
    assert K.representatives(rows.limit(0)).count() == 0


def test_coreset_inertia(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 5)) * 4
    v = centres[r.integers(0, 6, 4000)] + r.normal(size=(4000, 5))
    v[:5] += 60  # far rows, which an even sample would miss
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    x, w = K.coreset(rows, 1200)
    assert len(x) < 1500 and abs(w.sum() / 4000 - 1) < 0.1
    for k in (2, 6, 10):
        c, inertia = K.weighted_kmeans(x, w, k)
        on_all = ((v[:, None] - c[None]) ** 2).sum(-1).min(1).sum()
        full = K.weighted_kmeans(v, np.ones(len(v)), k)[1]
        assert abs(inertia / on_all - 1) < 0.05 and on_all < 1.05 * full
    clean = rows.filter("vec_id >= 5")
    assert K.choose_k(clean, size=1000) == K.choose_k(clean, size=10_000)
    assert K.choose_k(rows.limit(0)) == 1 and K.elbow([9.0, 4.0], 2, 3) == 2


def test_row_cache(spark, tmp_path):
    from curatrix.sources.vector_cache import VectorCache

    encoder = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    cache = VectorCache(spark, "a/b", str(tmp_path))
    df = spark.createDataFrame([(i, None if i == 3 else f"text {i % 40}") for i in range(100)], "i int, text string")
    assert cache.fill(df.filter("i % 40 < 36"), "text", encoder) == 36 and cache.fill(df, "text", encoder) == 4 and cache.fill(df, "text", encoder) == 0
    got = cache.get(df, "text", encoder, normalize=False).collect()
    assert len(got) == 100 and all((r.embedding is None) == (r.i == 3) for r in got) and len(cache.appends()) == 2
    broken = lambda: lambda texts: 1 / 0
    with pytest.raises(Exception):  # noqa: B017
        cache.fill(df.withColumn("text", F.concat("text", F.lit("!"))), "text", broken)
    assert cache.stats()["texts"] == 40  # a failed append isn't read
    cache.compact()
    assert len(cache.appends()) == 1 and cache.stats()["texts"] == 40
    assert VectorCache(spark, "other", str(tmp_path)).rows().count() == 0
    assert cache.clear() == 1 and cache.rows().count() == 0


def test_ledger_resumes(spark, tmp_path):
    from curatrix.sources.ledger import Ledger

    calls = tmp_path / "calls"
    calls.mkdir()

    def make():
        import uuid

        class Half:
            def generate(self, prompt, temperature=1.0):
                mine = sum(1 for p in calls.iterdir() if p.name.startswith(f"{prompt}-{temperature}-"))
                (calls / f"{prompt}-{temperature}-{uuid.uuid4().hex}").touch()
                if prompt == "never" or mine % 2 == 0:
                    raise TimeoutError("busy")
                return f"answer to {prompt}", {"prompt_tokens": 2, "completion_tokens": 3}

        return Half()

    prompts = spark.createDataFrame([(i, f"p{i % 30}") for i in range(60)] + [(99, "never"), (100, None)], "i int, prompt string")
    options = {"root": str(tmp_path / "root"), "budget": 4, "tries": 1, "wait": 0.0, "wave": 25}
    assert Ledger(spark, "run", **options).run(prompts, "prompt", make, (0.5, 1.0), waves=2) == 2
    before = len(list(calls.iterdir()))
    again = Ledger(spark, "run", **options)
    assert 0 < again.run(prompts, "prompt", make, (0.5, 1.0)) < 60 and before < 62
    answers = again.answers().collect()
    assert len(answers) == 60 and {a.attempt for a in answers} == {2}
    out = again.answered(prompts, "prompt").collect()
    assert len(out) == 122 and sum(r.response is None for r in out) == 2
    n = len(list(calls.iterdir()))
    assert n == 60 * 2 + 2 * 4 and again.run(prompts, "prompt", make, (0.5, 1.0)) == 0 and len(list(calls.iterdir())) == n


@pytest.mark.parametrize("part", [8192, 30])
def test_large_network_keeps_its_weights_off_the_driver(spark, monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    monkeypatch.setattr(L, "FAN", 2)
    r = np.random.default_rng(8)
    x = r.normal(size=(240, 5))
    y, settings = (x[:, 0] > 0).astype(int), {"epochs": 2, "rate": 0.02, "least": 0.0, "patience": 9}
    start = L.initial([5, 6, 2], 42)
    rows = frame(spark, x, y).withColumn("k", F.monotonically_increasing_id()).cache()
    want, losses = L.descend(start, lambda ws, e, b: L.batch_sums(rows, ws, e, b, 2, 0.0, 42), 2, None, **settings)

    def none(*_):
        raise AssertionError("gradients reach the driver")

    monkeypatch.setattr(L, "batch_sums", none)
    ws, got = L._descend_afar(rows, None, start, 240, 2, dropout=0.0, seed=42, **settings)
    assert got == pytest.approx(losses) and all(np.allclose(a, b) for u, v in zip(ws, want, strict=True) for a, b in zip(u, v, strict=True))
    ws, got = L.network(frame(spark, x, y), frame(spark, x[:50], y[:50]), hidden=(6,), batches=2, epochs=2, one_task=0)
    assert len(got) == 2


def test_boosting_tasks_follow_rows_not_files(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 3))

    def none(*_, **__):
        raise AssertionError("sums of many tasks")

    monkeypatch.setattr(L, "added", none)
    model = L.boost(frame(spark, x, (x[:, 0] > 0).astype(int)).repartition(8), rounds=1, depth=2, bins=8, one_task=0)
    assert len(model.trees) == 1


def test_texts_stay_where_nobody_needs_them(spark, tmp_path, monkeypatch):
    from curatrix.sources import vector_cache

    kept, stored = [], vector_cache.stored
    monkeypatch.setattr(vector_cache, "stored", lambda df, name: (kept.append(df.columns), stored(df, name))[1])
    cache = vector_cache.VectorCache(spark, "m", str(tmp_path))
    df = spark.createDataFrame([(i, f"text {i % 40}" if i % 9 else None) for i in range(120)], "i long, text string")
    make = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert [cache.fill(part, "text", make) for part in (df.filter("i < 20"), df, df)] == [17, 23, 0]
    found = cache.get(df, "text", make).filter("embedding is not null").select("i")
    assert found.count() == df.filter("text is not null").count() and all(c == ["digest"] for c in kept)
    join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x or "Join Inner" in x)
    assert "sha2" not in join and "text#" not in join


def test_support_vectors_keep_no_features_and_reach_sparks_objective(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    rng = np.random.default_rng(3)
    x, w = rng.normal(0, 1, (240, 4)), rng.uniform(0.5, 2, 240)
    y = (np.linalg.norm(x, axis=1) > 2).astype(int) + (x[:, 0] > 1)
    kernel, df, wide = L.Fourier(4, 24, 0.25, "v", "z", 7), frame(spark, x, y, w), []
    monkeypatch.setattr(L, "BLOCK", 32)
    monkeypatch.setattr(L, "stored", lambda d, name, f=L.stored: (wide.append(d.schema.simpleString()), f(d, name))[1])
    afar, near = (L.support_vectors(df, 240, kernel, 3, 0.05, 8, one_task) for one_task in (0, 240))
    assert wide == ["struct<x:binary,y:binary,w:binary>"]
    assert np.allclose(afar.coefficients, near.coefficients, atol=1e-8) and np.allclose(afar.intercepts, near.intercepts, atol=1e-8)
    z, model, inputs = kernel.of(x), L.support_vectors(df, 240, kernel, 3, 0.05), df.withColumn("v", array_to_vector("x"))
    want = OneVsRest(classifier=LinearSVC(maxIter=12, regParam=0.05, standardization=False), featuresCol="z", labelCol="y", weightCol="w").fit(kernel.transform(inputs).selectExpr("z", "double(y) as y", "w"))

    def objective(k, u, b):
        return (w * np.maximum(0, 1 - np.where(y == k, 1, -1) * (z @ u + b))).sum() / w.sum() + 0.05 * (u @ u) / 2

    for k in range(3):
        assert objective(k, model.coefficients[k], model.intercepts[k]) <= objective(k, want.models[k].coefficients.toArray(), want.models[k].intercept) * 1.001
    got = [r.prediction for r in model.transform(inputs).orderBy("vec_id").collect()]
    assert got == (z @ model.coefficients.T + model.intercepts).argmax(axis=1).tolist()


def test_kernel_machine_is_fitted_without_stored_features(spark, monkeypatch):
    x, y = rings(160, 1)
    monkeypatch.setattr(M, "stored", lambda d, name: pytest.fail(f"{name} is stored"))
    M.fit(frame(spark, x, y), kind="rbf", vector="x", gamma=0.5, width=30)
