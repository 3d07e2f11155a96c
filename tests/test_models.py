"""Values of the operators that SQL can't express."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import clusters as K
from curatrix.operators import models as M


def blobs(spark, n, seed, shift=0.0, classes=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.eye(4)[i % classes] * 3 + r.normal(0, 0.4, 4) + shift], float(i % classes)) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, y double")


@pytest.fixture(scope="module")
def data(spark):
    return blobs(spark, 90, 1), blobs(spark, 45, 2)


def softmax_fit(x, y, w, c=1.0, steps=4000):
    """Weighted multinomial regression on standardised columns by plain gradient descent: sum of losses plus |b|² / 2c."""
    z = np.hstack([x, np.ones((len(x), 1))])
    b, t = np.zeros((z.shape[1], int(y.max()) + 1)), np.eye(int(y.max()) + 1)[y.astype(int)]
    for _ in range(steps):
        p = np.exp(z @ b - (z @ b).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (w[:, None] * (p - t))
        g[:-1] += b[:-1] / c
        b -= 0.5 * g / w.sum()
    return lambda q: (lambda e: e / e.sum(1, keepdims=True))(np.exp(np.hstack([q, np.ones((len(q), 1))]) @ b))


def test_weighted_regression_is_the_plain_one(spark, data):
    train, test = data
    w = train.withColumn("w", 1.0 + (F.col("vec_id") % 2) * 2)
    got = {r.vec_id: r.proba for r in M.predict(M.fit(w, "w"), test).collect()}
    rows, other = w.orderBy("vec_id").collect(), test.orderBy("vec_id").collect()
    x, q = np.array([r.embedding for r in rows]), np.array([r.embedding for r in other])
    mean, std = x.mean(0), x.std(0, ddof=1)
    want = softmax_fit((x - mean) / std, np.array([r.y for r in rows]), np.array([r.w for r in rows]))((q - mean) / std)
    assert np.abs(np.array([got[r.vec_id] for r in other]) - want).max() < 0.03


def test_schemes(spark, data):
    train, test = data
    assert M.macro_f1(M.focal_training(train), test) > 0.95
    f1 = spark.createDataFrame([(0.0, 0.1), (1.0, 0.3), (2.0, 0.9)], "y double, f1 double")
    assert M.macro_f1(M.tier_training(train, f1), test) > 0.95
    good = blobs(spark, 30, 3).withColumn("confidence", F.lit(0.9))
    wrong = good.withColumn("y", (F.col("y") + 1) % 3)
    assert M.two_stage(train, good, test)[1] == "two_stage"
    # Rows that the first model doesn't agree with aren't learned from, so nothing is lost.
    assert M.macro_f1(M.two_stage(train, wrong.unionByName(good), test)[0], test) > 0.95
    few = train.limit(9)
    assert M.gate_by_validation(train, good, test)[0] and not M.gate_by_validation(few, wrong.withColumn("y", F.lit(0.0)), test)[0]
    zoo = {r.kind: r.macro_f1 for r in M.zoo(train, test).collect()}
    assert {*zoo} == {"lr", "rf", "svc", "mlp"} and min(zoo.values()) > 0.9
    near, far = M.discriminator(train, blobs(spark, 30, 4)), M.discriminator(train, blobs(spark, 30, 4, shift=6.0))
    assert near.agg(F.avg("p_synthetic")).first()[0] < 0.5 < 0.9 < far.agg(F.avg("p_synthetic")).first()[0]


def test_early_stopping(spark, data):
    train, test = data
    model, losses = M.early_stopped(train.withColumn("embedding", F.when(F.col("vec_id") >= 0, F.col("embedding"))), test, hidden=(16,), most=200, step=5, patience=10)
    assert M.macro_f1(model, test) > 0.95 and len(losses) < 40
    best = min(losses)
    assert losses[-3] - best < 0.001 <= losses[0] - best and best < 0.2  # the last two steps brought nothing
    p = [r.proba[int(r.y)] for r in M.predict(model, test).collect()]
    assert -np.mean(np.log(p)) < best + 0.001
    one, few = M.early_stopped(train.withColumn("embedding", F.when(F.col("vec_id") % 3 > 0, F.col("embedding"))), hidden=(8,), most=10)
    assert len(few) == 1 and M.predict(one, test).count() == test.count()
    with pytest.raises(ValueError):
        M.early_stopped(train.limit(0))


def test_evaluation(spark, data):
    train, test = data
    folds = M.cross_validate(train, blobs(spark, 30, 5), k=3).collect()
    assert [(r.repeat, r.fold) for r in folds] == [(0, 0), (0, 1), (0, 2)] and all(abs(r.delta - (r.augmented - r.baseline)) < 1e-12 and r.baseline > 0.9 for r in folds)
    held = M.hold_out(train.limit(6), test, train, (1, 2)).collect()
    assert [r.seed for r in held] == [1, 2] and all(r.augmented >= r.baseline and r.augmented > 0.95 for r in held)
    votes = M.seed_ensemble(train, test, test, lambda t, s: blobs(spark, 15, s)).join(test.select("vec_id", "y"), "vec_id")
    assert votes.filter("predicted = y").count() >= 43


def test_mixes_and_refinement(spark, data):
    train, _ = data
    v = {r.vec_id: (np.array(r.embedding), r.y) for r in train.collect()}
    mixes = K.mixup(train, 4, label="y").collect()
    assert len(mixes) == 12
    for r in mixes:
        assert v[r.a][1] == v[r.b][1] == r.y and 0 <= r.by <= 1 and np.allclose(r.synthetic, r.by * v[r.a][0] + (1 - r.by) * v[r.b][0])
    again = {r.vec_id: r.refined for r in K.contrastive(train, label="y").collect()}
    first = {r.vec_id: r.refined for r in K.contrastive(train.repartition(5), label="y").collect()}
    assert again.keys() == v.keys() and all(np.allclose(again[i], first[i]) for i in v)
    centre = {c: np.mean([x for x, y in v.values() if y == c], axis=0) for c in (0.0, 1.0, 2.0)}
    spread = lambda of: np.mean([np.linalg.norm(np.array(of[i]) - centre[v[i][1]]) for i in v])
    assert any(not np.allclose(again[i], v[i][0]) for i in v) and spread(again) < spread({i: x for i, (x, _) in v.items()})


def test_clusters_and_representatives(spark, data):
    train, _ = data
    out, centres, inertia = K.kmeans(train, 3)
    x = {r.vec_id: (np.array(r.embedding), r.cluster) for r in out.collect()}
    assert {r.vec_id % 3: r.cluster for r in out.collect()} and all(len({x[i][1] for i in x if i % 3 == c}) == 1 for c in range(3))
    assert np.isclose(inertia, sum(((v - centres[c]) ** 2).sum() for v, c in x.values()))
    assert K.choose_k(train, high=6) == 3 and K.choose_k(train.limit(1)) == 1
    found = K.representatives(train, 3 / 90).collect()
    assert len(found) == 3
    for r in found:
        mine = [i for i in x if x[i][1] == x[r.vec_id][1]]
        centre = np.mean([x[i][0] for i in mine], axis=0)
        assert r.vec_id == min(mine, key=lambda i, c=centre: (round(float(np.linalg.norm(x[i][0] - c)), 9), i))

def test_early_stopped_network_is_sparks(spark, data):
    """Losses after a few iterations are those of Spark ML's network from the same weights; rows are dealt to all tasks, whatever the files."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    from curatrix.operators.learners import packed

    train = blobs(spark, 384, 6).coalesce(1)  # whole blocks of 128 rows: Spark's losses are means of them
    _, losses = M.early_stopped(train, hidden=(7, 5), most=6, step=3, least=0.0)
    d = M.features(train)
    x = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(d).transform(d)
    network, want = MultilayerPerceptronClassifier(layers=[4, 7, 5, 3], seed=42, maxIter=3, featuresCol="__x", labelCol="y"), []
    for _ in range(2):
        model = network.fit(x)
        network = network.setInitialWeights(model.weights)
        p = [r.probability[int(r.y)] for r in model.transform(x).collect()]
        want.append(-np.mean(np.log(p)))
    assert np.allclose(losses, want, rtol=1e-6), (losses, want)
    rows = blobs(spark, 2000, 7).coalesce(1).select(F.col("embedding").alias("x"), F.col("y").cast("int"))
    blocks = packed(rows, 2000, "packed-test")
    sizes = [len(r.y) // 4 for r in blocks.collect()]
    assert sum(sizes) == 2000 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) < 100


def test_sigmoid_sums_and_quasi_newton():
    from curatrix.operators.learners import _as_shaped, quasi_newton, sigmoid_sums

    r = np.random.default_rng(3)
    shapes, x, y = [(4, 3), (3, 2)], r.normal(size=(9, 4)), r.integers(0, 2, 9)
    flat = r.normal(size=4 * 3 + 3 + 3 * 2 + 2)
    out = sigmoid_sums(_as_shaped(flat, shapes), x, y)
    for i in range(len(flat)):
        step = np.eye(len(flat))[i] * 1e-6
        up, down = (sigmoid_sums(_as_shaped(flat + s, shapes), x, y, False)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - out[2 + i]) < 1e-5

    def valley(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    start = np.array([-1.2, 1.0])
    at, value, _ = quasi_newton(valley, (start, *valley(start)), 200, tolerance=1e-12)
    assert np.allclose(at, 1, atol=1e-4) and value < 1e-8
    assert (quasi_newton(valley, (start, *valley(start)), 0)[0] == start).all()


def test_folds_are_fitted_together(spark, data):
    """Several models are fitted at a time, the added rows are read once, and results are those of one after the other."""
    train, _ = data
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(y):
        seen.add(1)
        return y

    more = blobs(spark, 30, 5).withColumn("y", counted(F.col("y").cast("double")))
    together = M.cross_validate(train, more, k=3, parallelism=3).collect()
    assert seen.value == 30
    assert together == M.cross_validate(train, blobs(spark, 30, 5), k=3, parallelism=1).collect()
