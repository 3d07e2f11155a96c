"""Classifiers, their training schemes and evaluation, on Spark ML.

Where the method averages weights (sum of losses) and Spark ML averages losses, regParam is
1 / (C × sum of weights), so C keeps its meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.classes import averages, prf
from curatrix.operators.evaluation import folds, paired
from curatrix.operators.learners import Fourier, block_sums, boost, boosted, network, networked, packed, quasi_newton, support_vectors
from curatrix.operators.weights import class_weights, focal, to_mean_one
from curatrix.sources.storage import stored


def encode(df: DataFrame, label: str = "label", out: str = "y") -> DataFrame:
    """df with the place of its label among the sorted labels; labels are few, so their list is broadcast."""
    every = df.agg(F.sort_array(F.collect_set(label)).alias("__ls"))
    return df.join(F.broadcast(every)).withColumn(out, (F.array_position("__ls", F.col(label)) - 1).cast("double")).drop("__ls")


def features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("__raw", array_to_vector(F.col(vector).cast("array<double>")))


def estimator(kind: str, classes: int, width: int, reg: float = 0.0, seed: int = 42):
    """A Spark ML classifier by name: lr, rf, svc, gbt, mlp or mlp_large."""
    common = {"featuresCol": "__x", "labelCol": "y"}
    layers = {"mlp": [width, 64, classes], "mlp_large": [width, 256, 128, classes]}
    if kind in layers:
        return MultilayerPerceptronClassifier(layers=layers[kind], seed=seed, maxIter=60, **common)
    if kind == "lr":
        return LogisticRegression(regParam=reg, weightCol="__w", maxIter=100, family="multinomial", **common)
    if kind == "rf":
        return RandomForestClassifier(numTrees=50, seed=seed, weightCol="__w", **common)
    if kind in ("svc", "gbt"):
        return OneVsRest(classifier=LinearSVC(maxIter=30) if kind == "svc" else GBTClassifier(maxIter=5, seed=seed), parallelism=min(classes, 8), **common)
    raise ValueError(f"kind: {kind!r}")


def fit(df: DataFrame, weight: str | None = None, kind: str = "lr", c: float = 1.0, vector: str = "embedding", label: str = "y", seed: int = 42, **options) -> PipelineModel:
    """Standard scaling and a classifier, with row weights.

    Kinds of estimator(), and from learners: rbf (random Fourier features of the kernel
    exp(-|x - y|² / dimensions) under linear support vectors; options: width, gamma), boosted
    (softmax boosting on histograms, unscaled; options of learners.boost) and network
    (rectified units with dropout; options of learners.network).
    """
    d = features(df, vector).withColumn("__w", F.col(weight).cast("double") if weight else F.lit(1.0)).withColumn("y", F.col(label).cast("double"))
    one = d.agg(F.sum("__w").alias("w"), F.max("y").alias("k"), F.max(F.size(vector)).alias("m"), F.count(F.lit(1)).alias("n")).first()
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)
    rows = lambda x, at: x.select(vector_to_array(at).alias("x"), F.col("y").cast("int").alias("y"), F.col("__w").alias("w"))
    if kind == "boosted":
        return PipelineModel([boosted(boost(rows(d, "__raw"), **options), "__raw")])
    if kind == "network":
        scaled = scale.fit(d)
        return PipelineModel([scaled, networked(network(rows(scaled.transform(d), "__x"), seed=seed, **options)[0], "__x")])
    if kind == "rbf":
        scaled = scale.fit(d)
        kernel = Fourier(one.m, options.get("width", 1024), options.get("gamma") or 1 / one.m, "__x", "__z", seed)
        return PipelineModel([scaled, support_vectors(rows(scaled.transform(d), "__x"), one.n, kernel, int(one.k) + 1, 1 / (c * one.w))])
    return Pipeline(stages=[scale, estimator(kind, int(one.k) + 1, one.m, 1 / (c * one.w), seed)]).fit(d)


def early_stopped(df: DataFrame, validation: DataFrame | None = None, hidden: tuple[int, ...] = (512, 256, 128), most: int = 100, step: int = 10, least: float = 0.001, patience: int = 10, vector: str = "embedding", label: str = "y", seed: int = 42) -> tuple[PipelineModel, list[float]]:
    """A network trained step iterations at a time until the log loss hasn't fallen by least for patience iterations, or most are done; the best one, and the losses.

    Losses are those of the validation rows, or of the training rows where none are given. Each step
    goes on from the last one's weights; only weights, sums of gradients and losses pass the
    driver. The network is Spark ML's, from its first weights on and by its method; its sums
    come of packed blocks of rows. Rows without a vector or label are left out; no rows at all are an error.
    """
    prepared = lambda x: features(x.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()), vector).select("__raw", F.col(label).cast("double").alias("y"))
    d = prepared(df)
    one = d.agg(F.max("y").alias("k"), F.max(F.size(vector_to_array("__raw"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if one.k is None:
        raise ValueError("no rows to learn from")
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(d)
    blocks = lambda x, n, name: packed(scale.transform(x).select(vector_to_array("__x").alias("x"), F.col("y").cast("int").alias("y")), n, name)
    train, layers = blocks(d, one.n, "network"), [one.m, *hidden, int(one.k) + 1]
    check = blocks(p := prepared(validation), p.count(), "network-validation") if validation is not None else None
    spark_network = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=0, featuresCol="__x", labelCol="y")
    any_row = scale.transform(d.limit(1))  # a fit of no iterations makes a model of the weights it is given

    def of(flat: np.ndarray) -> tuple[float, np.ndarray]:
        out = block_sums(train, layers, flat)
        return out[1] / out[0], out[2:] / out[0]

    x = spark_network.fit(any_row).weights.toArray()
    point = x, *of(x)
    best, losses, lowest, stale = None, [], float("inf"), 0
    for _ in range(0, most, step):
        point = quasi_newton(of, point, step)
        held = block_sums(check, layers, point[0], False) if check is not None else None
        losses.append(float(held[1] / held[0]) if held is not None else float(point[1]))
        if best is None or losses[-1] < lowest - least:
            best, lowest, stale = point[0], losses[-1], 0
        elif (stale := stale + step) >= patience:
            break
    best = spark_network.setInitialWeights(Vectors.dense(best)).fit(any_row)
    return PipelineModel([scale, best]), losses


def predict(model: PipelineModel, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with predicted (and proba where the model has it)."""
    out = model.transform(features(df, vector))
    proba = {"proba": vector_to_array("probability")} if "probability" in out.columns else {}
    return out.withColumns(proba | {"predicted": F.col("prediction")}).select(*df.columns, *proba, "predicted")


def evaluate(model: PipelineModel, df: DataFrame, vector: str = "embedding", label: str = "y") -> DataFrame:
    """The class report of a model on rows."""
    return prf(predict(model, df, vector), label, "predicted")


def macro_f1(model: PipelineModel, df: DataFrame, vector: str = "embedding") -> float:
    return averages(evaluate(model, df, vector)).first().macro_f1 or 0.0


def focal_training(df: DataFrame, rounds: int = 3, gamma: float = 2.0, vector: str = "embedding") -> PipelineModel:
    """Train, weight rows by (1 - p of the true class)^gamma, train again."""
    model = fit(df, vector=vector)
    for _ in range(rounds - 1):
        p = predict(model, df, vector).withColumn("__p", F.get("proba", F.col("y").cast("int")))
        df_w = stored(focal(p, "__p", gamma, "__fw").drop("proba", "predicted", "__p"), "focal")
        model = fit(df_w, "__fw", vector=vector)
    return model


def tier_training(df: DataFrame, f1: DataFrame, vector: str = "embedding") -> PipelineModel:
    """Train with tier-boosted balanced class weights. f1: (y, f1)."""
    w = class_weights(df, "y", f1).select("y", F.col("weight").alias("__cw"))
    return fit(to_mean_one(df.join(F.broadcast(w), "y"), "__cw", "__cw"), "__cw", vector=vector)


def two_stage(real: DataFrame, synthetic: DataFrame, validation: DataFrame, least: float = 0.7, times: float = 0.5, tolerance: float = 0.02, vector: str = "embedding") -> tuple[PipelineModel, str]:
    """Train on real rows; then with the synthetic rows (y, confidence) of high confidence that the first model agrees with; keep the second unless it falls behind by more than the tolerance on validation rows."""
    first = fit(real, vector=vector)
    good = predict(first, synthetic, vector).filter((F.col("confidence") >= least) & (F.col("predicted") == F.col("y")))
    weighted = to_mean_one(good.withColumn("w", F.col("confidence") * times), "w", "w", times)
    both = stored(real.select("y", vector).withColumn("w", F.lit(1.0)).unionByName(weighted.select("y", vector, "w")), "two-stage")
    second = fit(both, "w", vector=vector)
    return (second, "two_stage") if macro_f1(second, validation, vector) >= macro_f1(first, validation, vector) - tolerance else (first, "stage_one")


def discriminator(real: DataFrame, synthetic: DataFrame, kind: str = "lr", vector: str = "embedding") -> DataFrame:
    """synthetic with p_synthetic: how well a model tells it from real rows."""
    both = real.select(vector).withColumn("y", F.lit(0.0)).unionByName(synthetic.select(vector).withColumn("y", F.lit(1.0)))
    model = fit(both, kind=kind, vector=vector)
    return predict(model, synthetic, vector).withColumn("p_synthetic", F.get("proba", F.lit(1))).drop("proba", "predicted")


def gate_by_validation(real: DataFrame, synthetic: DataFrame, validation: DataFrame, tolerance: float = 0.01, vector: str = "embedding") -> tuple[bool, float]:
    """Whether synthetic rows are taken: macro F1 on validation rows must not fall by more than the tolerance; and the change."""
    base = macro_f1(fit(real, vector=vector), validation, vector)
    new = macro_f1(fit(real.select("y", vector).unionByName(synthetic.select("y", vector)), vector=vector), validation, vector)
    return new - base >= -tolerance, new - base


def cross_validate(df: DataFrame, augment: DataFrame | None, key: str = "vec_id", label: str = "y", k: int = 5, repeats: int = 1, weight: float = 0.5, kind: str = "lr", vector: str = "embedding", parallelism: int = 5) -> DataFrame:
    """(repeat, fold, baseline, augmented, delta) of macro F1; synthetic rows are only in training. So many models are fitted at a time, on rows stored once."""
    spark = df.sparkSession
    dealt = stored(folds(df, label, key, k, repeats), "folds")
    more = stored(augment.select(label, vector), "augment") if augment is not None else None

    def score(model: tuple[int, int, bool]) -> float:
        r, f, augmented = model
        train, test = (dealt.filter((F.col("repeat") == r) & (F.col("fold") != f if t else F.col("fold") == f)) for t in (True, False))
        if not augmented:
            return macro_f1(fit(train, kind=kind, vector=vector), test, vector)
        both = train.select(label, vector).withColumn("w", F.lit(1.0)).unionByName(more.withColumn("w", F.lit(weight)))
        return macro_f1(fit(both, "w", kind=kind, vector=vector), test, vector)

    each = [(r, f) for r in range(repeats) for f in range(k)]
    models = [(r, f, a) for r, f in each for a in ((False, True) if more is not None else (False,))]
    with ThreadPool(parallelism) as pool:
        found = dict(zip(models, pool.map(inheritable_thread_target(spark)(score), models, chunksize=1), strict=True))
    rows = [(r, f, base := found[r, f, False], new := found.get((r, f, True), base), new - base) for r, f in each]
    return spark.createDataFrame(rows, "repeat int, fold int, baseline double, augmented double, delta double")


def cross_validation_report(result: DataFrame) -> DataFrame:
    return paired(result, [], "delta")


def hold_out(train: DataFrame, test: DataFrame, augment: DataFrame | None = None, seeds: tuple[int, ...] = (42,), kind: str = "lr", vector: str = "embedding") -> DataFrame:
    """(seed, baseline, augmented, delta) on held-out rows."""
    rows = []
    for s in seeds:
        base = macro_f1(fit(train, kind=kind, vector=vector, seed=s), test, vector)
        new = macro_f1(fit(train.select("y", vector).unionByName(augment.select("y", vector)), kind=kind, vector=vector, seed=s), test, vector) if augment is not None else base
        rows.append((s, base, new, new - base))
    return train.sparkSession.createDataFrame(rows, "seed int, baseline double, augmented double, delta double")


def zoo(train: DataFrame, test: DataFrame, kinds: tuple[str, ...] = ("lr", "rf", "svc", "mlp"), vector: str = "embedding") -> DataFrame:
    """(kind, macro_f1) of several classifiers, on rows stored once."""
    train, test = stored(train, "zoo-train"), stored(test, "zoo-test")
    rows = [(k, macro_f1(fit(train, kind=k, vector=vector), test, vector)) for k in kinds]
    return train.sparkSession.createDataFrame(rows, "kind string, macro_f1 double")


def seed_ensemble(train: DataFrame, validation: DataFrame, test: DataFrame, augment: Callable[[DataFrame, int], DataFrame], seeds: tuple[int, ...] = (1, 2, 3), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, proba, predicted): models of several augmentation seeds, soft-voted with weights softmax(5 F1) on validation rows."""
    from curatrix.operators.weights import vote

    out, scores = None, []
    for s in seeds:
        model = fit(train.select("y", vector).unionByName(augment(train, s).select("y", vector)), vector=vector, seed=s)
        scores.append((s, macro_f1(model, validation, vector)))
        p = predict(model, test, vector).select(key, F.lit(s).alias("model"), "proba")
        out = p if out is None else out.unionByName(p)
    return vote(out, key, "model", "proba", train.sparkSession.createDataFrame(scores, "model int, f1 double"))
