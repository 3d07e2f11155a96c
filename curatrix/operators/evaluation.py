"""Splits, paired statistics, experiment analytics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.ladders import uniform
from curatrix.operators.ranks import numbered, with_totals


def verdict_scores(df: DataFrame, verdict: str) -> DataFrame:
    """One row: tp, tn, fp, fn, accuracy, precision, recall, f1 of a column of verdicts; 0 where undefined."""
    count = lambda v: F.sum((F.col(verdict) == v).cast("long"))
    g = df.agg(*(count(v).alias(v.lower()) for v in ("TP", "TN", "FP", "FN")))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return g.select("tp", "tn", "fp", "fn", safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, at_least: int = 1) -> DataFrame:
    """df with test boolean: the first share of each class in hash order, at least so many where the class has more rows than that."""
    n, r = F.col("__n"), F.col("__r")
    d = numbered(df, [label], [uniform(F.col(key)), F.col(key)], "__r", "__n")
    return d.withColumn("test", F.when(n > at_least, r <= F.greatest(F.lit(at_least), F.floor(n * share))).otherwise(F.lit(False))).drop("__r", "__n")


def safe_split(df: DataFrame, label: str, key: str, share: float = 0.2, rare: int = 2) -> DataFrame:
    """(…, part): train or test; rows of classes with fewer than `rare` rows are in both parts."""
    split = with_totals(stratified_split(df, label, key, share), label, {"__n": F.count(F.lit(1))})
    parts = F.when(F.col("__n") < rare, F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.when(F.col("test"), "test").otherwise("train")))
    return split.withColumn("part", F.explode(parts)).drop("test", "__n")


def folds(df: DataFrame, label: str, key: str, k: int = 5, repeats: int = 1) -> DataFrame:
    """df for each repeat with its fold, 0 to k - 1: rows of a class are dealt round in hash order."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = uniform(F.concat_ws("/", "repeat", F.col(key).cast("string")))
    return numbered(each, ["repeat", label], [order, F.col(key)], "__r", "__n").withColumn("fold", (F.col("__r") - 1) % k).drop("__r", "__n")


def paired(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """n, mean, std, t, wins and win_rate of paired differences by group; t is null where the deviation is 0."""
    g = df.groupBy(*by) if by else df
    out = g.agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("std"), F.sum((F.col(delta) > 0).cast("int")).alias("wins"))
    return out.withColumns({"t": F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)) * F.sqrt("n"), "win_rate": F.col("wins") / F.col("n")})


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    """Student's t distribution function."""
    tail = 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def significance(stats: DataFrame, level: float = 0.95) -> DataFrame:
    """paired() rows with p_value, ci_low, ci_high and significant. A row is a configuration, so the few rows are finished one by one in a Pandas UDF."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("p double, w double")
    def finish(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [(2 * (1 - t_cdf(abs(x), k - 1)) if k > 1 and x == x else None, t_quantile(0.5 + level / 2, k - 1) if k > 1 else None) for x, k in zip(t, n, strict=True)]
        return pd.DataFrame(rows, columns=["p", "w"], dtype="float64")

    half = F.col("f.w") * F.col("std") / F.sqrt("n")
    return stats.withColumn("f", finish(F.col("t"), F.col("n"))).withColumns({"p_value": F.col("f.p"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "significant": F.col("f.p") < 1 - level}).drop("f")


def replication(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, std (population), least, most, cv in percent, half-width 1.96 std / sqrt(n) and a label of robustness by group."""
    g = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    cv = F.col("std") / F.nullif(F.abs("mean"), F.lit(0.0)) * 100
    return g.withColumns({"cv": cv, "half_width": 1.96 * F.col("std") / F.sqrt("n"), "label": F.when(F.col("std") < 1.0, "robust").when(F.col("std") < 2.0, "acceptable").otherwise("high variance")})


def seed_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation, least, most, median and count of wins of a value by group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile(value, 0.5).alias("median"), F.sum((F.col(value) > 0).cast("int")).alias("wins"))


def marginal_returns(df: DataFrame, by: str, size: str, value: str) -> DataFrame:
    """df with marginal: change of value over change of size from the row before, in order of size by group; null for the first and where size stays."""
    w = Window.partitionBy(by).orderBy(size, value)
    return df.withColumn("marginal", (F.col(value) - F.lag(value).over(w)) / F.nullif(F.col(size) - F.lag(size).over(w), F.lit(0)))


def elbow(df: DataFrame, by: str, k: str, inertia: str, least: int = 3) -> DataFrame:
    """(by, k): the k with the largest second difference of inertia; one near the range's end gives the end, one under `least` gives `least`."""
    w = Window.partitionBy(by).orderBy(k)
    second = F.lead(inertia).over(w) - 2 * F.col(inertia) + F.lag(inertia).over(w)
    d = df.withColumn("__d", second)
    g = d.groupBy(by).agg(F.max_by(k, F.struct(F.col("__d"), -F.col(k))).alias("__k"), F.max(k).alias("__top"), F.min(k).alias("__low"), F.count("__d").alias("__n"))
    best = F.when(F.col("__n") == 0, F.col("__low")).when(F.col("__k") < least, F.least(F.lit(least), F.col("__top"))).when(F.col("__k") > F.col("__top") - 2, F.col("__top")).otherwise(F.col("__k"))
    return g.select(by, best.cast("int").alias(k))


def pivot(df: DataFrame, rows: str, columns: str, value: str, names: list) -> DataFrame:
    """Mean value by row and column; the columns' names are given, so that no extra pass finds them."""
    return df.groupBy(rows).pivot(columns, names).agg(F.avg(value))


def correlations(df: DataFrame, target: str, metrics: list[str], ranks: bool = False) -> DataFrame:
    """(metric, r) by size of r: Pearson's, or Spearman's over average ranks."""
    if ranks:
        for c in [target, *metrics]:
            df = numbered(df, [], [c], "rank__", "size__")
            mean = df.groupBy(F.col(c).alias("value__")).agg(F.avg("rank__").alias(f"__{c}"))
            df = df.join(mean, F.col(c).eqNullSafe(F.col("value__"))).drop("rank__", "size__", "value__")
        df = df.select(*(F.col(f"__{c}").alias(c) for c in [target, *metrics]))
    one = df.agg(*(F.corr(m, target).alias(m) for m in metrics))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("r")) for m in metrics))).alias("x")).select("x.*").orderBy(F.abs("r").desc(), "metric")


def best_and_worst(df: DataFrame, by: str, value: str, tie: str, k: int = 3) -> DataFrame:
    """The k best and k worst rows of each group, with rank and side."""
    up, down = (F.row_number().over(Window.partitionBy(by).orderBy(o, tie)) for o in (F.col(value).desc(), F.col(value).asc()))
    d = df.withColumns({"__u": up, "__d": down})
    side = lambda s, r: F.when(F.col(r) <= k, F.struct(F.lit(s).alias("side"), F.col(r).alias("rank")))
    return d.withColumn("x", F.explode(F.filter(F.array(side("best", "__u"), side("worst", "__d")), lambda x: x.isNotNull()))).select(*df.columns, "x.side", "x.rank")


def leave_one_out(results: DataFrame, name: str, value: str, full: str) -> DataFrame:
    """(name, contribution): the full configuration's value less that of each configuration without one component."""
    whole = results.filter(F.col(name) == full).agg(F.max(value).alias("__full"))
    return results.filter(F.col(name) != full).join(F.broadcast(whole)).select(name, (F.col("__full") - F.col(value)).alias("contribution"))


def coverage(df: DataFrame, label: str, source: str, low: int = 20, high: int = 50) -> DataFrame:
    """(label, n, sources, level, single_source): how well classes are covered."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"))
    return g.withColumns({"level": F.when(F.col("n") < low, "low").when(F.col("n") >= high, "high").otherwise("medium"), "single_source": F.col("sources") == 1})


def categorize(name: Column, prefixes: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The category of the first prefix that a name has."""
    out = None
    for prefix, category in prefixes:
        out = F.when(name.startswith(prefix), category) if out is None else out.when(name.startswith(prefix), category)
    return out.otherwise(otherwise)


#: What to change when a filter dominates the rejections.
ADVICE = {"length": "change the token bounds", "similarity": "lower the similarity threshold", "classifier": "lower the confidence threshold", "knn": "lower the neighbour threshold"}


def recommendations(acceptance: Column, shares: Column) -> Column:
    """What to change, as an array of texts: acceptance under 0.05 or over 0.50, and reasons with over 40 % of the rejections. shares: map of reason to share."""
    said = [F.when(acceptance < 0.05, F.lit("relax the thresholds")), F.when(acceptance > 0.50, F.lit("tighten the filters"))]
    said += [F.when(F.coalesce(F.try_element_at(shares, F.lit(k)), F.lit(0.0)) > 0.40, F.lit(v)) for k, v in ADVICE.items()]
    return F.filter(F.array(*said), lambda x: x.isNotNull())
