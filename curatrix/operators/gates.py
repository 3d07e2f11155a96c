"""Gates and budgets: piecewise arithmetic on a class's profile, as columns.

Every function takes and returns columns, so a whole gate is one projection. The numbers in
the ladders are fixed values of the method; each is a parameter where the method has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.ladders import at_least, below, clip, uniform, whole


def enhanced_budget(n: Column, quality: Column, purity: Column, f1: Column, ratio: float = 0.08, low_purity: float = 0.30, low_purity_times: float = 0.3, high_f1: float = 0.45, high_times: float = 0.5, low_f1: float = 0.15, low_times: float = 1.5, floor: int = 10, potential: bool = False, potential_from: float = 0.7, boost: float = 1.0, least: int = 10, scale: float = 20.0) -> Column:
    """Budget of a class: a share of its size, times factors for quality, purity, F1 and, if asked, improvement potential 1 - F1."""
    times = below(quality, [(0.35, 0.1), (0.40, 0.3), (0.50, 0.7)], 1.0) * below(purity, [(low_purity, low_purity_times)], 1.0)
    times = times * F.when(f1 > high_f1, high_times).when(f1 < low_f1, low_times).otherwise(1.0)
    ip = 1.0 - f1
    if potential:
        times = times * F.when(ip > potential_from, 1.0 + boost * ip).when(ip > 0.5, 1.0 + 0.5 * boost * ip).otherwise(1.0)
    budget = F.greatest(F.lit(floor), whole(whole(n * ratio) * times))
    return F.when(ip > potential_from, F.greatest(budget, whole(least + scale * ip))).otherwise(budget) if potential else budget


def potential_budget(budget: Column, f1: Column, start: float = 0.7, boost: float = 1.0, least: int = 10, scale: float = 20.0) -> Column:
    """A budget scaled up by improvement potential, with a minimum where the potential is high."""
    ip = 1.0 - f1
    high = F.greatest(whole(budget * (1.0 + boost * ip)), whole(least + scale * ip))
    return F.when(ip > start, high).when(ip > 0.5, whole(budget * (1.0 + 0.5 * boost * ip))).otherwise(budget.cast("long"))


def f1_budget(f1: Column, high: float = 0.35, medium: float = 0.20, times: tuple[float, float, float] = (0.0, 0.5, 1.0)) -> Column:
    """Budget factor by F1; 0 means skip."""
    return at_least(f1, [(high, times[0]), (medium, times[1])], times[2])


def contamination(n_synthetic: Column, n_real: Column, purity: Column) -> Column:
    return n_synthetic / F.nullif(n_real, F.lit(0)) * (1.0 - purity)


def estimated_contamination(quality: Column, threshold: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - quality) * 0.5 * (1.0 - threshold)


def contamination_control(value: Column, threshold: float = 0.005, times: tuple[float, float, float] = (0.3, 0.7, 1.0)) -> Column:
    return F.when(value > threshold, times[0]).when(value > threshold * 0.6, times[1]).otherwise(times[2])


def confidence(quality: Column, purity: Column, cohesion: Column) -> Column:
    """Confidence that generation helps: 0.3 quality, 0.5 purity, 0.2 cohesion, each by its ladder; a null cohesion is neutral."""
    q = below(quality, [(0.25, 0.10), (0.30, 0.20), (0.35, 0.30), (0.40, 0.40), (0.45, 0.50), (0.50, 0.60)], 0.75)
    p = below(purity, [(0.10, 0.05), (0.20, 0.15), (0.30, 0.30), (0.40, 0.50), (0.50, 0.70)], 0.90)
    c = F.when(cohesion > 0.60, 0.70).when(cohesion > 0.50, 0.60).when(cohesion < 0.30, 0.30).otherwise(0.5)
    return clip(0.3 * q + 0.5 * p + 0.2 * c, 0.0, 1.0)


def decide(conf: Column, f1: Column, least: float = 0.35, skip_f1: float = 0.60, random_by: Column | None = None) -> Column:
    """"generate" or "skip": by threshold, or with the confidence as a probability drawn from a hash of `random_by`."""
    good = conf >= least if random_by is None else uniform(random_by) < conf
    return F.when((f1 < skip_f1) & good, "generate").otherwise("skip")


def rule_score(n: Column, f1: Column, anchor: Column, clusters: Column, cohesion: Column, purity: Column, safe: int = 30, weak: float = 0.05, least_anchor: float = 0.40, most_ratio: float = 0.3) -> Column:
    """Six rules that add to or take from 0.5, within 0 and 1; 0.5 or more means generate."""
    s = F.lit(0.5) + F.when(n < safe, -0.2).otherwise(0.1)
    s = s + below(f1, [(weak, 0.15), (0.2, 0.1)], 0.05) + below(anchor, [(least_anchor, -0.3), (0.7, -0.1)], 0.2)
    s = s + F.when(clusters / F.nullif(n, F.lit(0)) > most_ratio, -0.15).otherwise(0.1) + below(cohesion, [(0.5, -0.1)], 0.05) + below(purity, [(0.35, -0.15)], 0.1)
    return clip(s, 0.0, 1.0)


def verdict(decision: Column, gain: Column) -> Column:
    """TP, TN, FP or FN of a decision against what it gained."""
    generate, better = decision == "generate", gain > 0
    return F.when(generate & better, "TP").when(~generate & ~better, "TN").when(generate, "FP").otherwise("FN")


def risk(purity: Column, high: float = 0.30, medium: float = 0.50, low: float = 0.70) -> Column:
    return F.when(purity < high, "high").when(purity < medium, "medium").when(purity >= low, "low").otherwise("normal")


def risk_thresholds(purity: Column, size: Column, similarity: float = 0.35, conf: float = 0.60, anchor: float = 0.50, cap: float = 0.95) -> Column:
    """Struct (risk, min_similarity, min_confidence, to_anchor) of a cluster by its purity and size."""
    r = risk(purity)
    times = lambda h, m, n: F.when(r == "high", h).when(r == "medium", m).when(r == "low", n).otherwise(1.0)
    capped = lambda x: F.least(F.lit(cap), x)
    small = size < 30
    s, c, a = capped(similarity * times(1.43, 1.14, 0.85)), capped(conf * times(1.33, 1.17, 0.92)), capped(anchor * times(1.43, 1.14, 0.85))
    return F.struct(r.alias("risk"), F.when(small, capped(s * 1.1)).otherwise(s).alias("min_similarity"), F.when(small, capped(c * 1.05)).otherwise(c).alias("min_confidence"), a.alias("to_anchor"))


def cluster_budget(budget: Column, purity: Column) -> Column:
    r = risk(purity)
    out = F.when(r == "high", whole(budget * 0.5)).when(r == "medium", F.greatest(F.lit(8), whole(budget * 0.7))).when(r == "low", whole(budget * 1.2)).otherwise(budget)
    return F.greatest(F.lit(5), out)


def anchor_gate(quality: Column, purity: Column, n: Column, least_quality: float = 0.6, least_purity: float = 0.0, graduated: bool = False, bypass: Column | None = None) -> Column:
    """Whether a class passes: quality and purity reach their thresholds; graduated: classes under 150 rows need 0.7 of the purity; bypass lets a class through."""
    needed = F.when(n < 150, least_purity * 0.7).otherwise(least_purity) if graduated else F.lit(least_purity)
    ok = (quality >= least_quality) & (purity >= needed)
    return ok if bypass is None else ok | bypass


def auto_anchor_threshold(profiles: DataFrame, quality: str, margin: float = 0.05) -> DataFrame:
    """One row: the median quality of the classes less a margin, at least 0."""
    return profiles.agg(F.greatest(F.lit(0.0), F.percentile(quality, 0.5) - margin).alias("threshold"))


def auto_params(total: Column, smallest: Column, imbalance: Column, quality: Column) -> Column:
    """Struct (anchor_quality, cap_ratio, similarity, confidence, min_cluster) from a dataset's size, smallest class, imbalance and mean quality (may be null)."""
    size = lambda a, b, c: F.when(total < 10_000, a).when(total < 50_000, b).otherwise(c)
    tiny = lambda a, b: F.when(smallest < 50, a).when(smallest < 200, b).otherwise(1.0)
    q = size(0.15, 0.25, 0.30) * tiny(0.7, 0.85)
    q = F.when(quality < 0.20, F.least(q, quality * 1.2)).when(quality < 0.30, F.least(q, quality * 0.9)).otherwise(q)
    cap = size(0.20, 0.15, 0.10) * tiny(1.5, 1.2) * F.when(imbalance > 50, 1.3).otherwise(1.0)
    return F.struct(clip(q, 0.10, 0.35).alias("anchor_quality"), clip(cap, 0.05, 0.30).alias("cap_ratio"), clip(size(0.85, 0.88, 0.90), 0.80, 0.95).alias("similarity"), clip(size(0.05, 0.08, 0.10), 0.01, 0.15).alias("confidence"), size(5, 8, 10).alias("min_cluster"))


def filter_params(quality: Column, knn: float = 0.42, similarity: float = 0.45, anchor: float = 0.45, cap: float = 0.8) -> Column:
    """Struct of filter thresholds: relaxed for high quality, as given for medium, strict below."""
    pick = lambda a, b, c: at_least(quality, [(0.8, a), (0.6, b)], c)
    return F.struct(pick(knn - 0.02, knn, knn + 0.03).alias("knn"), pick(similarity - 0.03, similarity, similarity + 0.03).alias("similarity"), pick(anchor - 0.03, anchor, anchor + 0.03).alias("anchor"), pick(1.0, cap, 0.5).alias("cap"))


def adaptive_thresholds(f1: Column) -> Column:
    """Struct (knn, similarity, anchor, prompt_times, mode): weak classes get looser filters and more prompts, strong ones paraphrases."""
    step = lambda a, b, c, d: below(f1, [(0.10, a), (0.20, b), (0.40, c)], d)
    mode = F.when(f1 >= 0.45, "paraphrase").otherwise("mix")
    return F.struct(step(0.37, 0.40, 0.42, 0.44).alias("knn"), step(0.40, 0.43, 0.45, 0.47).alias("similarity"), step(0.40, 0.43, 0.45, 0.47).alias("anchor"), below(f1, [(0.10, 2.0), (0.20, 1.5)], 1.0).alias("prompt_times"), mode.alias("mode"))


def purity_thresholds(purity: Column) -> Column:
    """Struct (similarity, knn, confidence, level): the purer, the looser."""
    step = lambda a, b, c, d: below(purity, [(0.30, a), (0.45, b), (0.60, c)], d)
    return F.struct(step(0.90, 0.72, 0.63, 0.60).alias("similarity"), step(0.52, 0.45, 0.40, 0.35).alias("knn"), step(0.20, 0.15, 0.12, 0.10).alias("confidence"), step("critical", "high", "medium", "low").alias("level"))


def purity_start(purity: Column) -> Column:
    """The similarity threshold that relaxation starts from."""
    return at_least(purity, [(0.8, 0.50), (0.6, 0.60), (0.4, 0.70)], 0.80)


def cohesion_threshold(cohesion: Column, n: Column) -> Column:
    """Similarity threshold by mean pairwise similarity: cohesive classes get a stricter one."""
    return F.when(n < 5, 0.70).when(cohesion > 0.7, 0.85).when(cohesion > 0.5, 0.70).otherwise(0.55)


def share_budget(n: Column, share: float, clusters: Column) -> Column:
    """Struct (per_class, per_cluster): a share of the class, at least 3, and its part for each cluster, at least 2."""
    per_class = F.greatest(F.lit(3), whole(n * share))
    return F.struct(per_class.alias("per_class"), F.greatest(F.lit(2), whole(per_class / clusters)).alias("per_cluster"))


def cap(n: Column, ratio: float, absolute: float) -> Column:
    """The smaller of a share of the class and an absolute cap; a cap of 0 or less is none; null: unlimited."""
    limits = [x for x in ((whole(n * ratio) if ratio > 0 else None), (F.lit(int(absolute)).cast("long") if absolute > 0 else None)) if x is not None]
    return F.least(*limits) if len(limits) > 1 else limits[0] if limits else F.lit(None).cast("long")


def cluster_count(n: Column, most: int) -> Column:
    """Clusters for a class by its size: one under 30 rows, else a part of the size, within 1 and `most`."""
    return F.when(n < 30, 1).when(n < 50, F.greatest(F.lit(1), F.least(F.lit(most), whole(n / 15)))).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), whole(n / 30))))


def cluster_cap(clusters: Column, purity: Column, n: Column, min_samples: int = 5) -> Column:
    """Fewer clusters for a small or impure class."""
    return F.when((purity < 0.03) | (n < 30), F.least(clusters, F.greatest(F.lit(3), whole(n / min_samples)))).otherwise(clusters)


def clusters_by_size(n: Column, size: int, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(n / size)))


def quota(df: DataFrame, order: list[Column], group: str, group_cap: Column | None, cluster: str | None = None, per_cluster: Column | None = None) -> DataFrame:
    """Rows whose running count stays within their group's cap and their cluster's; a null cap is none.

    The cluster's cap is applied first, so that what it drops doesn't use up the group's.
    """
    out = df
    if cluster is not None:
        out = out.withColumn("__k", F.row_number().over(Window.partitionBy(group, cluster).orderBy(*order))).filter(per_cluster.isNull() | (F.col("__k") <= per_cluster)).drop("__k")
    if group_cap is not None:
        out = out.withColumn("__g", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(group_cap.isNull() | (F.col("__g") <= group_cap)).drop("__g")
    return out
