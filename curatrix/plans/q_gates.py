"""Gate and budget queries over a class profile."""

from pyspark.sql import functions as F

from curatrix.operators import gates as G
from curatrix.plans.registry import PROFILE, profile, query, rounded, table

P = f"WITH {PROFILE} "
c = F.col
QM = "CASE WHEN quality < 0.35 THEN 0.1::DOUBLE WHEN quality < 0.40 THEN 0.3::DOUBLE WHEN quality < 0.50 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN purity < 0.30 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN f1 > 0.45 THEN 0.5::DOUBLE WHEN f1 < 0.15 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"
N = "(n_samples * 97)"


def prof(spark, d):
    return profile(spark, d).withColumn("n", c("n_samples") * 97)


@query("gb01_enhanced_budget", P + f"""SELECT label, greatest(10, CAST(floor(floor({N} * 0.08::DOUBLE) * ({QM})) AS BIGINT)) AS budget,
  CASE WHEN 1.0::DOUBLE - f1 > 0.7::DOUBLE THEN greatest(b, CAST(floor(10 + 20.0::DOUBLE * (1.0::DOUBLE - f1)) AS BIGINT)) ELSE b END AS scaled FROM (
  SELECT *, greatest(10, CAST(floor(floor({N} * 0.08::DOUBLE) * ({QM} * CASE WHEN 1.0::DOUBLE - f1 > 0.7::DOUBLE THEN 1.0::DOUBLE + (1.0::DOUBLE - f1) WHEN 1.0::DOUBLE - f1 > 0.5::DOUBLE THEN 1.0::DOUBLE + 0.5::DOUBLE * (1.0::DOUBLE - f1) ELSE 1.0::DOUBLE END)) AS BIGINT)) AS b FROM p)""")
def _(spark, d):
    a = (c("n"), c("quality"), c("purity"), c("f1"))
    return prof(spark, d).select("label", G.enhanced_budget(*a).alias("budget"), G.enhanced_budget(*a, potential=True).alias("scaled"))


@query("gb02_potential_budget", P + """SELECT label, CASE WHEN ip > 0.7::DOUBLE THEN greatest(CAST(floor(n_samples * (1.0::DOUBLE + ip)) AS BIGINT), CAST(floor(10 + 20.0::DOUBLE * ip) AS BIGINT)) WHEN ip > 0.5::DOUBLE THEN CAST(floor(n_samples * (1.0::DOUBLE + 0.5::DOUBLE * ip)) AS BIGINT) ELSE n_samples END AS budget FROM (SELECT *, 1.0::DOUBLE - f1 AS ip FROM p)""")
def _(spark, d):
    return prof(spark, d).select("label", G.potential_budget(c("n_samples"), c("f1")).alias("budget"))


@query("gb03_f1_budget", P + "SELECT label, CASE WHEN f1 >= 0.35::DOUBLE THEN 0.0::DOUBLE WHEN f1 >= 0.20::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS times, f1 >= 0.35::DOUBLE AS skipped FROM p")
def _(spark, d):
    t = G.f1_budget(c("f1"))
    return prof(spark, d).select("label", t.alias("times"), (t == 0).alias("skipped"))


@query("gb04_contamination_control", P + "SELECT label, round(k, 6) AS contamination, CASE WHEN k > 0.005::DOUBLE THEN 0.3::DOUBLE WHEN k > 0.005::DOUBLE * 0.6::DOUBLE THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS times FROM (SELECT label, n_clusters / (n_samples * 200)::DOUBLE * (1.0::DOUBLE - purity) AS k FROM p)")
def _(spark, d):
    k = prof(spark, d).select("label", G.contamination(c("n_clusters"), c("n_samples") * 200, c("purity")).alias("k"))
    return k.select("label", F.round("k", 6).alias("contamination"), G.contamination_control(c("k")).alias("times"))


CONF = """0.3::DOUBLE * (CASE WHEN quality < 0.25 THEN 0.10 WHEN quality < 0.30 THEN 0.20 WHEN quality < 0.35 THEN 0.30 WHEN quality < 0.40 THEN 0.40 WHEN quality < 0.45 THEN 0.50 WHEN quality < 0.50 THEN 0.60 ELSE 0.75 END)::DOUBLE
 + 0.5::DOUBLE * (CASE WHEN purity < 0.10 THEN 0.05 WHEN purity < 0.20 THEN 0.15 WHEN purity < 0.30 THEN 0.30 WHEN purity < 0.40 THEN 0.50 WHEN purity < 0.50 THEN 0.70 ELSE 0.90 END)::DOUBLE
 + 0.2::DOUBLE * (CASE WHEN cohesion > 0.60 THEN 0.70 WHEN cohesion > 0.50 THEN 0.60 WHEN cohesion < 0.30 THEN 0.30 ELSE 0.5 END)::DOUBLE"""


@query("gb05_gate_confidence", P + f"SELECT label, round({CONF}, 6) AS confidence FROM p")
def _(spark, d):
    return rounded(prof(spark, d).select("label", G.confidence(c("quality"), c("purity"), c("cohesion")).alias("confidence")))


@query("gb06_gate_decision", P + f"""SELECT label, CASE WHEN f1 < 0.6 AND k >= 0.4 THEN 'generate' ELSE 'skip' END AS by_threshold, CASE WHEN f1 < 0.6 AND ('0x' || substr(md5(label), 1, 8))::BIGINT / 4294967296.0::DOUBLE < k THEN 'generate' ELSE 'skip' END AS by_chance FROM (SELECT *, round({CONF}, 9) AS k FROM p)""")
def _(spark, d):
    k = prof(spark, d).withColumn("k", F.round(G.confidence(c("quality"), c("purity"), c("cohesion")), 9))
    return k.select("label", G.decide(c("k"), c("f1"), 0.4).alias("by_threshold"), G.decide(c("k"), c("f1"), random_by=c("label")).alias("by_chance"))


RULES = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (CASE WHEN n_samples < 30 THEN -0.2 ELSE 0.1 END)::DOUBLE + (CASE WHEN f1 < 0.05 THEN 0.15 WHEN f1 < 0.2 THEN 0.1 ELSE 0.05 END)::DOUBLE + (CASE WHEN quality < 0.40 THEN -0.3 WHEN quality < 0.7 THEN -0.1 ELSE 0.2 END)::DOUBLE
 + (CASE WHEN n_clusters / n_samples::DOUBLE > 0.3 THEN -0.15 ELSE 0.1 END)::DOUBLE + (CASE WHEN cohesion < 0.5 THEN -0.1 ELSE 0.05 END)::DOUBLE + (CASE WHEN purity < 0.35 THEN -0.15 ELSE 0.1 END)::DOUBLE))"""


@query("gb07_rule_gate", P + f"SELECT label, round(s, 6) AS score, CASE WHEN round(s, 9) >= 0.5 THEN 'generate' ELSE 'skip' END AS decision FROM (SELECT label, {RULES} AS s FROM p)")
def _(spark, d):
    s = prof(spark, d).select("label", G.rule_score(c("n_samples"), c("f1"), c("quality"), c("n_clusters"), c("cohesion"), c("purity")).alias("s"))
    return s.select("label", F.round("s", 6).alias("score"), F.when(F.round("s", 9) >= 0.5, "generate").otherwise("skip").alias("decision"))


VERDICT = "CASE WHEN s >= 0.5 AND gain > 0 THEN 'TP' WHEN s < 0.5 AND gain <= 0 THEN 'TN' WHEN s >= 0.5 THEN 'FP' ELSE 'FN' END"


@query("gb08_gate_validation", P + f"SELECT label, {VERDICT} AS verdict FROM (SELECT label, quality AS s, cohesion - purity AS gain FROM p)")
def _(spark, d):
    return prof(spark, d).select("label", G.verdict(F.when(c("quality") >= 0.5, "generate").otherwise("skip"), c("cohesion") - c("purity")).alias("verdict"))


@query("ag16_gate_scores", P + f"""SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1
 FROM (SELECT count(*) FILTER (v = 'TP') AS tp, count(*) FILTER (v = 'TN') AS tn, count(*) FILTER (v = 'FP') AS fp, count(*) FILTER (v = 'FN') AS fn FROM (SELECT {VERDICT} AS v FROM (SELECT quality AS s, cohesion - purity AS gain FROM p)))""")
def _(spark, d):
    from curatrix.operators.evaluation import verdict_scores

    v = prof(spark, d).select(G.verdict(F.when(c("quality") >= 0.5, "generate").otherwise("skip"), c("cohesion") - c("purity")).alias("v"))
    return rounded(verdict_scores(v, "v"))


RISK = "CASE WHEN purity < 0.30 THEN 'high' WHEN purity < 0.50 THEN 'medium' WHEN purity >= 0.70 THEN 'low' ELSE 'normal' END"
TIMES = "(CASE risk WHEN 'high' THEN {} WHEN 'medium' THEN {} WHEN 'low' THEN {} ELSE 1.0 END)::DOUBLE"


@query("gb09_risk_thresholds", P + f"""SELECT label, risk, round(CASE WHEN n_samples < 30 THEN least(0.95, s * 1.1::DOUBLE) ELSE s END, 6) AS min_similarity, round(CASE WHEN n_samples < 30 THEN least(0.95, k * 1.05::DOUBLE) ELSE k END, 6) AS min_confidence, round(a, 6) AS to_anchor FROM (
 SELECT *, least(0.95, 0.35::DOUBLE * {TIMES.format(1.43, 1.14, 0.85)}) AS s, least(0.95, 0.60::DOUBLE * {TIMES.format(1.33, 1.17, 0.92)}) AS k, least(0.95, 0.50::DOUBLE * {TIMES.format(1.43, 1.14, 0.85)}) AS a FROM (SELECT *, {RISK} AS risk FROM p))""")
def _(spark, d):
    return rounded(prof(spark, d).select("label", G.risk_thresholds(c("purity"), c("n_samples")).alias("t")).select("label", "t.*"))


@query("gb10_cluster_budget", P + f"SELECT label, greatest(5, CASE risk WHEN 'high' THEN CAST(floor(n_samples * 0.5::DOUBLE) AS BIGINT) WHEN 'medium' THEN greatest(8, CAST(floor(n_samples * 0.7::DOUBLE) AS BIGINT)) WHEN 'low' THEN CAST(floor(n_samples * 1.2::DOUBLE) AS BIGINT) ELSE n_samples END) AS budget FROM (SELECT *, {RISK} AS risk FROM p)")
def _(spark, d):
    return prof(spark, d).select("label", G.cluster_budget(c("n_samples"), c("purity")).alias("budget"))


@query("gb11_anchor_gate", P + "SELECT label, quality >= 0.4 AND purity >= CASE WHEN n_samples * 7 < 150 THEN 0.5::DOUBLE * 0.7::DOUBLE ELSE 0.5::DOUBLE END OR label LIKE 'Brand#1%' AS passes FROM p")
def _(spark, d):
    return prof(spark, d).select("label", G.anchor_gate(c("quality"), c("purity"), c("n_samples") * 7, 0.4, 0.5, True, c("label").like("Brand#1%")).alias("passes"))


@query("gb12_auto_anchor_threshold", P + "SELECT round(greatest(0.0, quantile_cont(quality, 0.5) - 0.05), 6) AS threshold FROM p")
def _(spark, d):
    return rounded(G.auto_anchor_threshold(prof(spark, d), "quality"))


SIZED = "(CASE WHEN total < 10000 THEN {} WHEN total < 50000 THEN {} ELSE {} END)::DOUBLE"
TINY = "(CASE WHEN smallest < 50 THEN {} WHEN smallest < 200 THEN {} ELSE 1.0 END)::DOUBLE"


@query("gb13_auto_params", P + f"""SELECT label, round(greatest(0.10, least(0.35, CASE WHEN quality < 0.20 THEN least(q, quality * 1.2::DOUBLE) WHEN quality < 0.30 THEN least(q, quality * 0.9::DOUBLE) ELSE q END)), 6) AS anchor_quality, round(greatest(0.05, least(0.30, k)), 6) AS cap_ratio, round(s, 6) AS similarity, round(f, 6) AS confidence, m AS min_cluster FROM (
 SELECT *, {SIZED.format(0.15, 0.25, 0.30)} * {TINY.format(0.7, 0.85)} AS q, {SIZED.format(0.20, 0.15, 0.10)} * {TINY.format(1.5, 1.2)} * (CASE WHEN imbalance > 50 THEN 1.3 ELSE 1.0 END)::DOUBLE AS k, {SIZED.format(0.85, 0.88, 0.90)} AS s, {SIZED.format(0.05, 0.08, 0.10)} AS f, CASE WHEN total < 10000 THEN 5 WHEN total < 50000 THEN 8 ELSE 10 END AS m
 FROM (SELECT *, n_samples * 3000 * n_clusters AS total, n_clusters * 25 AS smallest, f1 * 100 AS imbalance FROM p))""")
def _(spark, d):
    a = G.auto_params(c("n_samples") * 3000 * c("n_clusters"), c("n_clusters") * 25, c("f1") * 100, c("quality"))
    return rounded(prof(spark, d).select("label", a.alias("a")).select("label", "a.*"))


STEP = "(CASE WHEN quality >= 0.8 THEN {} WHEN quality >= 0.6 THEN {} ELSE {} END)::DOUBLE"


@query("gb14_filter_params", P + f"SELECT label, round({STEP.format(0.40, 0.42, 0.45)}, 6) AS knn, round({STEP.format(0.42, 0.45, 0.48)}, 6) AS similarity, round({STEP.format(0.42, 0.45, 0.48)}, 6) AS anchor, round({STEP.format(1.0, 0.8, 0.5)}, 6) AS cap FROM p")
def _(spark, d):
    return rounded(prof(spark, d).select("label", G.filter_params(c("quality")).alias("a")).select("label", "a.*"))


WEAK = "(CASE WHEN f1 < 0.10 THEN {} WHEN f1 < 0.20 THEN {} WHEN f1 < 0.40 THEN {} ELSE {} END)::DOUBLE"


@query("gb15_adaptive_thresholds", P + f"SELECT label, {WEAK.format(0.37, 0.40, 0.42, 0.44)} AS knn, {WEAK.format(0.40, 0.43, 0.45, 0.47)} AS similarity, {WEAK.format(0.40, 0.43, 0.45, 0.47)} AS anchor, {WEAK.format(2.0, 1.5, 1.0, 1.0)} AS prompt_times, CASE WHEN f1 >= 0.45 THEN 'paraphrase' ELSE 'mix' END AS mode FROM p")
def _(spark, d):
    return prof(spark, d).select("label", G.adaptive_thresholds(c("f1")).alias("a")).select("label", "a.*")


PURE = "CASE WHEN purity < 0.30 THEN {} WHEN purity < 0.45 THEN {} WHEN purity < 0.60 THEN {} ELSE {} END"


@query("gb16_purity_thresholds", P + f"SELECT label, ({PURE.format(0.90, 0.72, 0.63, 0.60)})::DOUBLE AS similarity, ({PURE.format(0.52, 0.45, 0.40, 0.35)})::DOUBLE AS knn, ({PURE.format(0.20, 0.15, 0.12, 0.10)})::DOUBLE AS confidence, " + PURE.format("'critical'", "'high'", "'medium'", "'low'") + " AS level, (CASE WHEN purity >= 0.8 THEN 0.50 WHEN purity >= 0.6 THEN 0.60 WHEN purity >= 0.4 THEN 0.70 ELSE 0.80 END)::DOUBLE AS start FROM p")
def _(spark, d):
    return prof(spark, d).select("label", G.purity_thresholds(c("purity")).alias("a"), G.purity_start(c("purity")).alias("start")).select("label", "a.*", "start")


@query("gb17_cohesion_threshold", P + "SELECT label, (CASE WHEN n_samples < 5 THEN 0.70 WHEN cohesion > 0.7 THEN 0.85 WHEN cohesion > 0.5 THEN 0.70 ELSE 0.55 END)::DOUBLE AS threshold FROM p")
def _(spark, d):
    return prof(spark, d).select("label", G.cohesion_threshold(c("cohesion"), c("n_samples")).alias("threshold"))


@query("gb18_share_budget", P + "SELECT label, k AS per_class, greatest(2, CAST(floor(k / n_clusters::DOUBLE) AS BIGINT)) AS per_cluster FROM (SELECT *, greatest(3, CAST(floor(n_samples * 97 * 0.12::DOUBLE) AS BIGINT)) AS k FROM p)")
def _(spark, d):
    return prof(spark, d).select("label", G.share_budget(c("n"), 0.12, c("n_clusters")).alias("a")).select("label", "a.*")


@query("gb19_caps", P + "SELECT label, least(CAST(floor(n_samples * 0.15::DOUBLE) AS BIGINT), 4) AS both, CAST(floor(n_samples * 0.15::DOUBLE) AS BIGINT) AS ratio, CAST(NULL AS BIGINT) AS unlimited FROM p")
def _(spark, d):
    n = c("n_samples")
    return prof(spark, d).select("label", G.cap(n, 0.15, 4).alias("both"), G.cap(n, 0.15, 0).alias("ratio"), G.cap(n, 0, -1).alias("unlimited"))


@query("cl05_cluster_counts", P + "SELECT label, least(12, greatest(1, CAST(ceil(n_samples / 3.0) AS BIGINT))) AS by_size, CASE WHEN m < 30 THEN 1 WHEN m < 50 THEN greatest(1, least(12, m // 15)) ELSE greatest(1, least(12, m // 30)) END AS adaptive, CASE WHEN purity < 0.03 OR m < 30 THEN least(n_clusters, greatest(3, m // 5)) ELSE n_clusters END AS capped FROM (SELECT *, n_samples * n_clusters AS m FROM p)")
def _(spark, d):
    m = c("n_samples") * c("n_clusters")
    return prof(spark, d).select("label", G.clusters_by_size(c("n_samples"), 3, 12).alias("by_size"), G.cluster_count(m, 12).alias("adaptive"), G.cluster_cap(c("n_clusters"), c("purity"), m).alias("capped"))


@query("ma06_contamination", P + "SELECT label, round(n_clusters / n_samples::DOUBLE * (1.0 - purity), 6) AS contamination, round(greatest(0.0, 1.0 - quality) * 0.5 * (1.0 - cohesion), 6) AS estimated FROM p")
def _(spark, d):
    return rounded(prof(spark, d).select("label", G.contamination(c("n_clusters"), c("n_samples"), c("purity")).alias("contamination"), G.estimated_contamination(c("quality"), c("cohesion")).alias("estimated")))


@query("wn08_quota", """SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS g FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= 2) WHERE g <= least(CAST(floor(n * 0.15::DOUBLE) AS BIGINT), 12)""")
def _(spark, d):
    df = table(spark, d, "documents")
    n = df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    both = df.join(F.broadcast(n), "lang").withColumn("limit", G.cap(c("n"), 0.15, 12))
    return G.quota(both, [c("n_chars").desc(), c("doc_id")], "lang", c("limit"), "source", F.lit(2)).select("doc_id")


@query("ma04_ladders", """SELECT p_partkey, greatest(10, least(30, p_size)) AS clipped, CAST(trunc((p_size - 25) / 7.0::DOUBLE) AS BIGINT) AS towards_zero,
CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 25 THEN 'mid' ELSE 'high' END AS below, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 ELSE 1 END AS reached FROM part""")
def _(spark, d):
    from curatrix.functions import ladders as L

    size = c("p_size")
    steps = L.below(size, [(10, "low"), (25, "mid")], "high"), L.at_least(size, [(40, 3), (20, 2)], 1)
    return table(spark, d, "part").select("p_partkey", L.clip(size, 10, 30).alias("clipped"), L.whole((size - 25) / 7.0).alias("towards_zero"), steps[0].alias("below"), steps[1].alias("reached"))
