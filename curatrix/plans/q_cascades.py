"""Filter cascades, deduplication and weights over vectors and documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators import cascades as X
from curatrix.operators import dedup as D
from curatrix.operators import gates as G
from curatrix.operators import neighbors as N
from curatrix.operators import weights as W
from curatrix.plans.q_text import SH
from curatrix.plans.registry import CENTROIDS, EMB, query, rounded, table

c = F.col

#: Every vector is a candidate, all others are its references; a hash stands in for a model's probabilities.
U = "('0x' || substr(md5('{}/' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
CAND = f"""{CENTROIDS}, cand AS (SELECT e.*, list_cosine_similarity(e.v, c.cv) AS sim, list_distance(e.v, c.cv) AS dist, CAST(10 + vec_id % 180 AS INTEGER) AS tokens, {U.format('a')} AS p0, {U.format('b')} AS p1 FROM e JOIN c USING (label)),
ne AS (SELECT a.vec_id, b.label = a.label AS own, b.vec_id AS k, list_cosine_similarity(a.v, b.v) AS s, list_distance(a.v, b.v) AS d FROM cand a JOIN e b ON a.vec_id <> b.vec_id),
nx AS (SELECT vec_id, max(s) AS nearest_sim FROM ne GROUP BY vec_id),
kn AS (SELECT vec_id, avg(s) AS knn_sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, k) AS r FROM ne WHERE own) WHERE r <= 15 GROUP BY vec_id),
kd AS (SELECT vec_id, avg(d) AS knn_dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), k) AS r FROM ne WHERE own) WHERE r <= 10 GROUP BY vec_id),
ot AS (SELECT vec_id, max(list_cosine_similarity(v, cv)) AS other_sim FROM e JOIN c ON e.label <> c.label GROUP BY vec_id),
nb AS (SELECT cand.vec_id, list_cosine_similarity(cand.v, b.v) AS anchor_sim FROM cand JOIN e b ON b.vec_id = cand.vec_id + 1),
f AS (SELECT cand.*, nearest_sim, knn_sim, knn_dist, other_sim, coalesce(anchor_sim, -1) AS anchor_sim FROM cand JOIN nx USING (vec_id) JOIN kn USING (vec_id) JOIN kd USING (vec_id) JOIN ot USING (vec_id) LEFT JOIN nb USING (vec_id))"""


def uniform(name):
    return F.conv(F.substring(F.md5(F.concat(F.lit(name + "/"), c("vec_id").cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0


def emb(spark, d):
    return table(spark, d, "embeddings")


def features(spark, d):
    """Candidates with all measures of the cascades."""
    e = emb(spark, d)
    cents = V.mean_vector(e, ["label"], "embedding")
    base = X.centroid_features(e, "label").withColumnRenamed("distance", "dist")
    base = base.withColumns({"tokens": (10 + c("vec_id") % 180).cast("int"), "p0": uniform("a"), "p1": uniform("b")})
    near = N.nearest(e, e, 1).select(c("q").alias("vec_id"), c("score").alias("nearest_sim"))
    knn = X.knn_similarity(e, e, 15).withColumnRenamed("knn", "knn_sim")
    dist = X.knn_similarity(e, e, 10, metric="euclidean").withColumnRenamed("knn", "knn_dist")
    neighbour = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("nv"))
    base = X.nearest_other(base, "label", cents).join(near, "vec_id").join(knn, "vec_id").join(dist, "vec_id").join(neighbour, "vec_id", "left")
    return base.withColumn("anchor_sim", F.coalesce(V.cosine(c("embedding"), c("nv")), F.lit(-1.0))).drop("nv")


def with_proba(df):
    p = F.array(c("p0"), c("p1"), 1 - c("p0"))
    return df.withColumns({"proba": p, "target": F.lit(0), "neighbour_sim": F.lit(-1.0), "confuser_sim": F.lit(None).cast("double"), "text_dup": c("vec_id") % 15 == 0})


CLF = "p0 >= p1 AND p0 >= 1 - p0 AND p0 >= {least} AND p0 - greatest(p1, 1 - p0) >= 0.05"
MAIN = f"""CASE WHEN NOT tokens BETWEEN 15 AND 180 THEN 'length' WHEN NOT (round(sim, 9) >= 0.15 OR round(anchor_sim, 9) >= 0.2) THEN 'similarity' WHEN round(other_sim, 9) >= 0.30 THEN 'repel' WHEN round(nearest_sim, 9) >= 0.38 THEN 'semdup'
 WHEN NOT (({CLF.format(least=0.5)}) OR round(knn_sim, 9) >= 0.22) THEN 'classifier' WHEN vec_id % 15 = 0 THEN 'dup_ref' ELSE 'accepted' END"""


def main(spark, d):
    f = with_proba(features(spark, d))
    f = f.withColumns({k: F.round(k, 9) for k in ("sim", "anchor_sim", "other_sim", "nearest_sim", "knn_sim")})
    return X.main_cascade(f, threshold=0.23, slack=0.08, to_anchor=0.2, repel=0.30, dedup=0.38, knn_least=0.22, least=0.5, least_margin=0.05)


@query("fl_main_cascade", f"WITH {CAND} SELECT vec_id, label, {MAIN} AS reason FROM f")
def _(spark, d):
    return main(spark, d).select("vec_id", "label", "reason")


@query("ag12_acceptance", f"WITH {CAND}, r AS (SELECT label, {MAIN} AS reason FROM f), g AS (SELECT label, reason, count(*) AS n FROM r GROUP BY GROUPING SETS ((label, reason), (reason))) SELECT label, reason, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM g")
def _(spark, d):
    from curatrix.operators.classes import rejections

    return rounded(rejections(main(spark, d), "label", "reason"))


@query("ag13_acceptance_extremes", f"WITH {CAND}, r AS (SELECT label, avg(CASE WHEN {MAIN} = 'accepted' THEN 1.0 ELSE 0.0 END) AS rate FROM f GROUP BY label) SELECT label, round(rate, 6) AS rate, side, CAST(rank AS INTEGER) AS rank FROM (SELECT label, rate, 'best' AS side, row_number() OVER (ORDER BY rate DESC, label) AS rank FROM r UNION ALL SELECT label, rate, 'worst', row_number() OVER (ORDER BY rate, label) FROM r) WHERE rank <= 5")
def _(spark, d):
    from curatrix.operators.evaluation import best_and_worst

    r = main(spark, d).groupBy("label").agg(F.avg((c("reason") == "accepted").cast("double")).alias("rate")).withColumn("all", F.lit(1))
    return rounded(best_and_worst(r, "all", "rate", "label", 5).drop("all"))


@query("ag14_metric_distributions", f"WITH {CAND} SELECT label, count(sim) AS n, round(avg(sim), 6) AS mean, round(stddev_samp(sim), 6) AS std, round(min(sim), 6) AS least, round(max(sim), 6) AS most, round(quantile_cont(sim, 0.25), 6) AS q25, round(quantile_cont(sim, 0.5), 6) AS q50, round(quantile_cont(sim, 0.75), 6) AS q75 FROM cand GROUP BY label")
def _(spark, d):
    from curatrix.operators.classes import distribution

    return rounded(distribution(X.centroid_features(emb(spark, d)), c("sim"), ["label"]))


@query("fl02_similarity_test", f"WITH {CAND} SELECT vec_id, round(sim, 9) >= greatest(0.10, 0.15::DOUBLE) OR round(anchor_sim, 9) >= 0.2 AS passes FROM f")
def _(spark, d):
    f = features(spark, d)
    return f.select("vec_id", X.similar_enough(F.round("sim", 9), F.round("anchor_sim", 9), F.lit(-1.0), F.lit(0.10), 0.23, 0.08, 0.2).alias("passes"))


@query("fl03_classifier_test", f"SELECT vec_id, {CLF.format(least=0.5)} AS passes, round(greatest(p0, p1, 1 - p0) - (p0 + p1 + 1 - p0 - greatest(p0, p1, 1 - p0) - least(p0, p1, 1 - p0)), 6) AS margin FROM (SELECT vec_id, {U.format('a')} AS p0, {U.format('b')} AS p1 FROM embeddings)")
def _(spark, d):
    f = with_proba(emb(spark, d).withColumns({"p0": uniform("a"), "p1": uniform("b")}))
    return f.select("vec_id", X.classifier_ok(c("proba"), c("target"), F.lit(1.0), 0.5, 1.0, 0.05).alias("passes"), F.round(V.margin(c("proba")), 6).alias("margin"))


@query("ar01_margin_argmax", f"SELECT vec_id, round(greatest(p0, p1) - least(p0, p1), 6) AS margin, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS best FROM (SELECT vec_id, {U.format('a')} AS p0, {U.format('b')} AS p1 FROM embeddings)")
def _(spark, d):
    p = F.array(uniform("a"), uniform("b"))
    return emb(spark, d).select("vec_id", F.round(V.margin(p), 6).alias("margin"), V.argmax(p).cast("int").alias("best"))


@query("fl04_knn_test", f"WITH {CAND} SELECT vec_id, round(knn_sim, 6) AS knn_sim, round(knn_sim, 9) >= 0.2 AS passes FROM kn")
def _(spark, d):
    e = emb(spark, d)
    k = X.knn_similarity(e, e, 15)
    return k.select("vec_id", F.round("knn", 6).alias("knn_sim"), (F.round("knn", 9) >= 0.2).alias("passes"))


@query("fl05_batch_duplicates", f"""WITH RECURSIVE {SH.format("documents")}, x AS MATERIALIZED (SELECT doc_id, lang, hash(unnest(s)) AS g, len(s) AS n FROM sh JOIN documents USING (doc_id)),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.lang = b.lang AND a.doc_id < b.doc_id AND a.n > 0.85 * b.n AND b.n > 0.85 * a.n GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.85),
o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM (SELECT b AS doc_id FROM p GROUP BY b)), n AS MATERIALIZED (SELECT o.doc_id, o.k, list(p.a) AS before FROM o JOIN p ON p.b = o.doc_id GROUP BY o.doc_id, o.k),
w AS (SELECT 0::BIGINT AS k, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT n.k, CASE WHEN len(list_filter(n.before, lambda y: NOT list_contains(w.gone, y))) > 0 THEN list_append(w.gone, n.doc_id) ELSE w.gone END FROM w JOIN n ON n.k = w.k + 1)
SELECT doc_id, NOT list_contains((SELECT gone FROM w ORDER BY k DESC LIMIT 1), doc_id) AS kept FROM documents""")
def _(spark, d):
    return X.batch_duplicates(table(spark, d, "documents"), "lang", "doc_id", "doc_id").select("doc_id", "kept")


@query("fl06_grace", f"""WITH {CAND}, r AS (SELECT *, {MAIN} AS reason, 0.6 * anchor_sim + 0.4 * sim AS g FROM f), a AS (SELECT *, count(*) FILTER (reason = 'accepted') OVER (PARTITION BY vec_id // 25) AS k FROM r)
SELECT vec_id, round(g, 6) AS score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY round(g, 9) DESC, vec_id) AS n FROM a WHERE k = 0 AND tokens BETWEEN 15 AND 180 AND (anchor_sim >= 0.05 OR g >= 0.1) AND {CLF.format(least=0.35)} AND other_sim < 0.4) WHERE n <= 1""")
def _(spark, d):
    x = main(spark, d).withColumn("spec", F.floor(c("vec_id") / 25))
    f = features(spark, d).select("vec_id", "sim", "anchor_sim", "other_sim")
    g = X.grace(x.drop("sim", "anchor_sim", "other_sim").join(f, "vec_id"), "spec", "vec_id", 1, least_anchor=0.05, least_score=0.1, least_conf=0.35, least_margin=0.05, repel=0.4)
    return g.select("vec_id", F.round("grace_score", 6).alias("score"), c("grace_rank").alias("rank"))


@query("fl07_contamination_aware", f"""WITH {CAND}, x AS (SELECT vec_id, anchor_sim, knn_sim, p0, p1, least(0.95, 0.15 * t) AS ms, least(0.95, 0.4 * u) AS mc, least(0.95, 0.1 * t) AS ta FROM (SELECT *, CASE WHEN p1 < 0.3 THEN 1.43 WHEN p1 < 0.5 THEN 1.14 WHEN p1 >= 0.7 THEN 0.85 ELSE 1.0 END::DOUBLE AS t, CASE WHEN p1 < 0.3 THEN 1.33 WHEN p1 < 0.5 THEN 1.17 WHEN p1 >= 0.7 THEN 0.92 ELSE 1.0 END::DOUBLE AS u FROM f)),
y AS (SELECT *, list_filter([CASE WHEN anchor_sim < ta THEN 'anchor_similarity' END, CASE WHEN knn_sim < ms THEN 'knn_similarity' END, CASE WHEN p0 < mc THEN 'classifier_confidence' END], lambda z: z IS NOT NULL) AS bad FROM x)
SELECT vec_id, len(bad) = 0 AS accepted, CASE WHEN len(bad) = 0 THEN 'accepted' WHEN len(bad) = 1 THEN 'failed_' || bad[1] ELSE 'failed_multiple (' || array_to_string(bad, ', ') || ')' END AS reason, round(CASE WHEN len(bad) = 0 THEN p0 ELSE p0 * (1.0 - 0.2 * 0.05 * (1.0 - p1)) END, 6) AS score FROM y""")
def _(spark, d):
    f = features(spark, d)
    t = G.risk_thresholds(c("p1"), F.lit(100), 0.15, 0.4, 0.1)
    x = X.contamination_aware(c("anchor_sim"), c("knn_sim"), c("p0"), t, c("p1"), F.lit(0.05))
    return rounded(f.select("vec_id", x.alias("x")).select("vec_id", "x.*"))


@query("fl09_hard_filters", f"WITH {CAND}, q AS (SELECT label, quantile_cont(dist, 0.9) AS q FROM f GROUP BY label) SELECT vec_id, CASE WHEN round(dist, 9) >= round(q, 9) THEN 'length' WHEN sim <= 0.1 THEN 'similarity' WHEN knn_dist > 1.25 THEN 'knn' WHEN ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15 THEN 'confidence' ELSE 'accepted' END AS reason FROM f JOIN q USING (label)")
def _(spark, d):
    return X.hard_filters(features(spark, d), "label", "dist", "sim", "knn_dist", 0.1, 1.25, drop_share=0.15).select("vec_id", "reason")


SCORES = """s AS (SELECT *, (1 - dist / (max(dist) OVER w + 1e-6)) AS l, greatest(0.0, least(1.0, sim)) AS i FROM f WINDOW w AS (PARTITION BY label))"""


@query("fl10_cascade_scores", f"WITH {CAND}, {SCORES} SELECT vec_id, round(l * i * exp(-knn_dist) * l, 6) AS product, round(pow(l * i / (1 + knn_dist) * l, 0.25), 6) AS geometric, round(pow(1 / (1 + dist) * greatest(0.0, sim) / (1 + knn_dist) / (1 + dist), 0.25), 6) AS reciprocal FROM s")
def _(spark, d):
    f = features(spark, d)
    for how in ("product", "geometric", "reciprocal"):
        f = X.quality_scores(f, "label", "dist", "sim", "knn_dist", "dist", how).withColumnRenamed("score", how)
    return rounded(f.select("vec_id", "product", "geometric", "reciprocal"))


@query("wn02_quota_with_floor", f"WITH {CAND}, {SCORES} SELECT label, vec_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(x, 9) DESC, vec_id) AS r FROM (SELECT *, l * i * exp(-knn_dist) * l AS x FROM s) WHERE x >= 0.001) WHERE r <= 4")
def _(spark, d):
    f = X.quality_scores(features(spark, d), "label", "dist", "sim", "knn_dist", "dist")
    return X.top_quota(f, "label", "score", 4, 0.001).select("label", "vec_id", "rank")


@query("wn03_rank_only", f"WITH {CAND}, {SCORES} SELECT label, vec_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(pow(l * i / (1 + knn_dist) * l, 0.25), 9) DESC, vec_id) AS r FROM s) WHERE r <= 4")
def _(spark, d):
    f = X.quality_scores(features(spark, d), "label", "dist", "sim", "knn_dist", "dist", "geometric")
    return X.top_quota(f, "label", "score", 4).select("label", "vec_id", "rank")


@query("wn04_percentile_cascade", f"""WITH {CAND}, q1 AS (SELECT label, quantile_cont(dist, 0.9) AS q FROM f GROUP BY label), a AS (SELECT f.* FROM f JOIN q1 USING (label) WHERE round(dist, 9) < round(q, 9)), q2 AS (SELECT label, quantile_cont(sim, 0.2) AS q FROM a GROUP BY label), b AS (SELECT a.* FROM a JOIN q2 USING (label) WHERE round(sim, 9) >= round(q, 9)),
q3 AS (SELECT label, quantile_cont(knn_sim, 0.2) AS q FROM b GROUP BY label) SELECT vec_id FROM b JOIN q3 USING (label) WHERE round(knn_sim, 9) >= round(q, 9)""")
def _(spark, d):
    return X.percentile_cascade(features(spark, d), "label", [("dist", "under", 0.9), ("sim", "from", 0.2), ("knn_sim", "from", 0.2)]).select("vec_id")


@query("wn09_ratio_to_max", f"WITH {CAND} SELECT vec_id, round(1 - dist / max(dist) OVER (PARTITION BY label), 6) AS ratio FROM cand")
def _(spark, d):
    f = X.centroid_features(emb(spark, d))
    return rounded(f.select("vec_id", (1 - c("distance") / F.max("distance").over(Window.partitionBy("label"))).alias("ratio")))


@query("fl11_relaxation", f"""WITH {CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS r FROM cand), g AS (SELECT label, max(sim) FILTER (r = 4) AS kth, max(sim) AS best FROM k GROUP BY label),
u AS (SELECT label, best, (SELECT max(t) FROM (SELECT unnest([0.3, 0.2, 0.1])::DOUBLE AS t) WHERE t <= kth) AS t FROM g)
SELECT vec_id, CASE WHEN t IS NOT NULL THEN t WHEN best >= 0.1 THEN 0.1::DOUBLE END AS used FROM k JOIN u USING (label) WHERE CASE WHEN t IS NOT NULL THEN r <= 4 WHEN best >= 0.1 THEN sim >= 0.1 ELSE r <= 4 END""")
def _(spark, d):
    f = X.centroid_features(emb(spark, d))
    return X.relaxed(f, "label", "sim", F.lit(0.3), 4, 0.1).select("vec_id", "used")


@query("fl12_max_similarity", f"WITH {CAND} SELECT vec_id, round(max(s), 6) AS nearest_sim FROM ne WHERE own GROUP BY vec_id HAVING round(max(s), 9) >= 0.25")
def _(spark, d):
    e = emb(spark, d)
    near = N.nearest(e, e, 1, query_group="label", corpus_group="label")
    return near.filter(F.round("score", 9) >= 0.25).select(c("q").alias("vec_id"), F.round("score", 6).alias("nearest_sim"))


@query("fl13_discriminator_zones", f"SELECT vec_id, (CASE WHEN p < 0.7 THEN 1.0 WHEN p < 0.9 THEN 0.5 ELSE 0.0 END)::DOUBLE AS zone_weight, round(1 - p, 6) AS weight FROM (SELECT vec_id, {U.format('a')} AS p FROM embeddings)")
def _(spark, d):
    return rounded(emb(spark, d).select("vec_id", X.discriminator_weight(uniform("a")).alias("x")).select("vec_id", "x.*"))


@query("fl14_trusted", f"SELECT vec_id FROM (SELECT vec_id, label, {U.format('a')} AS p FROM embeddings) WHERE p >= 0.7 AND label = vec_id % 10")
def _(spark, d):
    f = emb(spark, d).withColumns({"p": uniform("a"), "predicted": (c("vec_id") % 10).cast("int")})
    return X.trusted(f, "p", "predicted", "label").select("vec_id")


@query("jn08_agreement", "SELECT vec_id FROM embeddings WHERE label = vec_id % 10")
def _(spark, d):
    return X.trusted(emb(spark, d).withColumns({"p": F.lit(1.0), "predicted": (c("vec_id") % 10).cast("int")}), "p", "predicted", "label").select("vec_id")


@query("ag10_confidence_floor", f"SELECT label, count(*) AS n, round(quantile_cont(p, 0.2), 6) AS floor FROM (SELECT label, {U.format('a')} AS p FROM embeddings) GROUP BY label")
def _(spark, d):
    from curatrix.operators.classes import confidence_floor

    return rounded(confidence_floor(emb(spark, d).withColumn("p", uniform("a")), "label", "p"))


@query("ag11_cluster_floor", f"WITH {CENTROIDS} SELECT label, round(quantile_cont(s, 0.25), 6) AS floor, round(avg(s), 6) AS purity FROM (SELECT label, list_cosine_similarity(v, cv) AS s FROM e JOIN c USING (label)) GROUP BY label")
def _(spark, d):
    f = X.centroid_features(emb(spark, d))
    return rounded(f.groupBy("label").agg(F.percentile("sim", 0.25).alias("floor"), F.avg("sim").alias("purity")))


@query("ag27_neighbour_audit", f"WITH {CAND} SELECT label, count(*) FILTER (sim < 0.15) AS low_sim, count(*) FILTER (p0 < 0.3) AS low_conf, count(*) FILTER (knn_sim < 0.2) AS low_knn, count(*) FILTER (sim < 0.15 OR p0 < 0.3 OR knn_sim < 0.2) AS low_any FROM f GROUP BY label")
def _(spark, d):
    f, bad = features(spark, d), {"low_sim": c("sim") < 0.15, "low_conf": c("p0") < 0.3, "low_knn": c("knn_sim") < 0.2}
    every = bad | {"low_any": bad["low_sim"] | bad["low_conf"] | bad["low_knn"]}
    return f.groupBy("label").agg(*(F.count_if(v).alias(k) for k, v in every.items()))


#: Greedy deduplication as a walk over rows in order, for DuckDB.
WALK = """WITH RECURSIVE {emb}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) > {t} {extra}),
o AS (SELECT e.vec_id, row_number() OVER (ORDER BY {order}) AS k FROM e), n AS (SELECT o.vec_id, o.k, list(x.other) AS before FROM o LEFT JOIN (SELECT CASE WHEN oa.k < ob.k THEN p.b ELSE p.a END AS id, CASE WHEN oa.k < ob.k THEN p.a ELSE p.b END AS other FROM p JOIN o oa ON oa.vec_id = p.a JOIN o ob ON ob.vec_id = p.b) x ON x.id = o.vec_id GROUP BY o.vec_id, o.k),
w AS (SELECT 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.k, CASE WHEN list_has_any(w.kept, n.before) THEN w.kept ELSE list_append(w.kept, n.vec_id) END FROM w JOIN n ON n.k = w.k + 1)
SELECT vec_id, list_contains((SELECT kept FROM w ORDER BY k DESC LIMIT 1), vec_id) AS kept FROM e"""


@query("dd01_greedy_dedup", WALK.format(emb=EMB, t=0.3, extra="", order="e.vec_id"))
def _(spark, d):
    return D.greedy_dedup(emb(spark, d), 0.3).select("vec_id", "kept")


@query("dd02_classwise_dedup", WALK.format(emb=EMB, t=0.2, extra="AND a.label = b.label", order="e.vec_id"))
def _(spark, d):
    return D.greedy_dedup(emb(spark, d), 0.2, group="label").select("vec_id", "kept")


@query("dd03_representatives")
def _(spark, d):
    from curatrix.operators.clusters import representatives

    return representatives(emb(spark, d))


@query("dd04_cross_component_dedup", WALK.format(emb=EMB, t=0.25, extra="AND a.vec_id % 3 <> b.vec_id % 3", order="e.vec_id % 3, e.vec_id"))
def _(spark, d):
    return D.greedy_dedup(emb(spark, d).withColumn("component", c("vec_id") % 3), 0.25, component="component").select("vec_id", "kept")


@query("an10_anchor_dedup", WALK.format(emb=EMB, t=0.25, extra="", order="e.label, e.vec_id").replace("> 0.25", ">= 0.25"))
def _(spark, d):
    from curatrix.operators.anchors import dedup_anchors

    return dedup_anchors(emb(spark, d), "label", 0.25).select("vec_id", "kept")


@query("se01_union_components", "SELECT 'real' AS origin, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT 'synthetic', count(*) FROM embeddings WHERE vec_id % 5 = 0")
def _(spark, d):
    e = emb(spark, d)
    both = e.filter("vec_id % 5 <> 0").unionByName(e.filter("vec_id % 5 = 0").withColumn("origin", F.lit("synthetic")), allowMissingColumns=True)
    return both.groupBy(F.coalesce("origin", F.lit("real")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query("se02_exact_dedup", "SELECT doc_id, doc_id % 3 AS component FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    t = table(spark, d, "documents").withColumn("component", c("doc_id") % 3)
    return D.exact_keep_first(t, "text", [c("component"), c("doc_id")]).select("doc_id", "component")


@query("se04_class_coverage_difference", "SELECT lang, source FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents) EXCEPT SELECT lang, source FROM documents")
def _(spark, d):
    t = table(spark, d, "documents").select("lang", "source").distinct()
    expected = t.select("lang").distinct().join(F.broadcast(t.select("source").distinct()))  # names of classes, not rows
    return expected.join(t, ["lang", "source"], "left_anti")


@query("dv04_weighted_sample", "SELECT vec_id, k AS component FROM (SELECT vec_id, vec_id % 3 AS k, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT, vec_id) AS r, count(*) OVER (PARTITION BY vec_id % 3) AS n FROM embeddings) WHERE r <= floor(n * 0.8::DOUBLE * CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE)")
def _(spark, d):
    return D.weighted_sample(emb(spark, d).withColumn("component", c("vec_id") % 3), "component", "vec_id", {0: 0.5, 1: 0.3, 2: 0.2}).select("vec_id", "component")


@query("wt01_synthetic_weights", f"SELECT vec_id, round(CASE WHEN vec_id % 5 = 0 THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS flat, round(CASE WHEN vec_id % 5 = 0 THEN 0.5 * p ELSE 1.0 END, 6) AS confident FROM (SELECT vec_id, {U.format('a')} AS p FROM embeddings)")
def _(spark, d):
    s = c("vec_id") % 5 == 0
    return rounded(emb(spark, d).select("vec_id", W.synthetic_weight(s).alias("flat"), W.synthetic_weight(s, confidence=uniform("a")).alias("confident")))


@query("wt02_adaptive_weights", f"SELECT vec_id, round(greatest(0.1, least(1.0, 0.3 * pow(p, 1.5) * q)), 6) AS weight FROM (SELECT vec_id, {U.format('a')} AS p, {U.format('b')} AS q FROM embeddings)")
def _(spark, d):
    return rounded(emb(spark, d).select("vec_id", W.adaptive_weight(uniform("a"), uniform("b")).alias("weight")))


F1S = "f1 AS (SELECT label, label / 15.0::DOUBLE AS f1 FROM (SELECT DISTINCT label FROM embeddings))"
TIERED = "CASE WHEN f1 < 0.15 THEN {} WHEN f1 < 0.20 THEN {} WHEN f1 < 0.45 THEN {} ELSE {} END"


def f1s(spark, d):
    return emb(spark, d).select("label").distinct().withColumn("f1", c("label") / 15.0)


@query("wt03_tier_weights", f"WITH {F1S} SELECT label, (CASE WHEN f1 < 0.15 THEN 0.5 WHEN f1 < 0.30 THEN 0.3 WHEN f1 < 0.45 THEN 0.1 ELSE 0.05 END)::DOUBLE AS weight, CASE WHEN f1 < 0.2 THEN 'LOW' WHEN f1 < 0.45 THEN 'MID' ELSE 'HIGH' END AS band FROM f1")
def _(spark, d):
    return f1s(spark, d).select("label", W.f1_weight(c("f1")).alias("weight"), W.band(c("f1")).alias("band"))


CW = f"{F1S}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), cw AS (SELECT label, n, " + TIERED.format("'very_low'", "'low'", "'mid'", "'high'") + " AS tier, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n) * " + TIERED.format(2.5, 2.0, 1.5, 1.0) + "::DOUBLE AS weight FROM n JOIN f1 USING (label))"


@query("wt04_class_weights", f"WITH {CW} SELECT label, n, tier, round(weight, 6) AS weight FROM cw")
def _(spark, d):
    return rounded(W.class_weights(emb(spark, d), "label", f1s(spark, d)))


@query("wt05_focal_weights", f"WITH {CW}, x AS (SELECT vec_id, label, pow(1 - {U.format('a')}, 2) AS w FROM embeddings), y AS (SELECT vec_id, label, w / (avg(w) OVER () + 1e-8) AS focal FROM x), z AS (SELECT vec_id, focal, weight * CASE WHEN vec_id % 5 = 0 THEN 0.5 ELSE 1.0 END * focal AS w FROM y JOIN cw USING (label)) SELECT vec_id, round(focal, 6) AS focal, round(w / (avg(w) OVER () + 1e-8), 6) AS weight FROM z")
def _(spark, d):
    x = W.focal(emb(spark, d).withColumn("p", uniform("a")), "p").join(W.class_weights(emb(spark, d), "label", f1s(spark, d)).select("label", c("weight").alias("cw")), "label")
    x = W.combined(x.withColumn("syn", c("vec_id") % 5 == 0), "cw", "syn", "focal")
    return rounded(x.select("vec_id", "focal", "weight"))


@query("wt06_stage_two_weights", f"SELECT vec_id, round(p * 0.5 / (avg(p * 0.5) OVER () + 1e-8) * 0.5, 6) AS weight FROM (SELECT vec_id, {U.format('a')} AS p FROM embeddings)")
def _(spark, d):
    return rounded(W.stage_two(emb(spark, d).withColumn("p", uniform("a")), "p").select("vec_id", "weight"))


@query("jn01_class_lookup", f"WITH {F1S} SELECT vec_id, round(coalesce(CASE WHEN f1.label < 5 THEN f1 END, 0.5), 6) AS f1 FROM embeddings JOIN f1 USING (label)")
def _(spark, d):
    known = f1s(spark, d).filter("label < 5")
    return rounded(emb(spark, d).join(F.broadcast(known), "label", "left").select("vec_id", F.coalesce("f1", F.lit(0.5)).alias("f1")))


@query("jn02_own_centroid", f"WITH {CENTROIDS} SELECT vec_id, round(list_cosine_similarity(v, cv), 6) AS sim, round(list_distance(v, cv), 6) AS distance FROM e JOIN c USING (label)")
def _(spark, d):
    return rounded(X.centroid_features(emb(spark, d)).select("vec_id", "sim", "distance"))
