"""Vector queries: similarity, neighbours, class quality, anchors, clusters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators import anchors as A
from curatrix.operators import classes as C
from curatrix.operators import clusters as K
from curatrix.operators import index as I
from curatrix.operators import neighbors as N
from curatrix.plans.registry import CENTROIDS, EMB, query, rounded, table
from curatrix.sources.storage import stored

c = F.col


def emb(spark, d):
    return table(spark, d, "embeddings")


COS, DIST = "list_cosine_similarity({}.v, {}.v)", "list_distance({}.v, {}.v)"
#: Ranked neighbours by cosine and by distance.
NC = EMB + ", nc AS (SELECT a.vec_id AS q, a.label AS ql, b.vec_id AS k, b.label AS kl, round(list_cosine_similarity(a.v, b.v), 12) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id)"
SIMS = CENTROIDS + ", s AS (SELECT e.vec_id, e.label, e.v, c.cv, list_cosine_similarity(e.v, c.cv) AS sim FROM e JOIN c USING (label))"


@query("ma01_cosine", f"WITH {EMB} SELECT a.vec_id, round({COS.format('a', 'b')}, 6) AS cosine, round(1 - {COS.format('a', 'b')}, 6) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    a, b = emb(spark, d).alias("a"), emb(spark, d).alias("b")
    s = V.cosine(c("a.embedding"), c("b.embedding"))
    return rounded(a.join(b, c("b.vec_id") == c("a.vec_id") + 1).select("a.vec_id", s.alias("cosine"), (1 - s).alias("distance")))


@query("ma02_euclidean", f"WITH {EMB}, x AS (SELECT a.vec_id, a.label, {DIST.format('a', 'b')} AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(d, 6) AS d, round(1 - d / max(d) OVER (PARTITION BY label), 6) AS normalized FROM x")
def _(spark, d):
    a, b = emb(spark, d).alias("a"), emb(spark, d).alias("b")
    x = a.join(b, c("b.vec_id") == c("a.vec_id") + 1).select("a.vec_id", "a.label", V.euclidean(c("a.embedding"), c("b.embedding")).alias("d"))
    return rounded(x.select("vec_id", "d", (1 - c("d") / F.max("d").over(Window.partitionBy("label"))).alias("normalized")))


@query("ma03_interpolate", f"WITH {EMB} SELECT vec_id, round(x, 6) AS x, CAST(i - 1 AS INTEGER) AS i FROM (SELECT a.vec_id, unnest(list_transform(list_zip(a.v, b.v), lambda p: p[1] + 0.25::DOUBLE * (p[2] - p[1]))) AS x, generate_subscripts(a.v, 1) AS i FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)")
def _(spark, d):
    a, b = emb(spark, d).alias("a"), emb(spark, d).alias("b")
    return rounded(a.join(b, c("b.vec_id") == c("a.vec_id") + 1).select("a.vec_id", F.posexplode(V.interpolate(c("a.embedding"), c("b.embedding"), F.lit(0.25))).alias("i", "x")))


@query("ag03_class_centroids", f"WITH {CENTROIDS} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS x FROM cp")
def _(spark, d):
    return rounded(V.mean_vector(emb(spark, d), ["label"], "embedding").select("label", F.posexplode("centroid").alias("i", "x")))


@query("ag06_class_cohesion", f"WITH {EMB} SELECT a.label, round(avg({COS.format('a', 'b')}), 6) AS cohesion FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def _(spark, d):
    return rounded(C.cohesion(emb(spark, d), "label").select("label", "cohesion"))


@query("ag07_class_separation", f"WITH {CENTROIDS} SELECT a.label, round(min(1 - list_cosine_similarity(a.cv, b.cv)), 6) AS separation FROM c a JOIN c b ON a.label <> b.label GROUP BY a.label")
def _(spark, d):
    return rounded(C.separation(emb(spark, d), "label"))


@query("ag08_knn_purity", f"WITH {NC} SELECT ql AS label, round(avg(p), 6) AS purity FROM (SELECT q, ql, avg(CASE WHEN ql = kl THEN 1.0 ELSE 0.0 END) AS p FROM nc WHERE r <= 10 GROUP BY q, ql) GROUP BY ql")
def _(spark, d):
    return rounded(N.purity(emb(spark, d), emb(spark, d), 10).groupBy("label").agg(F.avg("purity").alias("purity")))


QUALITY = f"""{NC}, pu AS (SELECT ql AS label, avg(CASE WHEN ql = kl THEN 1.0 ELSE 0.0 END) AS purity FROM nc WHERE r <= 10 GROUP BY ql),
cp AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS cv FROM cp GROUP BY label),
se AS (SELECT a.label, min(1 - list_cosine_similarity(a.cv, b.cv)) AS separation FROM c a JOIN c b ON a.label <> b.label GROUP BY a.label),
co AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS cohesion FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
aq AS (SELECT label, n, cohesion, purity, separation, 0.4 * cohesion + 0.4 * purity + 0.2 * separation AS quality FROM n JOIN pu USING (label) JOIN se USING (label) JOIN co USING (label))"""


@query("ag09_anchor_quality", f"WITH {QUALITY} SELECT label, n, round(cohesion, 6) AS cohesion, round(purity, 6) AS purity, round(separation, 6) AS separation, round(quality, 6) AS quality, quality >= 0.15 AS generate FROM aq")
def _(spark, d):
    return rounded(C.anchor_quality(emb(spark, d), threshold=0.15))


@query("gate_and_budget", f"WITH {QUALITY} SELECT label, round(quality, 6) AS quality, quality >= 0.15 AND purity >= 0.05 AS passes, greatest(10, CAST(floor(floor(n * 5 * 0.08::DOUBLE) * 0.1::DOUBLE * 0.3::DOUBLE * 1.0::DOUBLE) AS BIGINT)) AS budget FROM aq")
def _(spark, d):
    from curatrix.operators import gates as G

    q = C.anchor_quality(emb(spark, d), threshold=0.15)
    return rounded(q.select("label", "quality", G.anchor_gate(c("quality"), c("purity"), c("n"), 0.15, 0.05).alias("passes"), G.enhanced_budget(c("n") * 5, c("quality"), c("purity"), F.lit(0.3)).alias("budget")))


@query("ag21_diversity", f"WITH {EMB} SELECT a.label, round(avg({DIST.format('a', 'b')}), 6) AS diversity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def _(spark, d):
    from curatrix.operators.cascades import class_diversity

    return rounded(class_diversity(emb(spark, d)))


@query("ag22_semantic_drift", f"WITH {EMB}, x AS (SELECT b.vec_id, b.label, min({DIST.format('a', 'b')}) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY b.vec_id, b.label) SELECT label, round(avg(d), 6) AS drift FROM x GROUP BY label")
def _(spark, d):
    e = emb(spark, d)
    near = N.nearest(e, e, 1, "euclidean")
    return rounded(near.join(e.select(c("vec_id").alias("q"), "label"), "q").groupBy("label").agg(F.avg("score").alias("drift")))


@query("ag23_silhouette", f"""WITH {EMB}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), s AS (SELECT a.vec_id, a.label, b.label AS other, sum({DIST.format('a', 'b')}) AS t FROM e a, e b GROUP BY a.vec_id, a.label, b.label),
x AS (SELECT vec_id, s.label, max(CASE WHEN s.label = other THEN t / (n - 1) END) AS a, min(CASE WHEN s.label <> other THEN t / n END) AS b FROM s JOIN n ON n.label = other GROUP BY vec_id, s.label)
SELECT CAST(label AS VARCHAR) AS label, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM x GROUP BY label""")
def _(spark, d):
    return rounded(C.silhouette(emb(spark, d)).groupBy("label").agg(F.avg("silhouette").alias("silhouette")))


@query("ag23b_squared_silhouette", f"""WITH {EMB}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), s AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow({DIST.format('a', 'b')}, 2)) AS t FROM e a, e b GROUP BY a.vec_id, a.label, b.label),
x AS (SELECT vec_id, s.label, max(CASE WHEN s.label = other THEN t / (n - 1) END) AS a, min(CASE WHEN s.label <> other THEN t / n END) AS b FROM s JOIN n ON n.label = other GROUP BY vec_id, s.label)
SELECT vec_id, CAST(label AS VARCHAR) AS label, round((b - a) / greatest(a, b), 6) AS silhouette FROM x""")
def _(spark, d):
    return rounded(C.silhouette_squared(emb(spark, d)))


@query("ag24_coherence", f"WITH {CENTROIDS}, x AS (SELECT label, 1.0 / (1.0 + avg(list_distance(v, cv))) AS x FROM e JOIN c USING (label) GROUP BY label) SELECT label, round(x, 6) AS coherence, round(0.6 + (x - 0.5) * 0.6, 6) AS rescaled FROM x")
def _(spark, d):
    return rounded(C.coherence(emb(spark, d), "label"))


@query("jn03_repel", f"WITH {CENTROIDS} SELECT vec_id, round(max(list_cosine_similarity(v, cv)), 6) AS other_sim, round(max(list_cosine_similarity(v, cv)), 9) < 0.20 AS passes FROM e JOIN c ON e.label <> c.label GROUP BY vec_id")
def _(spark, d):
    from curatrix.operators.cascades import nearest_other

    x = nearest_other(emb(spark, d), "label", V.mean_vector(emb(spark, d), ["label"], "embedding"))
    return x.select("vec_id", F.round("other_sim", 6).alias("other_sim"), (F.round("other_sim", 9) < 0.20).alias("passes"))


@query("jn04_contrastive", f"WITH {CENTROIDS}, x AS (SELECT vec_id, max(CASE WHEN e.label = c.label THEN list_cosine_similarity(v, cv) END) AS own, max(CASE WHEN c.label IN ((e.label + 1) % 10, (e.label + 2) % 10) THEN list_cosine_similarity(v, cv) END) AS conf FROM e, c GROUP BY vec_id) SELECT vec_id, round(conf, 6) AS confuser_sim, round(conf, 9) <= round(own, 9) AS passes FROM x")
def _(spark, d):
    from curatrix.operators.cascades import centroid_features, confusers_of, nearest_confuser

    e = emb(spark, d)
    edges = e.select("label").distinct().select("label", F.posexplode(F.array(*(F.pmod(c("label") + i, F.lit(10)) for i in (1, 2, 3)))).alias("place", "other")).withColumn("place", c("place") + 1)
    x = nearest_confuser(centroid_features(e), "label", V.mean_vector(e, ["label"], "embedding"), confusers_of(edges, 2))
    return x.select("vec_id", F.round("confuser_sim", 6).alias("confuser_sim"), (F.round("confuser_sim", 9) <= F.round("sim", 9)).alias("passes"))


@query("jn06_semantic_duplicates", f"WITH {EMB} SELECT b.vec_id, round(max({COS.format('a', 'b')}), 6) AS nearest_sim, round(max({COS.format('a', 'b')}), 9) >= 0.35 AS duplicate FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY b.vec_id")
def _(spark, d):
    e = emb(spark, d)
    near = N.nearest(e, e, 1)
    return near.select(c("q").alias("vec_id"), F.round("score", 6).alias("nearest_sim"), (F.round("score", 9) >= 0.35).alias("duplicate"))


@query("jn07_knn_join", f"WITH {NC} SELECT q, k AS c, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM nc WHERE r <= 5")
def _(spark, d):
    return rounded(N.nearest(emb(spark, d), emb(spark, d), 5))


def _every_50th(spark, d):
    return emb(spark, d).filter("vec_id % 50 = 0")


def _indexed(spark, d, k, value=None, same=None):
    """(index, found, exact) of every 50th row against all, with as many probes as the exact neighbours of a sample of queries ask for."""
    e = emb(spark, d)
    index = I.build(e, value=value)
    probes = I.tune(index, e, k)
    found = stored(I.search(index, _every_50th(spark, d), k, probes, value=value, same=same), "indexed")
    exact = N.nearest(_every_50th(spark, d), e, k, query_group=value if same is not None else None, corpus_group=value if same is not None else None, same=bool(same))
    return index, found, exact


@query("jn07b_indexed_knn")
def _(spark, d):
    """The 10 nearest rows of every 50th row by inverted lists, and the recall of the whole result against the exact one."""
    _, found, exact = _indexed(spark, d, 10)
    return rounded(found.join(F.broadcast(I.recall(found, exact).select("recall"))))


@query("ag08b_indexed_purity")
def _(spark, d):
    """Purity of the 10 nearest of every 50th row by inverted lists and exactly, by class."""
    _, found, _ = _indexed(spark, d, 10, "label")
    near = found.groupBy(c("q").alias("vec_id"), c("q_value").alias("label")).agg(F.avg((c("q_value") == c("c_value")).cast("double")).alias("purity"))
    exact = N.purity(_every_50th(spark, d), emb(spark, d), 10).select("vec_id", c("purity").alias("exact"))
    return rounded(near.join(exact, "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("purity").alias("purity"), F.avg("exact").alias("exact_purity")))


@query("an08b_indexed_hard_anchors")
def _(spark, d):
    """The nearest row of another class of every 50th row by inverted lists, and the recall of the whole result."""
    _, found, exact = _indexed(spark, d, 1, "label", same=False)
    return rounded(found.join(F.broadcast(I.recall(found, exact).select("recall"))).select("q", "c", "q_value", "c_value", (1 - c("score")).alias("distance"), "recall"))


@query("jn06b_pairs_by_reach", f"WITH {EMB} SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format('a', 'b')}, 6) AS score FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE round({COS.format('a', 'b')}, 12) > 0.35")
def _(spark, d):
    return rounded(I.similar_pairs(emb(spark, d), 0.35, dense=1.0))


@query("jn06c_cells_visited")
def _(spark, d):
    """How many cells rows are sent to by threshold, of all vectors and of them with a copy of every 10th row moved a little."""
    e = emb(spark, d).select("vec_id", c("embedding").cast("array<double>").alias("embedding"))
    copies = e.filter("vec_id % 10 = 0").select((c("vec_id") + 10_000_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: x + F.when(i == 0, 0.02).otherwise(0.0)).alias("embedding"))
    rows = [(t, p.rows, p.cells, p.visits, p.share) for t in (0.35, 0.9, 0.99) for p in [I.visits(e.unionByName(copies), t)]]
    return rounded(spark.createDataFrame(rows, "threshold double, rows long, cells int, visits long, share double"))


@query("wn01_nearest_to_centroid", f"WITH {SIMS} SELECT label, vec_id, CAST(r AS INTEGER) AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS r FROM s) WHERE r <= 3")
def _(spark, d):
    x = A.to_centroid(emb(spark, d), "label")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.round("sim", 9).desc(), "vec_id"))).filter("rank <= 3").select("label", "vec_id", "rank")


MD = "SELECT a.vec_id, a.label, avg(list_distance(a.v, b.v)) AS m FROM (SELECT a.*, b.vec_id AS k, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 12), b.vec_id) AS r FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) a JOIN e b ON b.vec_id = a.k WHERE r <= 5 GROUP BY a.vec_id, a.label"


@query("cl01_outliers_knn", f"WITH {EMB}, m AS ({MD}), q AS (SELECT label, quantile_cont(m, 0.85) AS q FROM m GROUP BY label) SELECT vec_id, round(m, 6) AS mean_distance FROM m JOIN q USING (label) WHERE round(m, 9) <= round(q, 9)")
def _(spark, d):
    return rounded(K.by_density(emb(spark, d), group="label").select("vec_id", "mean_distance"))


@query("cl02_low_density", f"WITH {EMB}, m AS ({MD}), q AS (SELECT label, quantile_cont(m, 0.7) AS q FROM m GROUP BY label) SELECT vec_id, round(m, 6) AS mean_distance FROM m JOIN q USING (label) WHERE round(m, 9) >= round(q, 9)")
def _(spark, d):
    return rounded(K.by_density(emb(spark, d), quantile=0.7, keep="sparse", group="label").select("vec_id", "mean_distance"))


@query("cl03_assign", f"WITH {CENTROIDS} SELECT vec_id, k AS cluster, round(d, 6) AS distance FROM (SELECT vec_id, c.label AS k, list_distance(v, cv) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, cv), 9), c.label) AS r FROM e, c) WHERE r = 1")
def _(spark, d):
    x = K.assign(emb(spark, d), V.mean_vector(emb(spark, d), ["label"], "embedding"), centroid_id="label")
    return rounded(x.select("vec_id", "cluster", "distance"))


@query("cl03_kmeans")
def _(spark, d):
    return K.kmeans(emb(spark, d), 6)[0].select("vec_id", "cluster")


@query("cl04_elbow_k")
def _(spark, d):
    return spark.createDataFrame([(K.choose_k(emb(spark, d)),)], "k int")


@query("cl08_interpolated_pairs", f"""WITH {SIMS}, a AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS a, count(*) OVER () AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS r FROM s) WHERE r = 1),
n AS (SELECT a.vec_id AS anchor, a.v AS p, e.vec_id AS neighbour, e.v AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, e.v), 12), e.vec_id) - 1 AS r FROM a JOIN e ON e.vec_id <> a.vec_id),
t AS (SELECT i, vec_id AS anchor, ('0x' || substr(md5('neighbour/42/' || i), 1, 8))::BIGINT % 5 AS r, ('0x' || substr(md5('share/42/' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS w FROM range(50) x(i) JOIN a ON a.a = i % a.m)
SELECT i, anchor, neighbour, round(w, 6) AS "by", round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] + w * (z[2] - z[1]))), 5) AS total, round(p[1] + w * (q[1] - p[1]), 6) AS first FROM t JOIN n USING (anchor, r)""")
def _(spark, d):
    e = emb(spark, d)
    x = K.smote_pairs(e, A.centroid_nearest(e, "label"), 50)
    return x.select("i", "anchor", "neighbour", F.round("by", 6).alias("by"), F.round(F.aggregate("synthetic", F.lit(0.0), lambda s, y: s + y), 5).alias("total"), F.round(F.get("synthetic", F.lit(0)), 6).alias("first"))


@query("cl09_weighted_support", f"""WITH {NC}, w AS (SELECT q, k, r, 1 / (1 - s + 0.01) AS w FROM nc WHERE r <= 8), x AS (SELECT q, k, r, greatest(1, least(3, CAST(floor(round(w / sum(w) OVER (PARTITION BY q) * 8 * 2, 9)) AS INTEGER))) AS n FROM w),
y AS (SELECT q, k, r, n, unnest(range(0, n)) AS i FROM x) SELECT q, k AS c, CAST(r AS INTEGER) AS rank, n AS repeats, CAST(p AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, i) AS p FROM y) WHERE p <= 12""")
def _(spark, d):
    e = emb(spark, d)
    return K.weighted_support(e, e)


@query("cl10_mixup")
def _(spark, d):
    return rounded(K.mixup(emb(spark, d), 5).select("label", "a", "b", "by", F.posexplode("synthetic").alias("i", "x")))


@query("cl11_contrastive_refinement")
def _(spark, d):
    return rounded(K.contrastive(emb(spark, d)).select("vec_id", F.posexplode("refined").alias("i", "x")))


@query("an01_centroid_anchor", f"WITH {SIMS} SELECT label, vec_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS r FROM s) WHERE r = 1")
def _(spark, d):
    return rounded(A.centroid_nearest(emb(spark, d), "label"))


TOTAL = "t AS (SELECT a.label, a.vec_id, sum(1 - list_cosine_similarity(a.v, b.v)) AS t, count(*) AS n FROM e a JOIN e b ON a.label = b.label GROUP BY a.label, a.vec_id)"


@query("an03_medoid", f"WITH {EMB}, {TOTAL} SELECT label, vec_id, round(t, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(t, 9), vec_id) AS r FROM t) WHERE r = 1")
def _(spark, d):
    return rounded(A.medoid(emb(spark, d), "label"))


@query("an04_quality_gated", f"WITH {SIMS} SELECT label, vec_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN m < 0.5 THEN CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END ELSE 1 END DESC, round(sim, 9) DESC, vec_id) AS r FROM (SELECT *, avg(sim) OVER (PARTITION BY label) AS m FROM s)) WHERE r = 1")
def _(spark, d):
    e = emb(spark, d).withColumn("text", F.when(c("vec_id") % 3 == 0, "a readable text of some words").otherwise("#short"))
    return rounded(A.quality_gated(e, "label", "text"))


@query("an05_purity_gated", f"""WITH {SIMS}, x AS (SELECT c.label, e.label AS el, row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(e.v, c.cv), 12) DESC, e.vec_id) AS r FROM e, c), p AS (SELECT label, avg(CASE WHEN label = el THEN 1.0 ELSE 0.0 END) AS purity FROM x WHERE r <= 15 GROUP BY label)
SELECT label, vec_id, round(purity, 6) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS r FROM s) JOIN p USING (label) WHERE r = 1 AND purity >= 0.2""")
def _(spark, d):
    e = emb(spark, d).withColumn("cluster", c("label"))
    return rounded(A.purity_gated(e, "cluster", "label", least=0.2).select(c("cluster").alias("label"), "vec_id", "purity"))


@query("an06_diverse_midband", f"""WITH {SIMS}, {TOTAL}, q AS (SELECT label, quantile_cont(1 - sim, 0.25) AS l, quantile_cont(1 - sim, 0.75) AS h FROM s GROUP BY label), m AS (SELECT s.label, s.vec_id, t / n AS d FROM s JOIN q USING (label) JOIN t ON t.vec_id = s.vec_id WHERE 1 - sim >= l - 1e-12 AND 1 - sim <= h + 1e-12)
SELECT label, vec_id, round(d, 6) AS diversity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9) DESC, vec_id) AS r FROM m) WHERE r = 1""")
def _(spark, d):
    return rounded(A.diverse_midband(emb(spark, d), "label"))


_FAR = "d{k} AS (SELECT s.vec_id, s.label, s.v, least(s.d, round(1 - list_cosine_similarity(s.v, c.v), 12)) AS d FROM d{j} s JOIN x{j} ON x{j}.label = s.label JOIN e c ON c.vec_id = x{j}.vec_id WHERE s.vec_id <> c.vec_id), x{k} AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS r FROM d{k}) WHERE r = 1)"


@query("an07_farthest_first", f"WITH {EMB}, d0 AS (SELECT vec_id, label, v, 4.0::DOUBLE AS d FROM e), x0 AS (SELECT label, min(vec_id) AS vec_id FROM e GROUP BY label), {', '.join(_FAR.format(k=k, j=k - 1) for k in (1, 2, 3))} SELECT label, vec_id, CAST(step AS INTEGER) AS step FROM ({' UNION ALL '.join(f'SELECT *, {k} AS step FROM x{k}' for k in range(4))})")
def _(spark, d):
    return A.farthest_first(emb(spark, d), "label", 4)


@query("an08_hard_anchors", f"WITH {EMB}, x AS (SELECT a.label, a.vec_id, min(1 - {COS.format('a', 'b')}) AS d FROM e a JOIN e b ON a.label <> b.label GROUP BY a.label, a.vec_id) SELECT label, vec_id, round(d, 6) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS r FROM x) WHERE r <= 3")
def _(spark, d):
    return rounded(A.hard(emb(spark, d), "label", 3))


@query("an09_random_anchors", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42/' || vec_id), 1, 8))::BIGINT, vec_id) AS r FROM embeddings) WHERE r <= 3")
def _(spark, d):
    return A.random_anchors(emb(spark, d), "label", 3)


ENSEMBLE = f"""WITH {EMB}, an AS (SELECT * FROM e),
dv AS (SELECT a.vec_id, coalesce(avg(1 - {COS.format('a', 'b')}), 1.0) AS diversity FROM an a LEFT JOIN an b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
pu AS (SELECT vec_id, avg(CASE WHEN al = bl THEN 1.0 ELSE 0.0 END) AS purity FROM (SELECT a.vec_id, a.label AS al, b.label AS bl, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS.format('a', 'b')}, 12) DESC, b.vec_id) AS r FROM an a, e b) WHERE r <= 15 GROUP BY vec_id),
hd AS (SELECT a.vec_id, exp(-2.0 * min(1 - {COS.format('a', 'b')})) AS hardness FROM an a JOIN e b ON a.label <> b.label GROUP BY a.vec_id),
st AS (SELECT a.vec_id, 1 / (1 + stddev_pop(1 - {COS.format('a', 'b')})) AS stability FROM an a JOIN e b ON a.label = b.label GROUP BY a.vec_id),
y AS (SELECT an.label, vec_id, diversity, purity, hardness, stability FROM an JOIN dv USING (vec_id) JOIN pu USING (vec_id) JOIN hd USING (vec_id) JOIN st USING (vec_id))"""
RANKED = """, x AS (SELECT *, {} * diversity + {} * purity + {} * hardness + {} * stability AS score FROM y)
SELECT label, vec_id, round(diversity, 6) AS diversity, round(purity, 6) AS purity, round(hardness, 6) AS hardness, round(stability, 6) AS stability, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM x"""


@query("an11_ensemble_rank", ENSEMBLE + RANKED.format(0.3, 0.3, 0.2, 0.2))
def _(spark, d):
    return rounded(A.ensemble_scores(emb(spark, d), emb(spark, d)).select("label", "vec_id", "diversity", "purity", "hardness", "stability", "score", "rank"))


@query("an11b_ensemble_rank_old", ENSEMBLE + RANKED.format(0.3, 0.4, 0.0, 0.3))
def _(spark, d):
    return rounded(A.ensemble_scores(emb(spark, d), emb(spark, d), weights=(0.3, 0.4, 0.0, 0.3)))


@query("an12_central_anchors", f"""WITH {SIMS}, q AS (SELECT label, quantile_cont(sim, 0.25) AS l, quantile_cont(sim, 0.75) AS h FROM s GROUP BY label), i AS (SELECT s.*, sim >= l - 1.5 * (h - l) AS ok FROM s JOIN q USING (label)), k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY label) AS k, row_number() OVER (PARTITION BY label ORDER BY ok DESC, round(sim, 9) DESC, vec_id) AS r FROM i)
SELECT label, vec_id, round(sim, 6) AS sim, CAST(r AS INTEGER) AS rank FROM k WHERE r <= greatest(3, floor(k * 0.7::DOUBLE))""")
def _(spark, d):
    return rounded(A.central(emb(spark, d), "label"))


@query("an13_recommended_anchor", """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), t AS (SELECT * FROM r WHERE r <= 10),
n AS (SELECT label, count(*) AS n, sum(vec_id % 97) % 12 AS said FROM t GROUP BY label) SELECT label, vec_id FROM t JOIN n USING (label) WHERE r = CASE WHEN said BETWEEN 1 AND n THEN said ELSE 1 END""")
def _(spark, d):
    """A reply names the number of a text by the sum of all texts' remainders, which differs by class; out of range (and 0) it is no answer."""

    def ask(prompt):
        return f"Number {sum(int(line.split('. ')[1]) for line in prompt.splitlines()[1:]) % 12}, I think"

    return A.recommended(emb(spark, d).withColumn("text", (c("vec_id") % 97).cast("string")), "label", "vec_id", "text", ask=ask)


@query("an14_ensemble_metrics", ENSEMBLE + "SELECT count(*) AS anchors, count(DISTINCT vec_id % 3) AS strategies, round(avg(purity), 6) AS mean_purity, round(min(purity), 6) AS least_purity, round(max(purity), 6) AS most_purity, round(avg(diversity), 6) AS diversity FROM y")
def _(spark, d):
    ranked = A.ensemble_scores(emb(spark, d), emb(spark, d)).withColumn("strategy", c("vec_id") % 3)
    return rounded(A.ensemble_metrics(ranked, "strategy"))
