"""Profiles, experiment analytics, splits, models, sources."""

from pyspark.sql import functions as F

from curatrix.operators import classes as C
from curatrix.operators import dedup as D
from curatrix.operators import evaluation as E
from curatrix.operators import models as M
from curatrix.operators import weights as W
from curatrix.plans.registry import EMB, query, rounded, table

c = F.col


def emb(spark, d):
    return table(spark, d, "embeddings")


@query("ag01_dataset_profile", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS classes, min(n) AS smallest, max(n) AS largest, round(quantile_cont(n, 0.5), 6) AS median, round(max(n) / min(n)::DOUBLE, 6) AS imbalance FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def _(spark, d):
    return rounded(C.dataset_profile(table(spark, d, "documents"), "lang"))


@query("ag02_minority_classes", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n FROM n WHERE n <= (SELECT quantile_cont(n, 0.5) FROM n)")
def _(spark, d):
    return C.minority(table(spark, d, "documents"), "lang")


#: A deterministic prediction: most rows right, the rest one class off.
PRED = "SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS predicted FROM embeddings"
PRF = f"""x AS ({PRED}), l AS (SELECT label FROM x UNION SELECT predicted FROM x), r AS (SELECT l.label, (SELECT count(*) FROM x WHERE x.label = l.label) AS support, (SELECT count(*) FROM x WHERE x.label = l.label AND predicted = l.label) AS tp, (SELECT count(*) FROM x WHERE x.label <> l.label AND predicted = l.label) AS fp, (SELECT count(*) FROM x WHERE x.label = l.label AND predicted <> l.label) AS fn FROM l),
rr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM r)"""


def predictions(spark, d):
    return emb(spark, d).withColumn("predicted", F.when(c("vec_id") % 3 == 0, F.pmod(c("label") + 1, F.lit(10))).otherwise(c("label")))


@query("ag15_class_report", f'WITH {PRF} SELECT label, support, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rr')
def _(spark, d):
    return rounded(C.prf(predictions(spark, d), "label", "predicted"))


@query("ag15_averages", f"WITH {PRF} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(support), 6) AS accuracy FROM rr")
def _(spark, d):
    return rounded(C.averages(C.prf(predictions(spark, d), "label", "predicted")))


#: An experiment table: customers' balances by segment and nation stand for results by configuration and seed.
X = "x AS (SELECT c_mktsegment AS config, c_nationkey AS seed, avg(c_acctbal) / 1000 - 4.4 AS delta, count(*) AS n, avg(c_custkey % 100) AS similarity FROM customer GROUP BY ALL)"


def experiments(spark, d):
    return table(spark, d, "customer").groupBy(c("c_mktsegment").alias("config"), c("c_nationkey").alias("seed")).agg((F.avg("c_acctbal") / 1000 - 4.4).alias("delta"), F.count(F.lit(1)).alias("n"), F.avg(c("c_custkey") % 100).alias("similarity"))


@query("ag17_seed_stats", f"WITH {X} SELECT config, count(delta) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, round(min(delta), 6) AS least, round(max(delta), 6) AS most, round(quantile_cont(delta, 0.5), 6) AS median, count(*) FILTER (delta > 0) AS wins FROM x GROUP BY config")
def _(spark, d):
    return rounded(E.seed_stats(experiments(spark, d), ["config"], "delta"))


@query("ag18_grouped_metrics", f"WITH {X} SELECT config, round(avg(delta), 6) AS delta_mean, round(stddev_samp(delta), 6) AS delta_std, round(min(similarity), 6) AS similarity_min, round(max(similarity), 6) AS similarity_max, count(*) AS runs FROM x GROUP BY config")
def _(spark, d):
    return rounded(experiments(spark, d).groupBy("config").agg(F.avg("delta").alias("delta_mean"), F.stddev_samp("delta").alias("delta_std"), F.min("similarity").alias("similarity_min"), F.max("similarity").alias("similarity_max"), F.count(F.lit(1)).alias("runs")))


@query("ag19_pivot", f"WITH {X} SELECT config, " + ", ".join(f'round(avg(delta) FILTER (seed = {i}), 6) AS "{i}"' for i in range(5)) + " FROM x GROUP BY config")
def _(spark, d):
    return rounded(E.pivot(experiments(spark, d), "config", "seed", "delta", list(range(5))))


@query("ag20_correlations", f"WITH {X} SELECT 'n' AS metric, round(corr(n, delta), 6) AS r FROM x UNION ALL SELECT 'similarity', round(corr(similarity, delta), 6) FROM x")
def _(spark, d):
    return rounded(E.correlations(experiments(spark, d), "delta", ["n", "similarity"]))


@query("ag20_rank_correlations", f"WITH {X}, k AS (SELECT rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS b, rank() OVER (ORDER BY similarity) + (count(*) OVER (PARTITION BY similarity) - 1) / 2.0::DOUBLE AS s FROM x) SELECT 'n' AS metric, round(corr(b, a), 6) AS r FROM k UNION ALL SELECT 'similarity', round(corr(s, a), 6) FROM k")
def _(spark, d):
    return rounded(E.correlations(experiments(spark, d), "delta", ["n", "similarity"], ranks=True))


@query("ag25_generation_log", "SELECT role, count(*) AS calls, 0::BIGINT AS failed, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS prompt_tokens FROM conversations GROUP BY role")
def _(spark, d):
    from curatrix.sources.generators import EchoGenerator, generate, generation_log

    r = generate(table(spark, d, "conversations").select("role", "text"), "text", EchoGenerator)
    return generation_log(r, ["role"]).drop("completion_tokens")


@query("ag26_class_coverage", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, CASE WHEN count(*) < 20 THEN 'low' WHEN count(*) >= 50 THEN 'high' ELSE 'medium' END AS level, count(DISTINCT source) = 1 AS single_source FROM documents GROUP BY lang")
def _(spark, d):
    return E.coverage(table(spark, d, "documents"), "lang", "source")


@query("wn05_best_and_worst", f"WITH {X} SELECT config, seed, round(delta, 6) AS delta, side, CAST(rank AS INTEGER) AS rank FROM (SELECT *, 'best' AS side, row_number() OVER (PARTITION BY config ORDER BY delta DESC, seed) AS rank FROM x UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY config ORDER BY delta, seed) FROM x) WHERE rank <= 3")
def _(spark, d):
    return rounded(E.best_and_worst(experiments(spark, d), "config", "delta", "seed").select("config", "seed", "delta", "side", "rank"))


@query("wn06_marginal_returns", f"WITH {X} SELECT config, seed, round((delta - lag(delta) OVER w) / nullif(seed - lag(seed) OVER w, 0), 6) AS marginal FROM x WINDOW w AS (PARTITION BY config ORDER BY seed, delta)")
def _(spark, d):
    return rounded(E.marginal_returns(experiments(spark, d), "config", "seed", "delta").select("config", "seed", "marginal"))


@query("wn07_elbow", f"""WITH {X}, i AS (SELECT config, seed + 2 AS k, 100 / (seed + 2) + delta AS inertia FROM x), s AS (SELECT *, lead(inertia) OVER w - 2 * inertia + lag(inertia) OVER w AS dd, max(k) OVER (PARTITION BY config) AS top, min(k) OVER (PARTITION BY config) AS low FROM i WINDOW w AS (PARTITION BY config ORDER BY k)),
b AS (SELECT config, any_value(top) AS top, any_value(low) AS low, count(dd) AS n, (SELECT k FROM s t WHERE t.config = s.config AND dd IS NOT NULL ORDER BY dd DESC, k LIMIT 1) AS k FROM s GROUP BY config) SELECT config, CAST(CASE WHEN n = 0 THEN low WHEN k < 3 THEN least(3, top) WHEN k > top - 2 THEN top ELSE k END AS INTEGER) AS k FROM b""")
def _(spark, d):
    x = experiments(spark, d).select("config", (c("seed") + 2).alias("k"), (100 / (c("seed") + 2) + c("delta")).alias("inertia"))
    return E.elbow(x, "config", "k", "inertia")


@query("wn10_top_configs", f"WITH {X} SELECT config, seed, round(delta, 6) AS delta FROM x ORDER BY x.delta DESC, config, seed LIMIT 10")
def _(spark, d):
    return rounded(experiments(spark, d).orderBy(c("delta").desc(), "config", "seed").limit(10).select("config", "seed", "delta"))


@query("dv01_delta_distances", f"WITH {X} SELECT a.config AS a, b.config AS b, round(sqrt(sum(pow(coalesce(x1.delta, 0) - coalesce(x2.delta, 0), 2))), 6) AS distance FROM (SELECT DISTINCT config FROM x) a JOIN (SELECT DISTINCT config FROM x) b ON a.config < b.config CROSS JOIN (SELECT DISTINCT seed FROM x) s LEFT JOIN x x1 ON x1.config = a.config AND x1.seed = s.seed LEFT JOIN x x2 ON x2.config = b.config AND x2.seed = s.seed GROUP BY a.config, b.config")
def _(spark, d):
    return rounded(D.delta_distances(experiments(spark, d), "config", "seed", "delta"))


@query("dv02_max_min_selection", f"""WITH {X}, v AS (SELECT config, seed, sum(delta) AS delta FROM x GROUP BY config, seed), s AS (SELECT config, avg(delta) AS m FROM x GROUP BY config),
t AS (SELECT a.config AS a, b.config AS b, sqrt(greatest(0, any_value(a.q) + any_value(b.q) - 2 * coalesce(sum(va.delta * vb.delta), 0))) AS d FROM (SELECT config, sum(delta * delta) AS q FROM v GROUP BY config) a JOIN (SELECT config, sum(delta * delta) AS q FROM v GROUP BY config) b ON a.config <> b.config LEFT JOIN v va ON va.config = a.config LEFT JOIN v vb ON vb.config = b.config AND vb.seed = va.seed GROUP BY a.config, b.config),
p0 AS (SELECT config FROM s ORDER BY m DESC, config LIMIT 1), p1 AS (SELECT t.a AS config FROM t JOIN p0 ON t.b = p0.config ORDER BY round(d, 9) DESC, t.a LIMIT 1),
p2 AS (SELECT t.a AS config FROM t WHERE t.b IN (SELECT config FROM p0 UNION SELECT config FROM p1) AND t.a NOT IN (SELECT config FROM p0 UNION SELECT config FROM p1) GROUP BY t.a ORDER BY round(min(d), 9) DESC, t.a LIMIT 1)
SELECT 0::INTEGER AS place, config FROM p0 UNION ALL SELECT 1::INTEGER, config FROM p1 UNION ALL SELECT 2::INTEGER, config FROM p2""")
def _(spark, d):
    x = experiments(spark, d)
    scores = {r.config: r.m for r in x.groupBy("config").agg(F.avg("delta").alias("m")).collect()}
    return spark.createDataFrame(list(enumerate(D.max_min_selection(D.delta_distances(x, "config", "seed", "delta"), scores, 3))), "place int, config string")


@query("dv03_best_per_strategy", f"WITH {X} SELECT config, seed FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY delta DESC, seed) AS r FROM x) WHERE r = 1")
def _(spark, d):
    return D.best_per(experiments(spark, d), "config", "delta", "seed").select("config", "seed")


@query("dv03_class_balanced", f"WITH {X} SELECT config, seed FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY delta DESC, config) AS r FROM x) WHERE r <= 2")
def _(spark, d):
    return D.class_balanced(experiments(spark, d), "seed", "delta", "config", 2).select("config", "seed")


H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("ev01_stratified_split", f"SELECT vec_id, CASE WHEN n > 1 THEN r <= greatest(1, floor(n * 0.2::DOUBLE)) ELSE false END AS test FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {H.format('CAST(vec_id AS VARCHAR)')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def _(spark, d):
    return E.stratified_split(emb(spark, d), "label", "vec_id").select("vec_id", "test")


SAFE = "s AS (SELECT n, CASE WHEN n > 1 THEN r <= greatest(1, floor(n * 0.2::DOUBLE)) ELSE false END AS t FROM (SELECT row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM documents))"


@query("ev01_safe_split", f"WITH {SAFE} SELECT 'train' AS part, count(*) FILTER (n < 2 OR NOT t) AS n FROM s UNION ALL SELECT 'test', count(*) FILTER (n < 2 OR t) FROM s")
def _(spark, d):
    t = table(spark, d, "documents").withColumn("class", F.concat_ws("/", "source", "lang"))
    return E.safe_split(t, "class", "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("ev02_stratified_folds", f"SELECT CAST(rep AS INTEGER) AS repeat, vec_id, CAST((row_number() OVER (PARTITION BY rep, label ORDER BY {H.format('''rep || '/' || vec_id''')}, vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings, unnest([0, 1, 2]) AS t(rep)")
def _(spark, d):
    return E.folds(emb(spark, d), "label", "vec_id", 5, 3).select("repeat", "vec_id", "fold")


@query("ev04_leave_one_out", f"WITH {X}, y AS (SELECT config, avg(delta) AS v FROM x GROUP BY config) SELECT config, round((SELECT v FROM y WHERE config = 'BUILDING') - v, 6) AS contribution FROM y WHERE config <> 'BUILDING'")
def _(spark, d):
    y = experiments(spark, d).groupBy("config").agg(F.avg("delta").alias("v"))
    return rounded(E.leave_one_out(y, "config", "v", "BUILDING"))


@query("jn09_leave_component_out", "SELECT k AS left_out, count(*) AS n FROM embeddings, unnest([0, 1, 2]) AS t(k) WHERE vec_id % 3 <> k GROUP BY k")
def _(spark, d):
    return emb(spark, d).join(F.broadcast(spark.range(3).select(c("id").cast("int").alias("left_out"))), c("vec_id") % 3 != c("left_out")).groupBy("left_out").agg(F.count(F.lit(1)).alias("n"))


@query("jn10_nearest_anchor", f"WITH {EMB} SELECT b.vec_id, round(min(list_distance(a.v, b.v)), 6) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY b.vec_id")
def _(spark, d):
    from curatrix.operators.neighbors import nearest

    e = emb(spark, d)
    return rounded(nearest(e, e, 1, "euclidean").select(c("q").alias("vec_id"), c("score").alias("distance")))


@query("st01_paired_t", f"WITH {X} SELECT config, count(delta) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, count(*) FILTER (delta > 0) AS wins, round(avg(delta) / stddev_samp(delta) * sqrt(count(delta)), 6) AS t, round(count(*) FILTER (delta > 0) / count(*)::DOUBLE, 6) AS win_rate FROM x GROUP BY config")
def _(spark, d):
    return rounded(E.paired(experiments(spark, d), ["config"], "delta"))


@query("st02_significance")
def _(spark, d):
    return rounded(E.significance(E.paired(experiments(spark, d), ["config"], "delta")))


@query("st03_replication", f"WITH {X}, g AS (SELECT config, count(delta) AS n, avg(delta) AS mean, stddev_pop(delta) AS std, min(delta) AS least, max(delta) AS most FROM x GROUP BY config) SELECT config, n, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, round(std / abs(mean) * 100, 4) AS cv, round(1.96 * std / sqrt(n), 6) AS half_width, CASE WHEN std < 1 THEN 'robust' WHEN std < 2 THEN 'acceptable' ELSE 'high variance' END AS label FROM g")
def _(spark, d):
    return rounded(E.replication(experiments(spark, d), "config", "delta")).withColumn("cv", F.round("cv", 4))


@query("st04_recommendations", "SELECT lang, list_filter([CASE WHEN r < 0.05 THEN 'relax the thresholds' END, CASE WHEN r > 0.50 THEN 'tighten the filters' END, CASE WHEN r < 0.4 THEN 'change the token bounds' END], lambda x: x IS NOT NULL) AS advice FROM (SELECT lang, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) AS r FROM documents GROUP BY lang)")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.avg((c("n_chars") > 1000).cast("double")).alias("r"))
    return g.select("lang", E.recommendations(c("r"), F.create_map(F.lit("length"), F.when(c("r") < 0.4, 1.0).otherwise(0.0))).alias("advice"))


@query("st05_categories", "SELECT p_name, CASE WHEN starts_with(p_type, 'S') THEN 'small' WHEN starts_with(p_type, 'P') THEN 'promoted' ELSE 'other' END AS category FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_name", E.categorize(c("p_type"), [("S", "small"), ("P", "promoted")]).alias("category"))


@query("st06_confusers", "SELECT 'INFP' AS label, CAST(i AS INTEGER) AS place, o AS other FROM (VALUES (1, 'ENFP'), (2, 'INTP'), (3, 'INFJ')) t(i, o)")
def _(spark, d):
    from curatrix.operators.cascades import confusers_of
    from curatrix.operators.confusers import edges

    return edges(spark).join(confusers_of(edges(spark), 3), ["label", "other"]).filter("label = 'INFP'").select("label", "place", "other")


LETTERS = "l AS (SELECT a || b || c || d AS label FROM (VALUES ('I'), ('E')) w(a), (VALUES ('N'), ('S')) x(b), (VALUES ('F'), ('T')) y(c), (VALUES ('P'), ('J')) z(d))"


@query("st06_primary", f"WITH {LETTERS} SELECT label, CASE WHEN label[1] = 'I' THEN 'E' ELSE 'I' END || label[2:] AS other FROM l")
def _(spark, d):
    from curatrix.operators.cascades import confusers_of
    from curatrix.operators.confusers import edges

    return confusers_of(edges(spark), 1)


@query("st06_descriptions", f"WITH {LETTERS} SELECT label, 'How ' || label || ' differs from the classes near it:' || chr(10) || '  - Not like ' || CASE WHEN label[1] = 'I' THEN 'E' ELSE 'I' END || label[2:] || ': first letter' || chr(10) || '  - At its core: ' || lower(label) AS description FROM l")
def _(spark, d):
    from curatrix.operators.cascades import confusers_of
    from curatrix.operators.confusers import descriptions, edges

    one = confusers_of(edges(spark), 1)
    return descriptions(one.withColumn("trait", F.lit("first letter")).unionByName(one.select("label", F.lit(None).cast("string").alias("other"), F.lower("label").alias("trait"))))


@query("ml06_soft_vote", "WITH p AS (SELECT vec_id, m, ('0x' || substr(md5(m || '/' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS p FROM embeddings, unnest([1, 2, 3]) AS t(m)), w AS (SELECT m, exp(5 * (m / 10.0::DOUBLE - 0.3)) AS e FROM unnest([1, 2, 3]) AS t(m)) SELECT vec_id, round(sum(p * e) / (SELECT sum(e) FROM w), 6) AS p0, CAST(CASE WHEN sum(p * e) / (SELECT sum(e) FROM w) >= 0.5 THEN 0 ELSE 1 END AS INTEGER) AS predicted FROM p JOIN w USING (m) GROUP BY vec_id")
def _(spark, d):
    m = emb(spark, d).select("vec_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("m"))
    p = F.conv(F.substring(F.md5(F.concat(c("m").cast("string"), F.lit("/"), c("vec_id").cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0
    f1 = spark.createDataFrame([(i, i / 10.0) for i in (1, 2, 3)], "m int, f1 double")
    v = W.vote(m.withColumn("p", F.array(p, 1 - p)), "vec_id", "m", "p", f1)
    return v.select("vec_id", F.round(F.get("proba", F.lit(0)), 6).alias("p0"), c("predicted").cast("int").alias("predicted"))


@query("ml06_majority_vote", "SELECT vec_id, predicted FROM (SELECT vec_id, predicted, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, predicted) AS r FROM (SELECT vec_id, (vec_id * m) % 3 AS predicted FROM embeddings, unnest([1, 2, 3]) AS t(m)) GROUP BY vec_id, predicted) WHERE r = 1")
def _(spark, d):
    m = emb(spark, d).select("vec_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("m"))
    return W.majority(m.select("vec_id", (c("vec_id") * c("m") % 3).alias("predicted")), "vec_id", "predicted")


def labelled(spark, d):
    """Vectors moved apart by class, so that a model has something to learn."""
    shift = F.transform("embedding", lambda x, i: x + F.when(i == c("label"), 0.4).otherwise(0.0))
    return M.encode(emb(spark, d).withColumn("embedding", shift))


def parted(spark, d):
    """labelled() with test, stored as fits read it many times."""
    from curatrix.sources.storage import stored

    return stored(E.stratified_split(labelled(spark, d), "label", "vec_id"), "parted")


@query("ml01_weighted_regression")
def _(spark, d):
    x = parted(spark, d)
    return rounded(M.evaluate(M.fit(x.filter("not test")), x.filter("test")))


@query("ml02_focal_training")
def _(spark, d):
    x = parted(spark, d)
    return rounded(M.evaluate(M.focal_training(x.filter("not test")), x.filter("test")))


@query("ml03_two_stage")
def _(spark, d):
    x = parted(spark, d)
    train = x.filter("not test")
    model, stage = M.two_stage(train.filter("vec_id % 5 <> 0"), train.filter("vec_id % 5 = 0").withColumn("confidence", F.lit(0.9)), x.filter("test"))
    return rounded(M.evaluate(model, x.filter("test")).withColumn("stage", F.lit(stage)))


@query("ml04_classifier_zoo")
def _(spark, d):
    x = parted(spark, d)
    return rounded(M.zoo(x.filter("not test"), x.filter("test"), ("lr", "rf", "svc", "gbt", "mlp")))


@query("ml05_early_stopped_network")
def _(spark, d):
    x = parted(spark, d)
    model, losses = M.early_stopped(x.filter("not test"))
    return rounded(M.evaluate(model, x.filter("test")).withColumn("steps", F.lit(len(losses))))


@query("ml04b_kernel_and_boosting")
def _(spark, d):
    """A kernel machine by random features and 100 rounds of softmax boosting."""
    x = parted(spark, d)
    return rounded(M.zoo(x.filter("not test"), x.filter("test"), ("rbf", "boosted")))


@query("ml05b_rectified_network")
def _(spark, d):
    """A network of rectified units with dropout; early stop on a tenth of the training rows."""
    from curatrix.operators.learners import network, networked

    x = parted(spark, d).select(c("embedding").cast("array<double>").alias("x"), c("y").cast("int").alias("y"), F.lit(1.0).alias("w"), "test", "vec_id", "label", "embedding")
    train, held = x.filter("not test and vec_id % 10 <> 0"), x.filter("not test and vec_id % 10 = 0")
    ws, losses = network(train, held)
    scored = networked(ws, "__raw").transform(M.features(x.filter("test"))).withColumn("predicted", c("prediction"))
    return rounded(C.prf(scored, "y", "predicted").withColumn("epochs", F.lit(len(losses))))


@query("ml06_seed_ensemble")
def _(spark, d):
    from curatrix.operators.clusters import mixup

    x = parted(spark, d)
    train, test = x.filter("not test"), x.filter("test")
    more = lambda t, s: mixup(t, 4, label="y", seed=s).select("y", c("synthetic").alias("embedding"))
    return M.seed_ensemble(train, test, test, more).select("vec_id", "predicted")


@query("fl13_discriminator")
def _(spark, d):
    e = emb(spark, d)
    return rounded(M.discriminator(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0")).select("vec_id", "p_synthetic"))


@query("gb20_validation_gate")
def _(spark, d):
    x = parted(spark, d)
    train = x.filter("not test")
    taken, change = M.gate_by_validation(train.filter("vec_id % 5 <> 0"), train.filter("vec_id % 5 = 0"), x.filter("test"))
    return spark.createDataFrame([(taken, change)], "taken boolean, change double")


@query("ev02_cross_validation")
def _(spark, d):
    x = labelled(spark, d)
    return rounded(M.cross_validate(x.filter("vec_id % 5 <> 0"), x.filter("vec_id % 5 = 0")))


@query("ev03_hold_out")
def _(spark, d):
    x = parted(spark, d)
    train = x.filter("not test")
    return rounded(M.hold_out(train.filter("vec_id % 5 <> 0"), x.filter("test"), train.filter("vec_id % 5 = 0"), (1, 2)))


@query("io01_corpus_scan", "SELECT lang AS label, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def _(spark, d):
    from curatrix.sources.corpus import as_corpus

    t = table(spark, d, "documents").select(c("lang").alias("type"), c("text").alias("posts"))
    return as_corpus(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("io05_cached_vectors", "SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings")
def _(spark, d):
    import uuid

    from curatrix.sources.corpus import EmbeddingCache

    cache = EmbeddingCache(spark)
    key = cache.key(uuid.uuid4().hex, "stored", 42, "train", 0.2)
    return cache.get_or_compute(key, lambda: emb(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def _fresh(spark, name: str) -> str:
    import uuid

    from curatrix.sources.storage import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("io02_split_scan", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part, lang AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE length(text) > 0 AND text NOT LIKE '%' || chr(13) || '%' GROUP BY ALL")
def _(spark, d):
    from curatrix.sources.corpus import read_split, write_synthetic

    at, t = _fresh(spark, "split"), table(spark, d, "documents").filter("length(text) > 0 and instr(text, '\r') = 0").select("doc_id", c("lang").alias("label"), "text")
    for part, test in (("train", "doc_id % 5 <> 0"), ("test", "doc_id % 5 = 0")):
        write_synthetic(t.filter(test).drop("doc_id"), f"{at}/{part}")
    return read_split(spark, f"{at}/train", f"{at}/test").groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("io03_overrides", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    from curatrix.sources.corpus import read_overrides

    at = _fresh(spark, "overrides")
    n = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n.agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("n")))).alias("m")).select(F.to_json(F.struct(c("m").alias("overrides"))).alias("value")).coalesce(1).write.text(at)
    return spark.createDataFrame([(k, v["n"]) for k, v in read_overrides(spark, at).items()], "label string, n long")


@query("io04_cache_entries", "SELECT 'a' AS key, count(*) AS n, true AS kept, false AS after FROM embeddings WHERE label < 5 UNION ALL SELECT 'b', count(*), true, false FROM embeddings WHERE label >= 5")
def _(spark, d):
    from curatrix.sources.corpus import EmbeddingCache

    cache, rows = EmbeddingCache(spark, _fresh(spark, "cache")), []
    for key, test in (("a", "label < 5"), ("b", "label >= 5")):
        cache.save(key, emb(spark, d).filter(test))
    entries, size = cache.list(), cache.stats()
    rows = [(k, cache.load(k).count(), cache.has(k) and size["entries"] == 2 and size["bytes"] > 0) for k in entries]
    cache.clear()
    return spark.createDataFrame([(*r, cache.has(r[0])) for r in rows], "key string, n long, kept boolean, after boolean")


@query("io07_synthetic_csv", "SELECT lang AS label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (doc_id % 3 = 0) AS empty FROM documents GROUP BY lang")
def _(spark, d):
    from curatrix.sources.corpus import write_synthetic

    at = _fresh(spark, "synthetic")
    t = table(spark, d, "documents").select(c("lang").alias("label"), F.regexp_replace("text", r"[\r\n]", " ").alias("text"), "n_chars", F.when(c("doc_id") % 3 != 0, 0.5).alias("knn_similarity"))
    write_synthetic(t, at)
    back = spark.read.csv(at, header=True, quote='"', escape='"', multiLine=True)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(c("n_chars").cast("long")).alias("chars"), F.sum(c("knn_similarity").isNull().cast("long")).alias("empty"))


RUNS = "WITH r AS (SELECT 'CMB' || r_regionkey AS config, s AS seed, CAST(r_regionkey * 10 + s AS DOUBLE) / 8 AS f1 FROM region, unnest([1, 2]) AS t(s))"


def _runs(spark, d, at: str) -> None:
    """A result file for each region and seed, named by them."""
    from curatrix.sources.corpus import write_metrics

    fs, path = None, spark._jvm.org.apache.hadoop.fs.Path
    for r in table(spark, d, "region").collect():
        for s in (1, 2):
            part = f"{at}/.one"
            write_metrics(spark.range(1).select(F.lit((r.r_regionkey * 10 + s) / 8).alias("f1"), F.lit(None).cast("double").alias("p"), F.create_map(F.lit("a"), F.lit(s)).alias("per_class")).coalesce(1), part)
            fs = fs or path(part).getFileSystem(spark._jsc.hadoopConfiguration())
            found = next(x.getPath() for x in fs.listStatus(path(part)) if x.getPath().getName().startswith("part-"))
            fs.rename(found, path(f"{at}/CMB{r.r_regionkey}_s{s}_20240131.json"))
    fs.delete(path(f"{at}/.one"), True)


@query("io08_metrics_json", f"{RUNS} SELECT count(*) AS n, round(sum(f1), 6) AS f1, 0::BIGINT AS p, CAST(sum(seed) AS BIGINT) AS a FROM r")
def _(spark, d):
    at = _fresh(spark, "metrics")
    _runs(spark, d, at)
    back = spark.read.schema("f1 double, p double, per_class map<string, long>").json(at)
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f1"), 6).alias("f1"), F.count("p").alias("p"), F.sum(F.element_at("per_class", "a")).alias("a"))


@query("io09_result_files", f"{RUNS} SELECT config, CAST(seed AS INTEGER) AS seed, '20240131' AS date, round(f1, 6) AS f1 FROM r")
def _(spark, d):
    from curatrix.sources.corpus import read_results

    at = _fresh(spark, "results")
    _runs(spark, d, at)
    return rounded(read_results(spark, at).select("config", "seed", "date", "f1"))


@query("io10_compiled_results", f"{RUNS} SELECT category, config, count(*) AS n, round(avg(f1), 6) AS f1 FROM r, unnest(['one', 'two']) AS t(category) GROUP BY category, config")
def _(spark, d):
    from curatrix.sources.corpus import compile_results

    at = _fresh(spark, "compiled")
    for category in ("one", "two"):
        _runs(spark, d, f"{at}/{category}")
    return rounded(compile_results(spark, at, ["one", "two"]).groupBy("category", "config").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1")))


@query("xt01_encoder", "SELECT doc_id, round(a / l, 4) AS x, round(b / l, 4) AS y, round(1 / l, 4) AS z FROM (SELECT *, sqrt(a * a + b * b + 1) AS l FROM (SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b FROM documents WHERE length(text) > 0))")
def _(spark, d):
    from curatrix.sources.generators import encode

    def make():
        return lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]

    e = encode(table(spark, d, "documents").filter(F.length("text") > 0), "text", make)
    return e.select("doc_id", *(F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(n) for i, n in enumerate("xyz")))


@query("xt02_generated_candidates", """WITH p AS (SELECT DISTINCT lang, source FROM documents), x AS (SELECT lang, source, t, i, 'text ' || substr(md5('Write about ' || lang || ' ' || source || '/' || t), 1 + i * 4, 8) || ' of some words' AS text FROM p, unnest(['0.7', '1', '1.3']) AS a(t), unnest([0, 1, 2]) AS b(i))
SELECT lang, source, CAST(pos AS INTEGER) AS pos, text FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY CAST(t AS DOUBLE), i) AS pos FROM x) WHERE pos <= 5""")
def _(spark, d):
    from curatrix.sources.generators import EchoGenerator, candidates, generate

    prompts = table(spark, d, "documents").select("lang", "source").distinct().withColumn("prompt", F.concat_ws(" ", F.lit("Write about"), "lang", "source"))
    return candidates(generate(prompts, "prompt", EchoGenerator, (0.7, 1.0, 1.3), concurrency=4), ["lang", "source"]).select("lang", "source", "pos", "text")


@query("io05b_row_cache", "SELECT 'first' AS run, count(DISTINCT text) AS encoded, count(text) AS rows FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'second', (SELECT count(*) FROM (SELECT text FROM documents WHERE text IS NOT NULL EXCEPT SELECT text FROM documents WHERE doc_id % 10 <> 0)), (SELECT count(text) FROM documents) UNION ALL SELECT 'third', 0, (SELECT count(text) FROM documents)")
def _(spark, d):
    """Vectors of nine tenths of the documents, then of all, then again: what each run encodes, and the rows it gives vectors to."""
    from curatrix.sources.vector_cache import VectorCache

    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    docs, rows = table(spark, d, "documents").select("doc_id", "text"), []
    cache = VectorCache(spark, "lengths", _fresh(spark, "vectors"))
    for name, part in (("first", docs.filter("doc_id % 10 <> 0")), ("second", docs), ("third", docs)):
        rows.append((name, cache.fill(part, "text", make), cache.get(part, "text", make).filter("embedding is not null").count()))
    return spark.createDataFrame(rows, "run string, encoded long, rows long")


@query("xt03_resumed_generation", "SELECT lang, doc_id % 50 AS part, count(DISTINCT t) AS answers, count(DISTINCT t) AS calls_answered FROM documents, unnest([0.7, 1.0]) AS x(t) GROUP BY ALL")
def _(spark, d):
    """A prompt for each language and part; every call's first attempt fails, the run is stopped after a wave and goes on in another ledger object."""
    from curatrix.sources.generators import EchoGenerator
    from curatrix.sources.ledger import Ledger

    prompts = table(spark, d, "documents").select("lang", (c("doc_id") % 50).alias("part")).distinct().withColumn("prompt", F.concat_ws(" ", F.lit("Write about"), "lang", "part"))
    make, root = _flaky(EchoGenerator), _fresh(spark, "ledger")
    options = {"root": root, "wait": 0.01, "wave": max(1, prompts.count())}
    Ledger(spark, "run", **options).run(prompts, "prompt", make, (0.7, 1.0), waves=1)
    rest = Ledger(spark, "run", **options)
    rest.run(prompts, "prompt", make, (0.7, 1.0))
    calls = rest.results().filter("error is null").groupBy("digest").agg(F.count(F.lit(1)).alias("good"))
    found = rest.answered(prompts, "prompt").filter("response like '%of some words'").groupBy("lang", "part", F.sha2("prompt", 256).alias("digest")).agg(F.countDistinct("temperature").alias("answers"))
    return found.join(calls, "digest").select("lang", "part", "answers", c("good").alias("calls_answered"))


def _flaky(kind):
    """A generator whose every other call of a prompt fails."""

    def make():
        from collections import Counter

        seen, inner = Counter(), kind()

        class Flaky:
            def generate(self, prompt, temperature=1.0):
                seen[prompt, temperature] += 1
                if seen[prompt, temperature] % 2:
                    raise TimeoutError(prompt)
                return inner.generate(prompt, temperature)

        return Flaky()

    return make


@query("rollup_overall", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents GROUP BY ROLLUP (lang)")
def _(spark, d):
    return rounded(table(spark, d, "documents").rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("chars")))


