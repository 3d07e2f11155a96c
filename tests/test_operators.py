import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions import vectors as V
from curatrix.operators import anchors as A
from curatrix.operators import cascades as X
from curatrix.operators import classes as C
from curatrix.operators import clusters as K
from curatrix.operators import confusers
from curatrix.operators import dedup as D
from curatrix.operators import evaluation as E
from curatrix.operators import gates as G
from curatrix.operators import neighbors as N
from curatrix.sources import corpus, generators

EMB = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def emb(spark):
    return spark.read.parquet(EMB)


def test_significance_of_known_folds(spark):
    assert math.isclose(E.t_cdf(2.0, 10), 0.963306, abs_tol=1e-6) and math.isclose(E.t_quantile(0.975, 14), 2.144787, abs_tol=1e-5)
    t, n = 3.895394958584634, 15
    assert math.isclose(2 * (1 - E.t_cdf(t, n - 1)), 0.0016163393924578295, rel_tol=1e-9)
    df = spark.createDataFrame([("flat", 1.0), ("flat", 1.0), ("one", 2.0)] + [("x", v) for v in (1.0, 2.0, 4.0)], "g string, v double")
    out = {r.g: r for r in E.significance(E.paired(df, ["g"], "v")).collect()}
    assert out["flat"].t is None and out["one"].p_value is None and math.isclose(out["x"].t, (7 / 3) / (np.std([1, 2, 4], ddof=1) / 3**0.5))


def test_text_edges(spark):
    rows = ["", "   ", "http://a.b", "|||", "two words", None, "A_b  |||| c www.x.y"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    out = df.select(T.normalize(F.col("t")).alias("n"), T.word_count(F.col("t")).alias("w"), T.shingles(F.col("t")).alias("s"), T.clip_words(F.col("t"), 1).alias("c"), T.readable(F.col("t")).alias("r")).collect()
    assert [r.n for r in out] == ["", "", "", ".", "two words", None, "A b . c"]
    assert out[0].s == [] and out[4].s == ["two", "words"] and out[4].c == "two" and out[2].r is False
    j = spark.createDataFrame([(["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>").select(T.jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [r.j for r in j.collect()] == [0.0, 0.5]
    p = spark.range(1).select(T.prompt("mix", F.lit("c{x}"), 2, F.array(F.lit("k")), F.lit("{a}"), F.lit("b"), F.array(F.lit("e1"), F.lit("e2"))).alias("p")).first().p
    assert "class [c{x}]" in p and "Example 2: e2" in p and "Text A: {a}" in p


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    out = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e"), V.argmax(F.col("a")).alias("m"), V.margin(F.col("a")).alias("g")).collect()
    assert math.isclose(out[0].c, 0.96) and out[1].c is None and math.isclose(out[0].e, 2**0.5) and (out[0].m, out[0].g) == (1, 1.0)


def test_ladder_boundaries(spark):
    vals = [0.0, 0.10, 0.15, 0.20, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70, None]
    df = spark.createDataFrame([(x,) for x in vals], "x double")
    x = F.col("x")
    out = df.select("x", G.f1_budget(x).alias("f"), G.risk(x).alias("r"), G.confidence(x, x, x).alias("c"), G.enhanced_budget(F.lit(1000), x, x, x).alias("b")).collect()
    by = {r.x: r for r in out}
    assert by[0.35].f == 0.0 and by[0.20].f == 0.5 and by[None].f is None
    assert [by[v].r for v in (0.0, 0.30, 0.50, 0.70)] == ["high", "medium", "normal", "low"]
    assert math.isclose(by[0.30].c, 0.3 * 0.3 + 0.5 * 0.5 + 0.2 * 0.5) and by[0.0].b == 10 and by[0.45].b == 56 and by[0.50].b == 40
    assert spark.range(1).select(G.cap(F.lit(10), 0, 0).alias("c")).first().c is None
    gate = spark.createDataFrame([(0.7, 0.3, 100), (0.7, 0.3, 200), (0.1, 0.9, 10)], "q double, p double, n int")
    ok = [r.ok for r in gate.select(G.anchor_gate(F.col("q"), F.col("p"), F.col("n"), 0.6, 0.4, True).alias("ok")).collect()]
    assert ok == [True, False, False]


def test_class_edges(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    q = {r.label: r for r in C.anchor_quality(df, k=2).collect()}
    assert q["a"].quality == 0.0 and q["b"].cohesion is None and not q["a"].generate and math.isclose(q["a"].separation, 1.0)
    assert C.separation(df.filter("label = 'a'"), "label").first().separation == 1.0
    with pytest.raises(ValueError):
        C.minority(df, "label", explicit=["z"])
    assert {r.label: r.f1 for r in C.prf(df.withColumn("p", F.lit("a")), "label", "p").collect()} == {"a": 0.8, "b": 0.0}
    assert {r.silhouette for r in C.silhouette(df).filter("label = 'b'").collect()} == {0.0}


def test_neighbours_in_blocks(spark, emb, monkeypatch):
    want = N.nearest(emb, emb, 3).orderBy("q", "rank").collect()
    monkeypatch.setattr(N, "BLOCK", 100)
    monkeypatch.setattr(N, "TILE", 7)
    assert N.nearest(emb, emb, 3).orderBy("q", "rank").collect() == want
    assert N.nearest(emb, emb, 3)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    x = np.array([r.embedding for r in emb.orderBy("vec_id").collect()], float)
    ids = [r.vec_id for r in emb.orderBy("vec_id").collect()]
    s = np.corrcoef(x) * 0 + (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    np.fill_diagonal(s, -2)
    assert [r.c for r in want if r["rank"] == 1] == [ids[i] for i in s.argmax(1)]
    pairs = {(r.a, r.b) for r in N.similar_pairs(emb, 0.35).collect()}
    assert pairs == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(s, 1) > 0.35), strict=True)}
    # Groups larger and smaller than a block, and one without a name.
    g = emb.withColumn("g", F.when(F.col("vec_id") % 2 == 0, "big").when(F.col("vec_id") % 3 > 0, F.concat(F.lit("s"), F.col("vec_id") % 7)))
    of = {r.vec_id: r.g for r in g.collect()}
    at = {i: k for k, i in enumerate(ids)}
    for same in (True, False):
        got = {r.q: r.c for r in N.nearest(g, g, 1, query_group="g", corpus_group="g", same=same).collect()}
        for i in ids:
            fit = [j for j in ids if j != i and (of[i] == of[j]) == same]
            assert got[i] == max(fit, key=lambda j, i=i: (round(s[at[i], at[j]], 12), -j))
    pairs = {(r.a, r.b) for r in N.similar_pairs(g, 0.3, group="g").collect()}
    assert pairs == {(a, b) for a in ids for b in ids if a < b and of[a] == of[b] and s[at[a], at[b]] > 0.3}
    total = {r.g: (r.total, r.n) for r in N.pair_distances(g, "embedding", "g", "vec_id").collect()}
    big = [at[i] for i in ids if of[i] == "big"]
    d = [np.linalg.norm(x[p] - x[q]) for p in big for q in big if p < q]
    assert total["big"][1] == len(d) and abs(total["big"][0] - sum(d)) < 1e-6
    spread = {r.id: r.deviation for r in N.cosine_spread(g, g, "vec_id", "embedding", "g").collect()}
    cos = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in ids[:60]:
        assert abs(spread[i] - np.std([cos[at[i]] @ cos[at[j]] for j in ids if of[j] == of[i]])) < 1e-9
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, None), (98, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.q: r.c for r in N.nearest(ties, ties, 1).collect()} == {i: int(i == 0) for i in range(30)}
    assert N.nearest(emb.limit(0), emb, 3).count() == 0 and N.nearest(emb, emb.limit(0), 3).count() == 0


def test_numbers_and_quantiles(spark):
    from curatrix.operators.ranks import numbered, quantiles, with_totals

    r = random.Random(6)
    rows = [(i, r.choice("aaaaab") if i % 9 else None, r.choice([0.5, 1.0, 2.25, None]) if i % 4 else r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(5)
    got = {x.id: (x["rank"], x["size"]) for x in numbered(df, ["g"], [-F.col("id")]).collect()}
    for g in ("a", "b", None):
        ids = sorted((i for i, h, _ in rows if h == g), reverse=True)
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]
    want = {g: np.percentile([x for _, h, x in rows if h == g and x is not None], [0, 20, 50, 99]) for g in ("a", "b", None)}
    for x in quantiles(df, ["g"], "x", {"q0": 0.0, "q2": 0.2, "q5": 0.5, "q9": 0.99}).collect():
        assert np.allclose([x.q0, x.q2, x.q5, x.q9], want[x.g])
    assert {x.g: x.t for x in with_totals(df, "g", {"t": F.count(F.lit(1))}).collect()} == {g: sum(h == g for _, h, _ in rows) for g in ("a", "b", None)}
    assert numbered(df.limit(0), ["g"], ["id"]).count() == 0 and quantiles(df.limit(0), ["g"], "x", {"q": 0.5}).count() == 0


def test_greedy_is_the_ordered_walk(spark):
    r = random.Random(4)
    for n, m in ((30, 60), (50, 40), (10, 0)):
        pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
        kept: list[int] = []
        for i in range(n):
            if not any((j, i) in pairs for j in kept):
                kept.append(i)
        nodes = spark.range(n).withColumnRenamed("id", "vec_id")
        edges = spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in pairs], "a long, b long")
        assert sorted(x.vec_id for x in D.greedy_keep(nodes, edges, "vec_id").filter("kept").collect()) == kept


def test_farthest_first(spark, emb):
    got = A.farthest_first(emb, "label", 4).collect()
    for label in (0, 5):
        rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in emb.filter(F.col("label") == label).collect())
        x = np.array([v / np.linalg.norm(v) for _, v in rows])
        chosen = [0]
        while len(chosen) < 4:
            near = np.round(1 - (x @ x[chosen].T), 12).min(1)
            near[chosen] = -1
            chosen.append(int(near.argmax()))
        assert [r.vec_id for r in sorted(got, key=lambda r: r.step) if r.label == label] == [rows[i][0] for i in chosen]


def test_outliers_of_small_groups_stay(spark):
    df = spark.createDataFrame([(i, "a", [float(i), 0.0]) for i in range(4)] + [(10 + i, "b", [float(i**3), 1.0]) for i in range(9)], "vec_id long, label string, embedding array<double>")
    out = K.by_density(df, 5, 0.85, group="label").collect()
    assert sum(r.label == "a" for r in out) == 4 and 18 not in {r.vec_id for r in out}


def test_clusters(spark, emb):
    d, centroids, inertia = K.kmeans(emb.filter("label = 0"), 3)
    assert len(centroids) == 3 and inertia > 0 and {r.cluster for r in d.collect()} == {0, 1, 2}
    one, centroids, _ = K.kmeans(emb.limit(2), 5)
    assert len(centroids) == 1 and {r.cluster for r in one.collect()} == {0}
    assert K.contrastive(emb, sample=50).count() == emb.count()
    pairs = K.smote_pairs(emb, emb.limit(3), 10).collect()
    assert len(pairs) == 10 and all(0 <= p.by < 1 and p.anchor != p.neighbour for p in pairs)


def test_cascade_paths(spark):
    rows = [(1, "s", 5, 0.9, 0.9, 0.0), (2, "s", 50, 0.1, 0.1, 0.0), (3, "s", 50, 0.9, 0.1, 0.7), (4, "t", 50, 0.9, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "vec_id int, spec string, tokens int, sim double, anchor_sim double, other_sim double")
    df = df.withColumns({"neighbour_sim": F.lit(-1.0), "confuser_sim": F.lit(None).cast("double"), "nearest_sim": F.lit(0.1), "proba": F.array(F.lit(0.8), F.lit(0.2)), "target": F.lit(0), "knn_sim": F.lit(0.0), "text_dup": F.lit(False)})
    out = X.main_cascade(df)
    assert [r.reason for r in out.orderBy("vec_id").collect()] == ["length", "similarity", "repel", "accepted"]
    graced = X.grace(out, "spec", "vec_id", least_anchor=0.05).collect()
    assert [r.vec_id for r in graced] == [2]
    texts = spark.createDataFrame([(1, "b", "a b c d e f"), (2, "b", "a b c d e f"), (3, "b", "x y z"), (4, "c", "a b c d e f")], "i int, g string, text string")
    assert {r.i for r in X.batch_duplicates(texts, "g", "i", "i").filter("kept").collect()} == {1, 3, 4}
    relaxed = X.relaxed(spark.createDataFrame([(1, "g", 0.5), (2, "g", 0.45), (3, "g", 0.1), (4, "h", 0.2)], "vec_id int, g string, s double"), "g", "s", F.lit(0.7), k=2)
    assert {(r.vec_id, r.used) for r in relaxed.collect()} == {(1, 0.4), (2, 0.4), (4, None)}


def test_confusers(spark):
    assert confusers.primary("infp") == "ENFP" and confusers.primary("x") is None and confusers.confusers("INFP", 2) == ["ENFP", "INTP"]
    assert all(len(v) == 4 and k not in v and {*v} <= {*confusers.CONFUSERS} for k, v in confusers.CONFUSERS.items())
    rows = [("infp", None, "core"), ("INFP", "INTP", "heart"), ("INFP", "ENFP", "quiet"), ("INFP", "ENFP", "quiet"), ("INFP", "XXXX", "other"), ("INFP", "ISFP", None), (None, "ENFP", "x"), ("new", "old", "y")]
    got = {r.label: r.description for r in confusers.descriptions(spark.createDataFrame(rows, "label string, other string, trait string")).collect()}
    assert got == {"INFP": "How INFP differs from the classes near it:\n  - Not like ENFP: quiet\n  - Not like INTP: heart\n  - Not like XXXX: other\n  - At its core: core", "NEW": "How NEW differs from the classes near it:\n  - Not like OLD: y"}
    assert confusers.descriptions(spark.createDataFrame([], "label string, other string, trait string")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('type,posts\nx,"one, two"\ny,\nz,"three\nlines"\n')
    got = corpus.read_corpus(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.label, r.text) for r in got] == [("x", "one, two"), ("z", "three\nlines")]
    with pytest.raises(ValueError):
        corpus.as_corpus(spark.range(1))
    assert corpus.read_split(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv")).count() == 4
    (tmp_path / "o.json").write_text('{"overrides": {"x": {"cap": 3}}}')
    assert corpus.read_overrides(spark, str(tmp_path / "o.json")) == {"x": {"cap": 3}} and corpus.read_overrides(spark, None) == {}
    pytest.importorskip("yaml")
    for name, text in (("o.yaml", "overrides:\n  x:\n    cap: 3\n"), ("p.yml", "x: {cap: 3}\n")):
        (tmp_path / name).write_text(text)
        assert corpus.read_overrides(spark, str(tmp_path / name)) == {"x": {"cap": 3}}
    (tmp_path / "q.yml").write_text("- 1\n")
    assert corpus.read_overrides(spark, str(tmp_path / "q.yml")) == {}
    (tmp_path / "r" / "one").mkdir(parents=True)
    (tmp_path / "r" / "one" / "V2_high_s42_20250101.json").write_text('{"delta": 0.5}')
    r = corpus.compile_results(spark, str(tmp_path / "r"), ["one"]).first()
    assert (r.config, r.seed, r.date, r.delta, r.category) == ("V2_high", 42, "20250101", 0.5, "one")
    corpus.write_synthetic(spark.createDataFrame([("a", 'q"uote', None)], "label string, text string, sim double"), str(tmp_path / "s"))
    assert corpus.read_corpus(spark, str(tmp_path / "s")).first().text == 'q"uote'
    corpus.write_metrics(spark.createDataFrame([({"a": 1.0}, None)], "m map<string,double>, n int"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == '{"m":{"a":1.0},"n":null}'
    cache = corpus.EmbeddingCache(spark, str(tmp_path / "cache"))
    key, calls = cache.key("p.csv", "m/x", 1, "train", 0.2, 0.1), []
    for _ in range(2):
        assert cache.get_or_compute(key, lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1 and cache.list() == [key] and cache.stats()["bytes"] > 0
    cache.clear()
    assert cache.list() == []


def test_generators(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def generate(self, prompt, temperature=1.0):
            self.calls += 1
            if prompt == "bad" or self.calls == 1:
                raise RuntimeError("no")
            return f"1) {prompt}\n\n2. {temperature:g}\n{prompt}", {"prompt_tokens": 1, "completion_tokens": 2}

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "i int, p string").coalesce(1)
    out = generators.generate(df, "p", Flaky, (0.5, 1.0), retries=2, wait=0.0)
    rows = {(r.i, r.temperature): r for r in out.collect()}
    assert rows[(1, 0.5)].attempts == 2 and rows[(2, 1.0)].response is None and "RuntimeError" in rows[(2, 1.0)].error
    got = generators.candidates(out, ["i"]).orderBy("pos").collect()
    assert [r.text for r in got] == ["good", "0.5", "1"]
    generators.register("flaky", Flaky)
    assert isinstance(generators.create("flaky"), Flaky)
    with pytest.raises(ValueError):
        generators.create("none")


def test_entry_without_llm(tmp_path):
    """The rest imports and has its queries where the llm folders and the pipeline are absent."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/curatrix", tmp_path / "curatrix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    n, llm, m = said.stdout.split()
    assert int(n) > 150 and llm == "False" and int(m) > 120, said.stderr


def test_contrastive_draws_from_all_rows(spark):
    import numpy as np

    rows = [(k, None if k % 7 == 0 else f"c{k % 3}", [k % 11 / 50, k % 13 / 50]) for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    want, rng = {r[0]: np.array(r[2]) for r in rows}, np.random.default_rng(42)
    for _ in range(200):
        i = order[rng.integers(6000)]
        same, other = [r for r in order if r[1] == i[1]], [r for r in order if r[1] != i[1]]
        want[i[0]] += 0.01 * (want[same[rng.integers(len(same))][0]] - want[i[0]])
        d = want[i[0]] - want[other[rng.integers(len(other))][0]]
        if 0 < (size := np.linalg.norm(d)) < 0.5:
            want[i[0]] += 0.01 * d / size
    got = {r.vec_id: r.refined for r in K.contrastive(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert K.contrastive(df.limit(0)).count() == 0


def test_elbow_query_searches_the_default_range(spark, monkeypatch):
    from curatrix.plans import registry

    tried = []
    monkeypatch.setattr(K, "weighted_kmeans", lambda x, w, k, *a: (tried.append(k), (None, 1.0 / k))[1])
    assert registry.QUERIES["cl04_elbow_k"](spark, "/root/testdata/sf0.001").count() == 1
    assert tried == list(range(2, 16))
