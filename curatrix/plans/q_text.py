"""Text queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import classes as C
from curatrix.plans.registry import query, rounded, table

#: DuckDB's words and shingles.
W = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
SH = """sh AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN list_distinct(w) ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s
  FROM (SELECT doc_id, """ + W.format("lower(text)") + " AS w FROM {}))"
NOISY = "'http://a.b/c ' || replace(text, ' of ', ' |||| ') || ' www.x.y _end_ '"


def docs(spark, d):
    return table(spark, d, "documents")


def noisy(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("http://a.b/c "), F.replace("text", F.lit(" of "), F.lit(" |||| ")), F.lit(" www.x.y _end_ ")).alias("text"))


@query("tx01_normalize_text", rf"SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace({NOISY}, '\|\|\|+', '. ', 'g'), '(?i)https?://\S+|www\.\S+', '', 'g'), '_', ' '), '\s+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return noisy(spark, d).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("tx02_normalize_light", rf"SELECT doc_id, trim(regexp_replace(regexp_replace({NOISY}, 'https?://\S+', '', 'g'), '\|\|\|', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents")
def _(spark, d):
    return noisy(spark, d).select("doc_id", T.normalize_light(F.col("text")).alias("text"))


@query("tx03_word_count", f"SELECT doc_id, CAST(len({W.format('text')}) AS INTEGER) AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("tx04_clip_words", f"SELECT doc_id, CASE WHEN len({W.format('text')}) <= 60 THEN text ELSE array_to_string(list_slice({W.format('text')}, 1, 60), ' ') END AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.clip_words(F.col("text"), 60).alias("text"))


LINES = "SELECT conv_id, turn, (turn + 1) || ') [' || upper(role) || ']: ' || text AS text FROM conversations"


@query("tx05_candidate_cleaning", rf"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s*\d+[\)\.:\-]\s*', ''), '(?i)^\s*[\[\(]?(user|assistant|system)[\]\)]?\s*[:\-]?\s*', '') AS text FROM ({LINES})")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat((F.col("turn") + 1).cast("string"), F.lit(") ["), F.upper("role"), F.lit("]: "), F.col("text")).alias("text"))
    return c.select("conv_id", "turn", T.strip_tag(T.strip_number(F.col("text")), ["user", "assistant", "system"]).alias("text"))


@query("tx06_shingle_sets", f"WITH {SH.format('documents')} SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS digest FROM sh")
def _(spark, d):
    s = docs(spark, d).select("doc_id", T.shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


@query("tx07_jaccard_neighbours", f"WITH {SH.format('documents')} SELECT a.doc_id, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS jaccard FROM sh a JOIN sh b ON b.doc_id = a.doc_id + 1")
def _(spark, d):
    s = docs(spark, d).select("doc_id", T.shingles(F.col("text")).alias("s"))
    both = s.alias("a").join(s.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return both.select("a.doc_id", F.round(T.jaccard(F.col("a.s"), F.col("b.s")), 6).alias("jaccard"))


@query("tx08_top_keywords", rf"""SELECT lang, word, n, rank FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (
  SELECT lang, lower(w) AS word, count(*) AS n FROM (SELECT lang, unnest({W.format("text")}) AS w FROM documents) WHERE length(w) > 3 AND regexp_full_match(w, '\p{{L}}+') GROUP BY lang, lower(w))) WHERE rank <= 20""")
def _(spark, d):
    return C.top_keywords(docs(spark, d), "lang")


@query("tx09_vocabulary_diversity", r"""SELECT lang, count(*) AS distinct_words, CAST(sum(n) AS BIGINT) AS total_words, round(count(*) / sum(n), 6) AS diversity FROM (
  SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))) AS w FROM documents) GROUP BY lang, w) GROUP BY lang""")
def _(spark, d):
    return rounded(C.vocabulary_diversity(docs(spark, d), "lang"))


@query("tx10_text_hash", "SELECT doc_id, substr(md5(text), 1, 16) AS hash FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query("tx11_response_lines", """SELECT doc_id, CAST(i AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (
  SELECT doc_id, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10), 1, 5) AS l FROM documents))""")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.response_lines(F.col("text"), 5, 10)).alias("pos", "line"))


@query("tx12_prefixed", "SELECT doc_id, 'query: ' || text AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.prefixed(F.col("text"), "query: ").alias("text"))


CLIP = "CASE WHEN len(" + W + ") <= 60 THEN {} ELSE array_to_string(list_slice(" + W + ", 1, 60), ' ') END"


@query("tx13_prompts", f"""WITH k AS (SELECT lang, array_to_string(list(source ORDER BY source), ', ') AS kw FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS r FROM (SELECT DISTINCT lang, source FROM documents)) WHERE r <= 10 GROUP BY lang)
SELECT doc_id, 'Write 5 new texts of class [' || lang || '] in the tone of the examples.' || chr(10) || 'Frequent words: ' || kw || '.' || chr(10) || 'Example 1: ' || source || chr(10) || 'Text A: ' || {CLIP.format("text", "text", "text")} || chr(10) || 'Text B: ' || source || ' Write in English only.' || chr(10) || 'Return exactly 5 texts, one a line.'
 || chr(10) || 'Each text has about ' || n_chars || ' words (from ' || CAST(floor(n_chars * 0.8::DOUBLE) AS BIGINT) || ' to ' || CAST(floor(n_chars * 1.2::DOUBLE) AS BIGINT) || ').' AS prompt FROM documents JOIN k USING (lang)""")
def _(spark, d):
    k = docs(spark, d).select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("kw"))
    both = docs(spark, d).join(F.broadcast(k), "lang")
    return both.select("doc_id", T.prompt("mix", F.col("lang"), 5, F.col("kw"), F.col("text"), F.col("source"), F.array("source"), language="en", target_words=F.col("n_chars")).alias("prompt"))


@query("tx14_prompt_parts", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'Class: English' || chr(10) || chr(10) || source ELSE source END AS described, CASE WHEN lang = 'fr' THEN source || chr(10) || chr(10) || 'Unlike: en, de' ELSE source END AS contrasted,
  'Between ' || n_chars || ' and ' || (n_chars + 5) || ' words.' AS ranged, 'Exactly ' || n_chars || ' words.' AS strict, 'About ' || n_chars || ' words.' AS loose FROM documents""")
def _(spark, d):
    names = spark.createDataFrame([("en", "English", []), ("fr", None, ["en", "de"])], "lang string, description string, others array<string>")
    both = docs(spark, d).join(F.broadcast(names), "lang", "left")
    length = lambda mode: T.length_instruction(mode, F.col("n_chars"), F.col("n_chars"), F.col("n_chars") + 5)
    return both.select("doc_id", T.described(F.col("source"), F.col("description")).alias("described"), T.contrasted(F.col("source"), F.coalesce("others", F.array())).alias("contrasted"), length("range").alias("ranged"), length("strict").alias("strict"), length("loose").alias("loose"))


@query("tx15_readable", rf"SELECT doc_id, length(text) >= 20 AND len({W.format('text')}) >= 5 AND NOT regexp_matches(trim(text), '^(http|#|@)') AS readable FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.readable(F.col("text")).alias("readable"))


@query("ma05_length_match", f"SELECT doc_id, round(greatest(0.0, 1.0 - abs(1.0 - len({W.format('text')}) / 250.0::DOUBLE)), 6) AS score FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.round(F.greatest(F.lit(0.0), 1.0 - F.abs(1.0 - T.word_count(F.col("text")) / 250.0)), 6).alias("score"))


@query("ag04_word_stats", f"SELECT lang, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(stddev_pop(w), 6) AS std, CAST(min(w) AS INTEGER) AS least, CAST(max(w) AS INTEGER) AS most FROM (SELECT lang, len({W.format('text')}) AS w FROM documents) GROUP BY lang")
def _(spark, d):
    return rounded(C.word_stats(docs(spark, d), "lang"))


BOUNDS = f"""b AS (SELECT lang, count(*) AS n, avg(w) AS mean, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.75) AS p75, stddev_pop(w) AS std FROM (SELECT lang, len({W.format('text')}) AS w FROM documents) GROUP BY lang),
t AS (SELECT *, CAST(floor(median) AS BIGINT) AS target, greatest(50, CAST(floor(p25 * 0.8::DOUBLE) AS BIGINT)) AS low, CAST(floor(p75 * 1.2::DOUBLE) AS BIGINT) AS high FROM b)"""


@query("ag05_length_bounds", f"WITH {BOUNDS} SELECT lang, n, round(mean, 6) AS mean, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(std, 6) AS std, target, low, high FROM t")
def _(spark, d):
    return rounded(C.length_bounds(docs(spark, d), "lang"))


@query("fl08_length_filter", f"WITH {BOUNDS} SELECT doc_id, CASE WHEN w < low THEN 'too_short' WHEN w > high THEN 'too_long' ELSE 'accepted' END AS reason FROM (SELECT doc_id, lang, len({W.format('text')}) AS w FROM documents) JOIN t USING (lang)")
def _(spark, d):
    b = C.length_bounds(docs(spark, d), "lang").select("lang", "low", "high")
    w = docs(spark, d).select("doc_id", "lang", T.word_count(F.col("text")).alias("w")).join(F.broadcast(b), "lang")
    return w.select("doc_id", F.when(F.col("w") < F.col("low"), "too_short").when(F.col("w") > F.col("high"), "too_long").otherwise("accepted").alias("reason"))


@query("jn05_near_dup_vs_benchmark", f"""WITH {SH.format("documents")}, bs AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS s FROM (SELECT item_id, {W.format("lower(text)")} AS w FROM benchmark)),
x AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sh), y AS (SELECT item_id, unnest(s) AS g, len(s) AS m FROM bs)
SELECT doc_id, item_id, round(count(*) / (any_value(n) + any_value(m) - count(*)), 6) AS jaccard FROM x JOIN y ON x.g = y.g GROUP BY doc_id, item_id HAVING count(*) / (any_value(n) + any_value(m) - count(*)) > 0.3""")
def _(spark, d):
    from curatrix.operators.dedup import shingle_join

    return rounded(shingle_join(docs(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id", threshold=0.3))


@query("se03_union_distinct_lines", """SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY t, turn) AS r FROM (SELECT *, 0 AS t FROM conversations UNION ALL SELECT *, 1 FROM conversations WHERE turn % 2 = 0)) WHERE r = 1""")
def _(spark, d):
    c = table(spark, d, "conversations")
    every = c.withColumn("t", F.lit(0)).unionByName(c.filter("turn % 2 = 0").withColumn("t", F.lit(1)))
    return every.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("t", "turn"))).filter("r = 1").select("conv_id", "text")
