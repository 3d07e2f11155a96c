"""Line dedup by overlapping three-line windows.

A text's lines are hashed in overlapping windows of three; windows that occur more than once
anywhere are found by one aggregation with map-side combining (smallest and largest place of
each window), and every occurrence but the first has its lines covered. Overlapping covers
merge, covered lines go. Windows are judged on the input, not on what is left.

Hot windows: those held by over 1/HOT_SHARE of all repeated occurrences (so fewer than
HOT_SHARE of them, at about 100 bytes, which bounds the broadcast to 1 MB) meet their occurrences in a broadcast join;
the rest meet in a shuffled join, whose keys are then small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted, stored, table, unused

LINES = 3
HOT_SHARE, HOT_ROWS = 10_000, 64
EDGES = " \t\n\x0b\x0c\r"


def _windows(lines: str, n: int) -> Column:
    """[(hash, first line)] of the windows of n lines that hold a character other than white space.

    The lines come as a column of their own and are zipped with their shifts: an expression
    inside a lambda would be evaluated again for every window.
    """
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size(lines) - 1).alias("at"), F.col(lines).alias("l0"), *(F.slice(lines, i + 1, F.greatest(F.size(lines) - i, F.lit(0))).alias(f"l{i}") for i in range(1, n)))
    full = F.filter(F.slice(zipped, 1, F.greatest(F.size(lines) - n + 1, F.lit(0))), lambda w: sum(F.length(w[f"l{i}"]) for i in range(n)) > 0)
    text = lambda w: F.concat_ws("\n", *(w[f"l{i}"] for i in range(n)))  # noqa: E731  a line holds no newline, so this is one to one
    return F.transform(full, lambda w: F.struct(F.unhex(F.md5(text(w))).alias("h"), w["at"].alias("at")))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = LINES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with text thinned, and n_lines, n_removed long (columns of those names are replaced).

    Lines are split at newlines and compared without white space at both ends; a window of
    blank lines never repeats. The first occurrence is the one with the smallest identifier,
    then position; a null identifier counts as smallest. A text under n lines, an empty one
    and a null one (which stays null, with 0 lines) lose nothing. Rows with equal identifier
    and text are one document: they never repeat each other and get the same answer. Rows
    that share an identifier but not a text are ordered by the text's digest. If all lines
    go, the text is empty. An empty table stays empty. Other columns stay as they are.
    """
    keep = [quoted(c) for c in others(df, text, "n_lines", "n_removed")]
    id_of, text_of = quoted(id_col), quoted(text)
    key = F.struct(id_of.alias("id"), F.md5(F.coalesce(text_of, F.lit(""))).alias("m"))
    lines = F.transform(F.split(text_of, "\n"), lambda x: F.btrim(x, F.lit(EDGES)))
    occurs = df.filter(F.instr(text_of, "\n") > 0).select(key.alias("__k"), lines.alias("__lines")).select("__k", F.explode(_windows("__lines", n)).alias("__w"))
    occurs = occurs.select(F.col("__w.h").alias("__h"), F.struct("__k", "__w.at").alias("__p"))
    ends = occurs.groupBy("__h").agg(F.min("__p").alias("__first"), F.max("__p").alias("__last"), F.count(F.lit(1)).alias("__n"))
    repeated = stored(ends.filter(F.col("__first") != F.col("__last")).drop("__last"), "line-windows")
    limit = repeated.agg((F.coalesce(F.sum("__n"), F.lit(0)) / HOT_SHARE).alias("__limit"))
    split = repeated.join(F.broadcast(limit)).withColumn("__hot", (F.col("__n") > F.col("__limit")) & (F.col("__n") > hot_rows)).select("__h", "__first", "__hot")
    hot, cold = split.filter("__hot"), split.filter(~F.col("__hot"))
    met = occurs.join(F.broadcast(hot), "__h").unionByName(occurs.join(cold, "__h"))
    covered = met.filter(F.col("__p") != F.col("__first")).select("__p.__k", "__p.at")
    gone = covered.groupBy("__k").agg(F.collect_set("at").alias("__at"))
    gone = gone.select(F.col("__k.id").alias("__id"), F.col("__k.m").alias("__m"), F.flatten(F.transform("__at", lambda i: F.sequence(i, i + n - 1))).alias("__gone"))
    # The lines cross the join in place of the text, so that they are split once.
    k, raw, m = unused(df, "__key", "__raw", "__m2")
    gone_id, gone_m, at = unused(df.select("*", F.lit(0).alias(k), F.lit(0).alias(raw), F.lit(0).alias(m)), "__id", "__m", "__gone")
    gone = gone.select(F.col("__id").alias(gone_id), F.col("__m").alias(gone_m), F.col("__gone").alias(at))
    whole = df.select(*keep, id_of.alias(k), F.split(text_of, "\n").alias(raw), F.md5(F.coalesce(text_of, F.lit(""))).alias(m))
    both = whole.join(gone, F.col(k).eqNullSafe(F.col(gone_id)) & (F.col(m) == F.col(gone_m)), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col(at))
    thin = F.transform(left, lambda i: F.element_at(raw, i + 1))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return both.select(
        *keep, F.array_join(F.when(F.col(at).isNull(), F.col(raw)).otherwise(thin), "\n").alias(text),
        count(F.when(F.col(raw).isNotNull(), F.size(raw))).alias("n_lines"), count(F.when(F.col(at).isNotNull(), F.size(F.array_distinct(at)))).alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The thinned text of every document with a text; also used for the pipeline's tests.
THIN_SQL = r"""
w AS (SELECT doc_id, i AS pos, array_to_string(list_slice(ls, i + 1, i + 3), chr(10)) AS t
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')) AS ls FROM documents), unnest(range(0, greatest(len(ls) - 2, 0))) AS u(i)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS nth FROM w WHERE length(t) >= 3),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, unnest([0, 1, 2]) AS v(k) WHERE nth > 1),
l AS (SELECT doc_id, i AS pos, string_split(text, chr(10))[i + 1] AS line FROM documents, unnest(range(0, len(string_split(text, chr(10))))) AS u(i)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, coalesce(string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
"""
OP9_SQL = f"""WITH {THIN_SQL}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
