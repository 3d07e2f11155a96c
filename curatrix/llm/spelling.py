"""Spelling variants by a rare-first prefix filter over positional bigrams.

1. Words are counted in each text, then in each task, then by one aggregation. What follows works on
   distinct words, each with its count.
2. Bigrams are ordered by the number of words that hold them, rare first, then by themselves and their place in the word. One
   changed, inserted or deleted character destroys at most two bigrams of each word, so of the three rarest of
   either word at least one is also among the three rarest of the other, at a position shifted by
   one at most.
3. Around a shared bigram the change lies on one side only: the words agree up to and with it, or from it on.
   So a word is posted under (bigram with all before it) and (bigram with all behind it) for each of its
   three rarest; the position limit is part of the key.
4. Words that share a key are verified in pairs, where there are at most MEMBERS of them. A fuller
   key is split: the change then lies in the rest of the word beyond the key's part, so members meet by
   that rest without one character. A word costs a key as many rows as its rest is long, and those that meet
   without the same character at the same place differ just there: an alphabet of 90 bounds them.
5. A word's form is the best of its near words; roots follow forms by doubling.

Words are never collected; what is broadcast are the ranks of at most 8,100 bigrams.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored, table
from .wordhash import pieces

#: Runs of these are words: A to Z, a to z, U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, PREFIX = 6, 5, 5, 3
#: Every so many of a text's words, by a hash of identifier and word, lose one character.
THINNED = 199
#: Words that share a key are compared in pairs up to so many.
MEMBERS = 32
#: Distinct words that a task holds before it sends them on.
HELD = 200_000
#: Characters from which a text's words aren't listed before they are counted.
LONG = 1 << 22


def _counts(batches: Iterator[pa.RecordBatch], thinned: int | None, least: int) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[{LETTERS}]{{{least},}}")  # a greedy match from the left: whole runs of that length or more
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for b in pieces(batches, 1):
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not text:
                continue
            text = text.encode().lower().decode()  # bytes.lower() knows A-Z only
            words = Counter(run.findall(text) if len(text) < LONG else (m.group() for m in run.finditer(text)))
            start = zlib.crc32(f"{'' if i is None else i}:".encode())
            for word, n in words.items():
                if thinned and (h := zlib.crc32(word.encode(), start)) % thinned == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) < least:
                        continue
                total[word] += n
        if len(total) > HELD:
            yield out()
            total.clear()
    yield out()


def word_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", thinned: int | None = THINNED, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least that length and number of occurrences, A-Z lower-cased.

    thinned: a word whose crc32 of "<id>:<word>" it divides loses the character at place crc32 % length in that text; None: none does.
    """
    small_batches(df.sparkSession)
    rows = df.select(quoted(id_col).cast("string").alias("id"), quoted(text).alias("text"))
    each = rows.mapInArrow(lambda batches: _counts(batches, thinned, length), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _prefixes(word: str, ranks: dict[str, int]) -> list[tuple[str, str, str]]:
    """(side, key, rest) of a word for each of its rarest bigrams: all up to the bigram and what follows, all from it on and what precedes."""
    at = sorted(range(len(word) - 1), key=lambda p: (ranks[word[p : p + 2]], p))[:PREFIX]
    return [x for p in at for x in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p]))]


def postings(words: DataFrame) -> DataFrame:
    """(side, key, rest, word, n) of each word (word, n) under its rarest positional bigrams."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    held = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    ranks = {r.gram: i for i, r in enumerate(held.orderBy("c", "gram").collect())}  # 90 letters: at most 8,100 rows
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*x, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in _prefixes(w, shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.int64())], names=["side", "key", "rest", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "side string, key string, rest string, word string, n long")


def _pair(a: str, b: str) -> list[Column]:
    """Both words of a pair with their counts, the smaller word first."""
    first = F.col(f"{a}.word") < F.col(f"{b}.word")
    return [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{name}_{c}") for name, x, y in (("a", a, b), ("b", b, a)) for c in ("word", "n")]


def near_pairs(words: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(a_word, a_n, b_word, b_n), a_word < b_word: all pairs of words one inserted, deleted or replaced character apart."""
    posts = stored(postings(words), "spelling-postings")
    sizes = posts.groupBy("side", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = stored(posts.join(sizes, ["side", "key"]), "spelling-met")
    few, many = met.filter(F.col("c") <= members).drop("c"), met.filter(F.col("c") > members).drop("c")
    same = lambda *names: reduce(and_, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in names))
    ordered = F.col("x.word") < F.col("y.word")
    apart = (F.abs(F.length("x.rest") - F.length("y.rest")) <= 1) & (F.levenshtein(F.col("x.rest"), F.col("y.rest"), 1) == 1)
    pairs = few.alias("x").join(few.alias("y"), same("side", "key") & ordered & apart).select(*_pair("x", "y"))
    cut = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.struct(i.alias("at"), F.concat(F.substr("rest", F.lit(1), i - 1), F.substr("rest", i + 1)).alias("left")))
    holes = many.filter(F.length("rest") > 0).select("side", "key", "word", "n", F.explode(cut).alias("h")).select("side", "key", "word", "n", "h.at", "h.left")
    holes = stored(holes, "spelling-holes")
    pairs = pairs.unionByName(holes.alias("x").join(holes.alias("y"), same("side", "key", "left", "at") & ordered).select(*_pair("x", "y")))
    pairs = pairs.unionByName(many.alias("x").join(holes.alias("y"), same("side", "key") & (F.col("x.rest") == F.col("y.left"))).select(*_pair("x", "y")))
    return pairs.distinct()


def forms(words: DataFrame, ratio: int = RATIO, members: int = MEMBERS) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word (word, n)."""
    pairs = stored(near_pairs(words, members), "spelling-pairs")
    both = pairs.select(F.col("a_word").alias("w"), F.col("a_n").alias("wn"), F.col("b_word").alias("o"), F.col("b_n").alias("on")).unionByName(pairs.select("b_word", "b_n", "a_word", "a_n").toDF("w", "wn", "o", "on"))
    near = both.groupBy("w").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("on")).alias("minus"), F.col("o").alias("o"))).alias("best"))
    out = words.join(near, words["word"] == near["w"], "left")
    good = -F.col("best.minus") >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.o")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form (word, form): where their forms lead. Counts grow along forms, so there are no circles; paths double each round."""
    at = stored(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("w"), F.col("root").alias("next"))
        ahead = stored(at.join(step, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if ahead.filter("moved").isEmpty():
            return at
        at = ahead.drop("moved")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text", thinned: int | None = None, length: int = LEAST_LENGTH, least: int = LEAST_COUNT, ratio: int = RATIO, members: int = MEMBERS) -> DataFrame:
    """One row for each word of df's texts with enough characters and occurrences: word, form, root string, n, n_near, form_n long.

    Words are whole runs of A to Z, a to z and U+00C0 to U+00FF, A-Z lower-cased. Near words are one inserted,
    deleted or replaced character apart. form: the near word with the most occurrences (ties:
    the smallest in code-point order), if they are `ratio` times the word's or more, else null.
    root: where forms lead, the word itself if it has none. Words need at least five characters,
    so that three bigrams hold for any change. Null and empty texts have no
    words; a null identifier counts as empty text; repeated rows count each; an empty table gives
    an empty result. Other columns are ignored.
    """
    if length < PREFIX + 2 or ratio < 2:
        raise ValueError(f"length: {length}, ratio: {ratio}")
    told = stored(forms(stored(word_counts(df, id_col, text, thinned, length, least), "spelling-words"), ratio, members), "spelling-forms")
    ends = roots(told).select(F.col("word").alias("w"), F.col("root").alias("end"))
    return told.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), thinned=THINNED)
