"""N-gram Jaccard join by grouped prefixes, and the components of its links.

1. Every text becomes the set of its word shingles (64-bit hashes). Shingles are ordered by a
   rough frequency, rare first: counters, one for every LOAD words of the corpus within bounds,
   summed by chunk and broadcast as one byte each. Any order gives right results; rare first
   keeps prefixes selective and sends what many documents share to the end.
2. Equal sets collapse to one node, numbered by the smallest identifier (where several sets
   have the same, by a hash). Sets with identical prefixes and size collapse into one group; only
   groups are posted under their prefix shingles. Sets too small to link with any other but
   equal ones aren't posted.
3. Postings are filtered by class: size and position in the prefix decide what overlap is still
   possible, so pairs of (size, position) classes under a shingle are ruled out first.
4. Members are verified exactly against the leads of the classes they may match (stars: linear
   in the postings), twice, with connected components in between. A large family of near copies
   is thus linked through its leads, without all of its pairs.
5. What may match and is not yet in one component: pairs of groups, filtered by the overlap of
   their prefixes and the rest that is possible, then expanded to pairs of members in different
   components, which are verified. So no link is lost.

Equal or nearly equal copies are pre-aggregated before each shuffle. Components come from
alternating large-star and small-star steps on DataFrames; nothing of documents' size is
collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, small_batches, source_of, stored, table
from .wordhash import Words, buffers, mix, ngrams, pieces

#: Counters: at least and at most 2^these (64 MB broadcast), and words of the corpus for each in between.
COUNTER_BITS, MOST_BITS, LOAD = 22, 26, 256
CHUNK_BITS = 16
STARS = 2
#: A lead with over 1/HOT_SHARE of a round's pairs, and HOT_ROWS at least, is hot.
HOT_SHARE, HOT_ROWS = 1000, 64
#: Tables of identifiers of up to so many bytes, at so many a row, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (ascending), concatenated, and their offsets. A text under n words is one shingle, one without words has none."""
    data, offsets = buffers(column, lower=True)
    words = Words(data, offsets)
    count = len(offsets) - 1
    h = words.hashes()
    per = np.bincount(words.doc, minlength=count)
    hs, ds = [], []
    for k in range(1, n + 1):
        g = ngrams(h, k)
        if not len(g):
            continue
        fit = words.doc[: len(g)] == words.doc[k - 1 :]
        if k < n:
            fit &= per[words.doc[: len(g)]] == k
        hs.append(g[fit])
        ds.append(words.doc[: len(g)][fit])
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(count + 1, np.int64)
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    return h, np.searchsorted(d, np.arange(count + 1))


def _bits(docs: DataFrame) -> int:
    """Counters' number as a power of two, for the corpus: a word is taken as 6 bytes."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(COUNTER_BITS, (size // (6 * LOAD)).bit_length()))


def _frequencies(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """A byte for each of 2^bits counters: 0 for rare shingles, growing with the logarithm of the frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in pieces(batches, 1):
            words = Words(*buffers(b.column(1), lower=True))
            h = ngrams(words.hashes(), n)[words.doc[: max(0, len(words) - n + 1)] == words.doc[n - 1 :]]  # every occurrence: an order needs no better
            total = np.zeros(1 << bits, np.int32) if total is None else total
            at, times = np.unique(mix(h) >> np.uint64(64 - bits), return_counts=True)
            total[at.astype(np.int64)] += times.astype(np.int32)
        if total is not None:
            rows = [(i, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for i, x in enumerate(total.reshape(-1, 1 << CHUNK_BITS)) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(pa.decompress(x.as_py(), 4 << CHUNK_BITS, codec="zstd", asbytes=True), np.int32).astype(np.int64) for x in group.column("counts"))
        return pa.table({"chunk": [group.column("chunk")[0].as_py()], "level": [_level(total).tobytes()]}, schema=pa.schema([("chunk", pa.int32()), ("level", pa.binary())]))

    out = np.zeros((1 << (bits - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for r in docs.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect():
        out[r.chunk] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(6 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Smallest overlap of sets of these sizes that links them: ceil(num (a + b) / (num + den))."""
    return F.floor(((a + b) * num + (num + den - 1)) / (num + den))


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """Whether sets of classes a and b, if this shingle is the first they share, can overlap enough."""
    need = _needed(F.col(f"{a}.n"), F.col(f"{b}.n"), num, den)
    return (F.col(f"{a}.n") - F.col(f"{a}.p") >= need) & (F.col(f"{b}.n") - F.col(f"{b}.p") >= need)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without edges are left out.

    Edges point from the larger node u to the smaller v. Large star: each edge's v gives way to
    v's smallest neighbour; small star: all smaller neighbours of u, and u, point to the
    smallest of them. The smallest neighbours are stored first, so that a hub's edges meet a
    table of one row a key: by broadcast if that is small, else in a join that can be split.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    spent: list[DataFrame] = []

    def lowest(e: DataFrame) -> DataFrame:
        low = stored(e.groupBy("u").agg(F.min("v").alias("m")), "edges-low")
        spent.append(low)
        return F.broadcast(low) if ROW_BYTES * low.count() <= BROADCAST_BYTES else low

    while True:
        for old in spent:
            discard(edges.sparkSession, *source_of(old))
        before, spent = edges, [edges]
        large = edges.join(lowest(edges).withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        spent.append(large)
        low = lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct()
        edges = stored(small, "edges")
        if edges.exceptAll(before).isEmpty() and before.exceptAll(edges).isEmpty():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of representatives that link.

    First by prefixes alone: common shingles are in both prefixes, or behind the end of the one
    that ends first, so the overlap is at most that of the prefixes and the longer rest. A lead
    with very many pairs is met by broadcast, if the sets of all such leads (fewer than
    2 HOT_SHARE) are small; otherwise by shuffle like the rest.
    """
    pairs = stored(pairs, "jaccard-pairs")
    limit = max(HOT_ROWS, pairs.count() // HOT_SHARE)
    each = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("rep")), F.struct(F.lit("b").alias("side"), F.col("b").alias("rep")))).alias("x")).select("x.*")
    hot = stored(each.groupBy("side", "rep").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > limit).select("side", "rep"), "jaccard-hot")
    big = sets.join(F.broadcast(hot.select("rep").distinct()), "rep", "left_semi") if not hot.isEmpty() else None
    if big is not None and 9 * (big.agg(F.sum("n")).first()[0] or 0) > BROADCAST_BYTES:
        big = None
    big = stored(big, "jaccard-leads") if big is not None else None

    def attach(df: DataFrame, k: str, columns: dict[str, str]) -> DataFrame:
        side = lambda s: s.select(F.col("rep").alias(k), *(F.col(c).alias(n) for n, c in columns.items()))
        if big is None:
            return df.join(side(sets), k)
        keys = F.broadcast(hot.filter(F.col("side") == k).select(F.col("rep").alias(k)))
        return df.join(keys, k, "left_anti").join(side(sets), k).unionByName(df.join(keys, k, "left_semi").join(F.broadcast(side(big)), k))

    need = _needed(F.col("a_n"), F.col("b_n"), num, den)
    rest = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    may = attach(attach(pairs, "a", {"a_n": "n", "a_prefix": "prefix"}), "b", {"b_n": "n", "b_prefix": "prefix"})
    may = may.filter(F.size(F.array_intersect("a_prefix", "b_prefix")) + rest >= need).select("a", "b", "a_n", "b_n")
    both = attach(attach(stored(may, "jaccard-pairs"), "a", {"a_s": "shingles"}), "b", {"b_s": "shingles"})
    return both.filter(F.size(F.array_intersect("a_s", "b_s")) >= need).select("a", "b")


def _classify(df: DataFrame, id_col: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(id, hash, n, component, first): of each row the identifier, its text's hash, the size of its set, the smallest identifier of its component and the hash of the row that has it (the smallest, if several do)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    bits = _bits(docs)
    levels = spark.sparkContext.broadcast(_frequencies(docs, n, bits))

    def sets_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Shingles, offsets, sizes and prefixes of a batch's texts."""
        h, off = shingles(b.column(1), n)
        level = levels.value[(mix(h) >> np.uint64(64 - bits)).astype(np.int64)]
        size = np.diff(off)
        by = h[np.lexsort((h, level, np.repeat(np.arange(len(size)), size)))].view(np.int64)
        take = np.where(size > 0, size - -(-size * num // den) + 1, 0)
        return h, off, size.astype(np.int64), [by[i : i + k] for i, k in zip(off[:-1], take, strict=True)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            h, off, size, prefix = sets_of(b)
            digest = [hashlib.blake2b(h[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(off[:-1], off[1:], strict=True)]
            group = [hashlib.blake2b(p.tobytes() + int(s).to_bytes(8, "big"), digest_size=16).digest() if s else None for p, s in zip(prefix, size, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size), pa.array(digest, pa.binary()), pa.array(group, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "hash", "n", "digest", "grp", "prefix"])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            h, off, size, prefix = sets_of(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(prefix, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))], names=["rep", "n", "prefix", "shingles"])

    rows = stored(docs.mapInArrow(describe, "id long, hash long, n long, digest binary, grp binary, prefix array<long>"), "jaccard-rows")
    reps = rows.filter("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("r"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("rows"))
    reps = stored(reps.select("digest", F.col("r.id").alias("id"), "r.hash", "n", "grp", "prefix", "rows"), "jaccard-sets")
    # Sets are nodes. An identifier that several sets start from numbers none of them.
    shared = stored(reps.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id", F.lit(True).alias("shared")), "jaccard-shared")
    shared = F.broadcast(shared) if ROW_BYTES * shared.count() <= BROADCAST_BYTES else shared
    reps = reps.join(shared, "id", "left").withColumn("rep", F.when(F.col("shared"), F.xxhash64("digest")).otherwise(F.col("id"))).drop("shared")
    groups = reps.groupBy("grp").agg(F.min("rep").alias("g"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("c"))
    # A set of n shingles links with one of n + 1 at best.
    able = groups.filter(F.col("n") * (den - num) >= num)
    posts = able.select("g", F.col("n").cast("int").alias("n"), F.col("c").cast("int").alias("c"), F.posexplode("prefix").alias("p", "s"))
    alive = posts.groupBy("s").agg(F.sum("c").alias("t")).filter("t > 1").select("s")
    posts = stored(posts.join(alive, "s"), "jaccard-postings")
    classes = posts.groupBy("s", "n", "p").agg(F.sum("c").alias("c"))
    match = _may_match("x", "y", num, den)
    order = F.struct("x.n", "x.p") <= F.struct("y.n", "y.p")
    own = (F.col("x.n") != F.col("y.n")) | (F.col("x.p") != F.col("y.p")) | (F.col("x.c") > 1)
    pairs = classes.alias("x").join(classes.alias("y"), (F.col("x.s") == F.col("y.s")) & order & own & match)
    pairs = stored(pairs.select("x.s", F.struct("x.n", "x.p").alias("x"), F.struct("y.n", "y.p").alias("y")), "jaccard-classes")
    used = pairs.select("s", F.col("x").alias("k")).unionByName(pairs.select("s", F.col("y").alias("k"))).distinct()
    of_group = reps.select("grp", "rep").join(groups.filter("c > 1").select("grp", "g"), "grp").select("g", "rep")
    led = posts.withColumn("k", F.struct("n", "p")).join(used, ["s", "k"]).select("s", "k", "g", "c")
    members = led.filter("c = 1").select("s", "k", "g", F.col("g").alias("rep")).unionByName(led.filter("c > 1").join(of_group, "g").select("s", "k", "g", "rep"))
    members = stored(members, "jaccard-members")
    wanted = stored(members.select("rep").distinct().join(reps.select("rep", "id", "hash"), "rep"), "jaccard-wanted")
    picked = F.broadcast(wanted) if ROW_BYTES * wanted.count() <= BROADCAST_BYTES else wanted
    # A repeated row comes twice here, which at worst finds a link twice.
    sets = bucketed(docs.join(picked, ["id", "hash"]).select("rep", "text").mapInArrow(texts_of, "rep long, n long, prefix array<long>, shingles array<long>"), "jaccard_texts", "rep")
    comps, links = None, None
    for star in range(STARS + 1):
        if comps is None:
            state = members.withColumn("comp", F.col("rep"))
        else:
            state = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        ends = state.groupBy("s", "k").agg(F.min(F.struct("comp", "rep")).alias("lo"), F.max(F.struct("comp", "rep")).alias("hi"))
        open_ = pairs.join(ends.select("s", F.col("k").alias("x"), F.col("lo").alias("xl"), F.col("hi").alias("xh")), ["s", "x"]).join(ends.select("s", F.col("k").alias("y"), F.col("lo").alias("yl"), F.col("hi").alias("yh")), ["s", "y"])
        open_ = open_.filter("least(xl.comp, yl.comp) <> greatest(xh.comp, yh.comp)")
        lead = "l" if star % 2 == 0 else "h"
        if star < STARS:
            sides = open_.select("s", F.col(f"x{lead}").alias("lead"), F.col("y").alias("k")).unionByName(open_.select("s", F.col(f"y{lead}").alias("lead"), F.col("x").alias("k"))).distinct()
            found = sides.join(state, ["s", "k"]).filter("lead.comp <> comp").select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
        else:
            found = _of_groups(open_, state, groups, num, den)
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = stored(_verify(found, sets, num, den), "jaccard-links")
        if new.isEmpty() and comps is not None:
            continue
        links = new if links is None else links.unionByName(new)
        comps = components(links)
    # A component is named by the smallest (identifier, hash) of its sets.
    linked = stored(comps.withColumnRenamed("node", "rep").join(reps.select("rep", "id", "hash", "digest", "rows"), "rep"), "jaccard-linked")
    names = linked.groupBy("component").agg(F.min(F.struct("id", "hash")).alias("best"))
    of_set = linked.join(names, "component").select("digest", "rows", "best").unionByName(reps.join(linked.select("digest"), "digest", "left_anti").filter("rows > 1").select("digest", "rows", F.struct("id", "hash").alias("best")))
    of_set = stored(of_set.select("digest", "rows", F.col("best.id").alias("component"), F.col("best.hash").alias("first")), "jaccard-named")
    # Digests of over 1/HOT_SHARE of all rows meet theirs by broadcast: fewer than HOT_SHARE of them. Rows without a set meet nothing, and a set of one row that links with nothing is its own.
    limit = max(HOT_ROWS, rows.count() // HOT_SHARE)
    many = F.broadcast(of_set.filter(F.col("rows") > limit).select("digest", F.col("component").alias("hc"), F.col("first").alias("hf")))
    few = of_set.filter(F.col("rows") <= limit).drop("rows")
    lean = rows.select("id", "hash", "n", "digest")
    marked = lean.filter("digest is not null and id is not null").join(many, "digest", "left")
    hot = marked.filter("hc is not null").select("id", "hash", "n", F.col("hc").alias("component"), F.col("hf").alias("first"))
    rest = marked.filter("hc is null").select("id", "hash", "n", "digest").join(few, "digest", "left").select("id", "hash", "n", F.coalesce("component", "id").alias("component"), F.coalesce("first", "hash").alias("first"))
    alone = lean.filter("digest is null or id is null").select("id", "hash", "n", F.col("id").alias("component"), F.col("hash").alias("first"))
    return hot.unionByName(rest).unionByName(alone)


def _of_groups(open_: DataFrame, state: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets that may match and aren't in one component: pairs of groups first, filtered by what their prefixes and the rests behind them allow, then of their members."""
    spread = state.groupBy("s", "k", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    side = lambda k, z: spread.select("s", F.col("k").alias(k), *(F.col(c).alias(f"{z}_{c}") for c in ("g", "lo", "hi")))
    met = open_.select("s", "x", "y").join(side("x", "a"), ["s", "x"]).join(side("y", "b"), ["s", "y"]).filter("least(a_lo, b_lo) <> greatest(a_hi, b_hi)")
    couples = stored(met.select(F.least("a_g", "b_g").alias("ga"), F.greatest("a_g", "b_g").alias("gb")).distinct(), "jaccard-groups")
    told = lambda k, z: groups.select(F.col("g").alias(k), F.col("n").alias(f"{z}_n"), F.col("prefix").alias(f"{z}_prefix"))
    both = couples.join(told("ga", "a"), "ga").join(told("gb", "b"), "gb")
    rest = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    both = both.filter(F.size(F.array_intersect("a_prefix", "b_prefix")) + rest >= _needed(F.col("a_n"), F.col("b_n"), num, den)).select("ga", "gb")
    sets = state.select("g", "rep", "comp").distinct()
    one = lambda k, r, c: sets.select(F.col("g").alias(k), F.col("rep").alias(r), F.col("comp").alias(c))
    return both.join(one("ga", "a", "ca"), "ga").join(one("gb", "b", "cb"), "gb").filter("ca <> cb").select("a", "b")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row for each row of df: id_col (long), n_shingles long, component_id long.

    A-Z are lower-cased; words are runs of characters other than U+0020 and U+0009 to U+000D; a
    text's set holds its n-word shingles, with fewer words the whole sequence. Two rows link
    when overlap / union >= num / den. component_id is the smallest identifier reachable by
    links. A null or blank text has no shingle and links with nothing. A row with a null
    identifier links with nothing and has a null component. Repeated rows get equal answers;
    rows that share an identifier but not a text are each placed by their own text. An empty
    table gives an empty result. Other columns of df are ignored.
    """
    out = _classify(df, id_col, text, n, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """df with one document of each component, the one with the smallest identifier.

    If rows of a component share that identifier but not the text, the one with the smallest
    hash of text stays; repeated rows (equal identifier and text) share one verdict. Rows with a
    null identifier stay, those without words too. Columns may have any name.
    """
    told = _classify(df, id_col, text, n, num, den).filter("id <> component or hash <> first")
    gone = stored(told.select("id", "hash").distinct(), "jaccard-gone")
    gone = F.broadcast(gone) if ROW_BYTES * gone.count() <= BROADCAST_BYTES else gone
    return df.join(gone, (df[id_col].cast("long") == gone["id"]) & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == gone["hash"]), "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
