"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words. Each window has a minimiser, the smallest hash of its
runs of `mer` words; consecutive windows that share it travel as one packed string of words
to the bucket of that hash. Equal windows have equal minimisers, so each bucket alone finds,
by sorting its windows, every window that also starts earlier. The words that later windows
cover are then removed from the texts.

Shuffled: about (window + run - 1) / run words per window, run near (window - mer + 2) / 2,
compressed, then the texts once. Strings that repeat inside one map partition are resolved
there (only the earliest travels), so a passage in a third of all documents sends one row a
partition to its bucket. Buckets are as many as the total size asks for. Their sizes are counted
in a first pass; a bucket over HOT times the size meant for one (a phrase of low hash in
very many different texts) is split: its strings travel as windows, by two independent 64-bit
hashes of their words, to as many parts as its size asks for, chosen by that hash. Equal windows have
equal hashes, so each part alone is exact too, and of equal windows in a map partition only
the earliest travels. So a worker holds at most about HOT BUCKET_BYTES of strings, or as
much of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, stored, table
from .wordhash import BASES, Words, buffers, mix, ngrams, pieces, powers, ranges, release

WINDOW, MER = 20, 4
#: Packed bytes that a bucket is meant for, that a mapper gathers before it sends, and text bytes that it works on at a time.
BUCKET_BYTES, PACK_BYTES, PIECE_BYTES = 8 << 20, 24 << 20, 1 << 20
LEVEL = 5
#: A bucket of over so many times BUCKET_BYTES is split. The list of such buckets is sent to all tasks; if it were over LIST_BYTES, at 16 a bucket, twice as many times would count.
HOT, LIST_BYTES = 3, 32 << 20
_INVERSE = pow(BASES[0], -1, 1 << 64)
NO_ID = np.iinfo(np.int64).min


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    raw = b"".join(x for a in columns.values() for x in (np.int64(len(a)).tobytes(), np.ascontiguousarray(a).tobytes()))
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


_PACKED = {"doc": np.int64, "row": np.int64, "start": np.int32, "words": np.int32, "bytes": np.int32, "text": np.uint8}
_WINDOWS = {"doc": np.int64, "row": np.int64, "start": np.int32, "one": np.uint64, "two": np.uint64}
_COVER = {"doc": np.int64, "row": np.int64, "start": np.int32, "words": np.int32}


def _unpack(blob: bytes, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    raw, at, out = pa.Codec("zstd").decompress(pa.py_buffer(blob)[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True), 0, {}
    for k, t in kinds.items():
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out[k] = np.frombuffer(raw, t, n, at + 8)
        at += 8 + n * np.dtype(t).itemsize
    return out


def super_kmers(h: np.ndarray, doc: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of consecutive windows."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = ngrams(h, mer)
    for width, reach in _spans(window - mer + 1):
        low = np.minimum(low[: len(low) - width], low[width:]) if reach else low
    whole = doc[:n] == doc[window - 1 :]
    new = whole.copy()
    new[1:] &= ~(whole[:-1] & (low[1:] == low[:-1]) & (doc[1:n] == doc[: n - 1]))
    first = np.flatnonzero(new)
    count = np.add.reduceat(whole.astype(np.int64), first) if len(first) else first
    return first, count, low[first]


def _spans(n: int) -> Iterator[tuple[int, bool]]:
    """Shifts that turn elementwise minima into minima over n neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        yield step, True
        have += step


class Hot:
    """Buckets that are split, ascending, and the number of parts of each; a part is a bucket by itself, numbered after all others."""

    def __init__(self, buckets: int, which: np.ndarray, parts: np.ndarray):
        self.buckets, self.which, self.parts = buckets, which, parts
        self.first = buckets + np.cumsum(parts) - parts

    def among(self, bucket: np.ndarray) -> np.ndarray:
        if not len(self.which):
            return np.zeros(len(bucket), bool)
        return self.which[np.minimum(np.searchsorted(self.which, bucket), len(self.which) - 1)] == bucket

    def part(self, bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.which, bucket)
        return self.first[at] + (mix(h) % self.parts[at].astype(np.uint64)).astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch], window: int, mer: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Bytes of strings for each bucket."""
    total: dict[int, int] = {}
    for b in pieces(batches, 0, PIECE_BYTES):
        words = Words(*buffers(b.column(0)))
        first, count, low = super_kmers(words.hashes(), words.doc, window, mer)
        if len(first):
            at, back = np.unique((mix(low) % np.uint64(buckets)).astype(np.int64), return_inverse=True)
            size = np.bincount(back, weights=words.ends[first + count + window - 2] - words.starts[first])
            for k, v in zip(at.tolist(), size.tolist(), strict=True):
                total[k] = total.get(k, 0) + int(v)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bucket", "bytes"])


def hot_buckets(docs: DataFrame, window: int, mer: int, buckets: int, bucket_bytes: int) -> Hot:
    sizes = stored(docs.select("text").mapInArrow(lambda it: _sizes(it, window, mer, buckets), "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes")), "substring-sizes")
    most = HOT * bucket_bytes
    while 16 * sizes.filter(F.col("bytes") > most).count() > LIST_BYTES:
        most *= 2
    found = sorted((r.bucket, r.bytes) for r in sizes.filter(F.col("bytes") > most).collect())
    return Hot(buckets, np.array([k for k, _ in found], np.int64), np.array([-(-v // bucket_bytes) for _, v in found], np.int64))


def _strings(b: pa.RecordBatch, window: int, mer: int, hot: Hot) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None:
    """Of a batch (identifier, row, text): the super-k-mers with their bucket, two keys and packed words, and the windows of those in buckets that are split."""
    ids = b.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = buffers(b.column(2))
    words = Words(data, offsets)
    first, count, low = super_kmers(h := words.hashes(), words.doc, window, mer)
    if not len(first):
        return None
    begin = np.searchsorted(words.doc, np.arange(len(ids)), side="left")
    bucket = (mix(low) % np.uint64(hot.buckets)).astype(np.int64)
    second = words.hashes(1)
    split = hot.among(bucket)
    at = ranges(first[split], count[split])
    one, two = (ngrams(x, window)[at] if len(at) else np.zeros(0, np.uint64) for x in (h, second))
    of = words.doc[at]
    singles = {"doc": ids[of], "row": rows[of], "start": (at - begin[of]).astype(np.int32), "bucket": hot.part(np.repeat(bucket[split], count[split]), one), "one": one, "two": two}
    first, count, bucket = first[~split], count[~split], bucket[~split]
    length = count + window - 1
    doc = words.doc[first]
    left, size = words.starts[first], words.ends[first + length - 1] - words.starts[first]
    out = {"doc": ids[doc], "row": rows[doc], "start": (first - begin[doc]).astype(np.int32), "words": length.astype(np.int32), "bytes": size.astype(np.int32), "bucket": bucket}
    up, down = powers(BASES[0], len(h) + 1), powers(_INVERSE, len(h) + 1)
    for k, x in (("one", h), ("two", second)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:-1], dtype=np.uint64)])
        out[k] = mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))
    return out | {"text": data[ranges(left, size)]}, singles


def _map(batches: Iterator[pa.RecordBatch], window: int, mer: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    held: list[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]] = []
    size = 0
    for b in pieces(batches, 2, PIECE_BYTES):
        if (x := _strings(b, window, mer, hot)) is not None:
            held.append(x)
            size += len(x[0]["text"]) + 44 * len(x[1]["doc"])
        if size >= PACK_BYTES:
            yield from _by_bucket(held, window)
            size = 0
    yield from _by_bucket(held, window)


def _earliest(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first of those with equal keys (one, two), and rows that repeat an earlier one elsewhere; both ascending."""
    doc, row, start = x["doc"], x["row"], x["start"]
    later = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & ((row[1:] > row[:-1]) | (row[1:] == row[:-1]) & (start[1:] >= start[:-1]))
    by = None if later.all() else np.lexsort((start, row, doc))
    one, two, doc, row, start = (v if by is None else v[by] for v in (x["one"], x["two"], doc, row, start))
    order = np.argsort(one)
    head = np.ones(len(order), bool)
    head[1:] = one[order[1:]] != one[order[:-1]]
    first = np.minimum.reduceat(order, np.flatnonzero(head)) if len(order) else order
    lead = first[np.cumsum(head) - 1]
    if not (two[order] == two[lead]).all():  # equal by the first key alone
        order = np.lexsort((two, one))
        head[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        first = np.minimum.reduceat(order, np.flatnonzero(head))
        lead = first[np.cumsum(head) - 1]
    same = (doc[order] == doc[lead]) & (row[order] == row[lead]) & (start[order] == start[lead])
    again = order[~same]
    return (np.sort(first), np.sort(again)) if by is None else (np.sort(by[first]), np.sort(by[again]))


def _stretches(x: dict[str, np.ndarray], who: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The stretches of words that these windows cover, neighbours as one."""
    who = who[np.lexsort((x["start"][who], x["row"][who], x["doc"][who]))]
    doc, row, start = (x[k][who] for k in ("doc", "row", "start"))
    cut = np.ones(len(who), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(cut)
    last = np.append(head[1:], len(who))[: len(head)] - 1
    return {"doc": doc[head], "row": row[head], "start": start[head], "words": (start[last] - start[head] + window).astype(np.int32)}


def _by_bucket(held: list[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]], window: int) -> Iterator[pa.RecordBatch]:
    """A row of packed strings or windows for each bucket. Of equal ones only the earliest travels; what the others cover is settled here."""
    if not held:
        return
    x, singles = ({k: np.concatenate([p[i][k] for p in held]) for k in held[0][i]} for i in (0, 1))
    held.clear()
    at = np.cumsum(x["bytes"].astype(np.int64)) - x["bytes"]
    out = []
    for y, text in ((x, True), (singles, False)):
        sent, settled = _earliest(y)
        sent = sent[np.argsort(y["bucket"][sent], kind="stable")]
        cuts = np.flatnonzero(np.diff(y["bucket"][sent], prepend=-1, append=-1))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            who = sent[i:j]
            parts = {k: y[k][who] for k in (_PACKED if text else _WINDOWS) if k != "text"}
            parts |= {"text": x["text"][ranges(at[who], x["bytes"][who].astype(np.int64))]} if text else {}
            out.append((int(y["bucket"][who[0]]), _pack(parts), text, None))
        if len(settled):
            out.append((int(y["bucket"][settled[0]]), None, None, _pack({k: y[k][settled] for k in _COVER} if text else _stretches(y, settled, window))))
    kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "packed", "strings", "cover"])


def later_windows(parts: list[dict[str, np.ndarray]], window: int) -> dict[str, np.ndarray]:
    """Of packed strings: the stretches of words that windows cover which also start earlier."""
    x = {k: np.concatenate([p[k] for p in parts]) for k in _PACKED}
    at = np.cumsum(x["bytes"].astype(np.int64)) - x["bytes"]
    order = np.lexsort((x["start"], x["row"], x["doc"]))
    size = x["bytes"][order].astype(np.int64)
    data = x["text"][ranges(at[order], size)]
    doc, row, start = (x[k][order] for k in ("doc", "row", "start"))
    words = Words(data, np.concatenate([[0], np.cumsum(size)]))
    n = len(words) - window + 1
    at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    run = words.doc[at]
    first_word = np.searchsorted(words.doc, np.arange(len(size)), side="left")
    one, two = (ngrams(words.hashes(w), window)[at] for w in (0, 1))
    return again({"doc": doc[run], "row": row[run], "start": (start[run] + (at - first_word[run])).astype(np.int32), "one": one, "two": two}, window)


def again(x: dict[str, np.ndarray], window: int) -> dict[str, np.ndarray]:
    """The stretches that windows (doc, row, start, one, two) cover which also start earlier."""
    return _stretches(x, _earliest(x)[1], window)


def _reduce(group: pa.Table, window: int) -> pa.Table:
    packed = [(_unpack(x, _PACKED if s else _WINDOWS), s) for x, s in zip(group.column("packed").to_pylist(), group.column("strings").to_pylist(), strict=True) if x is not None]
    covers = [_unpack(x, _COVER) for x in group.column("cover").to_pylist() if x is not None]
    if strings := [x for x, s in packed if s]:
        covers.append(later_windows(strings, window))
    if singles := [x for x, s in packed if not s]:
        covers.append(again({k: np.concatenate([x[k] for x in singles]) for k in _WINDOWS}, window))
    x = {k: np.concatenate([c[k] for c in covers]) for k in _COVER}
    ids = pa.array(x["doc"], mask=x["doc"] == NO_ID)
    release()
    return pa.table([ids, *(pa.array(x[k]) for k in ("row", "start", "words"))], names=["doc", "row", "start", "words"])


def merged(covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint [start, end) stretches that cover the same words, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(covers):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, mer: int = MER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each row of df: id_col (long), n_words, n_removed long, kept_text string.

    Words are maximal runs of characters other than U+0020 and U+0009 to U+000D. A word goes
    if a window covers it that also starts earlier: at a smaller identifier, or earlier in the
    same document. Null identifiers come before all others. A null, empty or short text loses
    nothing; kept_text is never null. Rows with equal identifier and text are one document
    (none repeats the other, all get the same answer); rows that share only the identifier are
    ordered by a hash of the text. An empty table gives an empty result. Other columns of df
    are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, 3 * size // bucket_bytes)
    hot = hot_buckets(docs, window, mer, buckets, bucket_bytes)
    packed = docs.mapInArrow(lambda it: _map(it, window, mer, hot), "bucket long, packed binary, strings boolean, cover binary")
    tasks = max(shuffle_partitions(spark), min(buckets, 3 * size // (64 << 20)))
    covers = packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda g: _reduce(g, window), "doc long, row long, start int, words int")
    spans = covers.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    spans = stored(spans.withColumnsRenamed({"doc": "d", "row": "r"}), "substring-spans")
    joined = docs.join(spans, docs["doc"].eqNullSafe(spans["d"]) & (docs["row"] == spans["r"]), "left").select("doc", "text", "spans.start", "spans.words")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            total, gone, kept = [], [], []
            for t, starts, lengths in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = t.encode().split()
                total.append(len(words))
                for s, e in reversed(merged([(s, s + n) for s, n in zip(starts or (), lengths or (), strict=True)])):
                    del words[s:e]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "doc long, n_words long, n_removed long, kept_text string").withColumnRenamed("doc", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
