"""Exact nearest neighbours and similar pairs.

Both sides are dealt into blocks of about BLOCK rows by a hash; a cell is a pair of blocks. Rows
are sent to the cells of their block, and each cell compares its two blocks by matrix products
in one Arrow task of bounded memory: at most about 2 BLOCK rows and a score matrix of TILE
queries by BLOCK rows. The plan has one cogroup whatever the sizes; nothing of the data passes the
driver. Where only rows of one group meet, cells are made within groups: a group over BLOCK rows
gets blocks of its own, smaller ones share cells. A window merges the cells' best k.

Exact search compares all rows with all, so a row travels once to each block of the other side:
the shuffle grows with n² / BLOCK.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and of one in a small table, which is cut finer so that all cores work.
BLOCK, SMALL = 8192, 512
#: Queries whose scores are held at a time.
TILE = 256
#: Groups of columns for each neighbour asked for, and in all at least, whose maxima bound the k-th best score.
GROUPS, LEAST_GROUPS = 16, 256
#: Pairs of a row that single precision may leave in doubt, before its tile is compared in double.
SURE = 64
#: Rows that others are compared with at a time, where one that is near enough decides.
STEP = 1024
#: Tables of one row a large group are broadcast up to so many bytes, at so many a row.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def prepared(v: np.ndarray, metric: str) -> np.ndarray:
    """Rows as similarities() takes them: of unit length for the cosine, where a zero vector stays zero."""
    if metric == "cosine":
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    if metric == "euclidean":
        return v
    raise ValueError(f"metric: {metric!r}")


def similarities(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of prepared() rows of q by rows of x, larger is nearer: cosine or negative squared distance, not rounded. A zero vector has no cosine: -inf."""
    if metric == "euclidean":
        s = (2 * q) @ x.T
        s -= np.add.outer((q * q).sum(1), (x * x).sum(1))
        return s
    s = q @ x.T
    for zero, part in ((~q.any(axis=1), s), (~x.any(axis=1), s.T)):
        if zero.any():
            part[zero] = -np.inf
    if not (np.isfinite(q).all() and np.isfinite(x).all()):
        s[~np.isfinite(s)] = -np.inf
    return s


def settled(s: np.ndarray, metric: str) -> np.ndarray:
    """What scores() gives for similarities: cosine or negative distance of twelve digits."""
    return np.round(s, 12) if metric == "cosine" else -np.round(np.sqrt(np.maximum(-s, 0)), 12)


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: cosine similarity or negative Euclidean distance; rows of q by rows of x. A zero vector has no cosine."""
    return settled(similarities(prepared(q, metric), prepared(x, metric), metric), metric)


def vectors(df: DataFrame, id_col: str, vector: str, group: str | None = None, value: str | None = None) -> DataFrame:
    """(id, g, v, value) of the rows with a vector; a null group is a group."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    g = F.coalesce(F.col(group).cast("string"), F.lit("\0")) if group else F.lit("")
    return df.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), g.alias("g"), F.col(vector).cast(kind).alias("v"), *([F.col(value).alias("value")] if value else []))


def _blocks(n: Column | int, partitions: int) -> Column:
    """Blocks for n rows: of BLOCK rows, finer where that leaves cores idle."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.least(F.ceil(n / SMALL), F.lit(math.isqrt(partitions)))).cast("int")


def cells(left: DataFrame, right: DataFrame | None, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, grouped: bool = False) -> DataFrame:
    """work(rows of a left block, rows of a right block) of every cell; left and right from vectors().

    right None: pairs of left with itself, each pair of blocks once. grouped: only rows of the
    same g need to meet, though work may be given others. Empty sides give no cells.
    """
    spark, own = left.sparkSession, right is None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = left.agg(F.lit("l").alias("side"), F.count(F.lit(1)).alias("n"))
    sizes = dict(map(tuple, (sizes if own else sizes.unionByName(right.agg(F.lit("r").alias("side"), F.count(F.lit(1)).alias("n")))).collect()))
    many, total = sizes["l"], sizes.get("r", sizes["l"])
    if grouped:
        n = left.groupBy("g").agg(F.count(F.lit(1)).alias("nl"), F.lit(0).alias("nr"))
        n = n.withColumn("nr", F.col("nl")) if own else n.unionByName(right.groupBy("g").agg(F.lit(0).alias("nl"), F.count(F.lit(1)).alias("nr"))).groupBy("g").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
        # Large groups are at most (many + total) / BLOCK.
        large = n.filter(F.greatest("nl", "nr") > BLOCK).select(F.col("g").alias("lg"), *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("nl", "nr")))
        large = F.broadcast(large) if (many + total) // BLOCK * ROW_BYTES <= BROADCAST_BYTES else large
        shared = max(1, -(-max(many, total) // BLOCK), min(partitions, -(-max(many, total) // SMALL)))

        def counted(df: DataFrame) -> DataFrame:
            d = df.join(large, F.col("g") == F.col("lg"), "left")
            cell = F.when(F.col("lg").isNull(), F.pmod(F.xxhash64("g"), F.lit(shared))).otherwise(F.xxhash64("g"))
            return d.withColumns({"p": cell, "nl": F.greatest(F.coalesce("nl", F.lit(1)), F.lit(1)), "nr": F.greatest(F.coalesce("nr", F.lit(1)), F.lit(1))}).drop("lg")
    else:

        def counted(df: DataFrame) -> DataFrame:
            return df.withColumns({"p": F.lit(0).cast("long"), "nl": _blocks(many, partitions), "nr": _blocks(total, partitions)})

    at = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    a = counted(left).withColumn("i", at("nl"))
    a = a.withColumn("j", F.explode(F.sequence(F.col("i") if own else F.lit(0), F.col("nr") - 1))).drop("nl", "nr")
    b = counted(left if own else right).withColumn("j", at("nr"))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if own else F.col("nl") - 1))).drop("nl", "nr")
    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # columns of its own, where both sides are one table

    def meet(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if own and key[1].as_py() == key[2].as_py():
            return work(x, None)
        return work(x, y)

    return a.groupBy("p", "i", "j").cogroup(b.groupBy("p", "i", "j")).applyInArrow(meet, schema)


def _codes(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of both sides."""
    both = pa.chunked_array([*x.column("g").chunks, *y.column("g").chunks], pa.string()).combine_chunks().dictionary_encode()
    codes = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).indices.to_numpy(zero_copy_only=False)
    return codes[: x.num_rows], codes[x.num_rows :]


def shared_groups(x: pa.Table, y: pa.Table) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Row numbers of x and of y of each group that both have."""
    if x.num_rows and y.num_rows:
        a, b = _codes(x, y)
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        for code in np.intersect1d(a, b):
            yield tuple(pa.array(o[np.searchsorted(c, code, "left", o) : np.searchsorted(c, code, "right", o)]) for c, o in ((a, oa), (b, ob)))


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite scores of each row, ties by the columns' identifiers."""
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    else:
        row, col = np.nonzero(np.isfinite(s))
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def nearest_of(s: np.ndarray, ids: np.ndarray, k: int, metric: str, err: np.ndarray | float = 0.0, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, column, score) of best() of settled(s), of which only few are settled.

    Columns are dealt to groups. The k-th largest of the groups' maxima is at most the k-th
    largest of all, so what is below it by more than twelve digits tell goes unsorted. s may be off by
    err in each row; then exact(row, column) gives the similarities of those that aren't below by
    more than that. None, if they are over `most`.
    """
    n = s.shape[1]
    groups = max(min(n, k), min(n, max(LEAST_GROUPS, GROUPS * k)))
    if n <= k:
        row, col = np.nonzero(np.isfinite(s))
    else:
        body, tail = s[:, : n // groups * groups].reshape(len(s), -1, groups), n // groups * groups
        top = body.max(axis=1)
        least = np.partition(top, groups - k, axis=1)[:, groups - k].astype(np.float64)
        with np.errstate(invalid="ignore"):
            least = least - err  # the k-th best is at least this
            if metric == "euclidean":
                least = np.minimum(least, 0)
            slack = 1e-11 if metric == "cosine" else 4e-12 * np.sqrt(-least) - 1e-14 * least + 1e-22
            least = np.where(np.isfinite(least), least - slack - err, -np.inf)
        if s.dtype == np.float32:
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        at, group = np.nonzero(~(top < least[:, None]))  # only these groups hold any
        hit, place = np.nonzero(body[at, :, group] >= least[at, None])
        more, last = np.nonzero(s[:, tail:] >= least[:, None])
        row, col = np.concatenate([at[hit], more]), np.concatenate([place * groups + group[hit], last + tail])
    if exact is None:
        score = settled(s[row, col], metric)
    elif most is not None and len(row) > most:
        return None
    else:
        real = np.isfinite(s[row, col])
        row, col = row[real], col[real]
        score = settled(exact(row, col), metric)
    real = np.isfinite(score)
    row, col, score = row[real], col[real], score[real]
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], score[keep]


def _single(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray | None:
    """By how much similarities() of these rows in single precision may be off, for each row of q; None where that precision doesn't reach."""
    if metric == "cosine":
        reach = np.ones(len(q))
    else:
        with np.errstate(over="ignore", invalid="ignore"):
            reach = (np.linalg.norm(q, axis=1) + np.linalg.norm(x, axis=1).max(initial=0)) ** 2
        if not len(reach) or not (reach.min() > 1e-20 and reach.max() < 1e30):
            return None
    return (q.shape[1] + 16) * 2.0**-23 * reach


def nearest_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str, single: tuple | None, masked: Callable[[np.ndarray], None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest_of() for prepared() rows: all pairs in single precision, in double only those that may be among the k best. single: (q, x, err) or None; masked(s) sets what doesn't count to -inf."""
    if single is not None:
        s = similarities(single[0], single[1], metric)
        masked(s)

        def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
            if metric == "cosine":
                return np.einsum("ij,ij->i", q[row], x[col])
            d = q[row] - x[col]
            return -np.einsum("ij,ij->i", d, d)

        if (found := nearest_of(s, ids, k, metric, single[2], exact, len(q) * max(SURE, 8 * k))) is not None:
            return found
    s = similarities(q, x, metric)
    masked(s)
    return nearest_of(s, ids, k, metric)


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a, place in b) of equal identifiers."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b, a, "left", order), np.searchsorted(b, a, "right", order)
    row = np.repeat(np.arange(len(a)), hi - lo)
    return row, order[lo[row] + np.arange(len(row)) - np.searchsorted(row, row)]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_id: str = "vec_id", corpus_id: str = "vec_id", vector: str = "embedding", query_group: str | None = None, corpus_group: str | None = None, same: bool = True, exclude_self: bool = True, query_value: str | None = None, corpus_value: str | None = None) -> DataFrame:
    """(q, c, score, rank): the k nearest corpus rows of each query, nearest first, ties by identifier.

    score is the cosine similarity or the Euclidean distance. With groups, only corpus rows of
    the query's group count (same) or of other groups (not same). exclude_self leaves out the
    corpus row with the query's identifier. Null vectors are left out. query_value and
    corpus_value name columns that come along as q_value and c_value.
    """
    left, right = vectors(queries, query_id, vector, query_group, query_value), vectors(corpus, corpus_id, vector, corpus_group, corpus_value)
    by_group = bool(query_group or corpus_group)
    carried = [(side, frame.schema["value"].dataType.simpleString()) for side, frame, c in (("q_value", left, query_value), ("c_value", right, corpus_value)) if c]

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        codes = _codes(x, y) if by_group and x.num_rows and y.num_rows else None
        if codes is not None:  # in order of their groups, so that what doesn't count are slices
            orders = [np.argsort(c, kind="stable") for c in codes]
            codes, x, y = [c[o] for c, o in zip(codes, orders, strict=True)], x.take(pa.array(orders[0])), y.take(pa.array(orders[1]))
        qs, cs, rows, cols = x.column("id").to_numpy(), y.column("id").to_numpy(), [], []
        points, found = prepared(matrix(y.column("v")), metric), []
        v = prepared(matrix(x.column("v")), metric)
        off = _single(v, points, metric) if len(qs) and len(cs) else None
        light = (v.astype(np.float32), points.astype(np.float32)) if off is not None else None
        for i in range(0, len(qs) if len(cs) else 0, TILE):
            at = slice(i, i + TILE)

            def masked(s: np.ndarray, at: slice = at) -> None:
                if codes is not None:
                    for code in np.unique(codes[0][at]):
                        r, c = (slice(*np.searchsorted(z, [code, code + 1])) for z in (codes[0][at], codes[1]))
                        if same:
                            s[r, : c.start] = -np.inf
                            s[r, c.stop :] = -np.inf
                        else:
                            s[r, c] = -np.inf
                if exclude_self:
                    s[_equal(qs[at], cs)] = -np.inf

            row, col, score = nearest_rows(v[at], points, cs, k, metric, None if light is None else (light[0][at], light[1], off[at]), masked)
            found.append(score)
            rows.append(row + i)
            cols.append(col)
        row, col = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, cols))
        out = {"q": qs[row], "c": cs[col], "score": np.concatenate(found) if found else np.zeros(0)}
        out |= {name: (x if name == "q_value" else y).column("value").take(pa.array(row if name == "q_value" else col)) for name, _ in carried}
        return pa.table(out)

    schema = "q long, c long, score double" + "".join(f", {name} {kind}" for name, kind in carried)
    out = cells(left, right, work, schema, by_group and same)
    return ranked(out, k, metric)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """found (q, c, score, ...) with rank, the k best of each query; distances are positive."""
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "c"))).filter(F.col("rank") <= k)
    return out.withColumn("score", F.abs("score") if metric == "euclidean" else F.col("score"))


def similar_pairs(df: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", strict: bool = True, group: str | None = None) -> DataFrame:
    """(a, b, score), a < b: pairs (of a group) whose similarity is over the threshold (or reaches it); Euclidean: 1 - distance."""

    def work(x: pa.Table, y: pa.Table | None) -> pa.Table:
        other = x if y is None else y
        left, right, out = x.column("id").to_numpy(), other.column("id").to_numpy(), []
        v, points = prepared(matrix(x.column("v")), metric), prepared(matrix(other.column("v")), metric)
        codes = _codes(x, other) if group and len(left) and len(right) else None
        for i in range(0, len(left) if len(right) else 0, TILE):
            s = similarities(v[i : i + TILE], points, metric)
            s = settled(s, metric) if metric == "cosine" else 1 + settled(s, metric)
            hit = s > threshold if strict else s >= threshold
            if codes is not None:
                hit &= codes[0][i : i + TILE, None] == codes[1][None, :]
            ids = left[i : i + TILE]
            hit &= ids[:, None] < right[None, :] if y is None else ids[:, None] != right[None, :]
            r, c = np.nonzero(hit)
            out.append((np.minimum(ids[r], right[c]), np.maximum(ids[r], right[c]), s[r, c]))
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "score": s})

    return cells(vectors(df, id_col, vector, group), None, work, "a long, b long, score double", bool(group))


def _over(s: np.ndarray, threshold: float, metric: str, strict: bool) -> np.ndarray:
    s = settled(s, metric) if metric == "cosine" else 1 + settled(s, metric)
    return s > threshold if strict else s >= threshold


def _meetings(x: pa.Table, y: pa.Table, same: bool | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) that meet: those of one g (same), of different ones (not same) or all with all."""
    if not x.num_rows or not y.num_rows:
        return
    if same is None:
        yield np.arange(x.num_rows), np.arange(y.num_rows)
        return
    a, b = _codes(x, y)
    for code in np.unique(a):
        yield np.flatnonzero(a == code), np.flatnonzero((b == code) == same)


def similar_to(rows: DataFrame, others: DataFrame, threshold: float, metric: str = "cosine", strict: bool = True, same: bool | None = None) -> DataFrame:
    """(id) of those rows that are over the threshold (or reach it) with any of others; both from vectors(). same: only others with (True) or without (False) the row's g."""

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, hit = x.column("id").to_numpy(), np.zeros(x.num_rows, bool)
        v, points = prepared(matrix(x.column("v")), metric), prepared(matrix(y.column("v")), metric)
        for at, to in _meetings(x, y, same):
            others = points if len(to) == len(points) else points[to]
            for i in range(0, len(at), TILE):
                open_ = at[i : i + TILE]
                for j in range(0, len(to), STEP):  # a row that is hit meets no more
                    over = _over(similarities(v[open_], others[j : j + STEP], metric).max(axis=1), threshold, metric, strict)
                    hit[open_[over]] = True
                    open_ = open_[~over]
                    if not len(open_):
                        break
        return pa.table({"id": ids[hit]})

    return cells(rows, others, work, "id long", bool(same)).distinct()


def kept_in_order(t: pa.Table, threshold: float, metric: str, strict: bool, same: bool | None) -> np.ndarray:
    """Which rows of t (id, g, v), in ascending order of id, are kept: those without a kept row before them over the threshold. The rows' places in t, in that order."""
    order = np.argsort(t.column("id").to_numpy(), kind="stable")
    v, codes = prepared(matrix(t.column("v")), metric)[order], _codes(t, t)[0][order]
    kept = np.zeros(0, np.int64)

    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = similarities(v[a], v[b], metric)
        if same is not None:
            s[(codes[a][:, None] == codes[b][None, :]) != same] = -np.inf
        return s

    for i in range(0, len(order), TILE):
        tile = np.arange(i, min(i + TILE, len(order)))
        if len(kept):
            tile = tile[~_over(meet(tile, kept).max(axis=1), threshold, metric, strict)]
        near, open_ = _over(meet(tile, tile), threshold, metric, strict), np.ones(len(tile), bool)
        for j in range(len(tile)):
            if open_[j]:
                open_[j + 1 :] &= ~near[j, j + 1 :]
        kept = np.concatenate([kept, tile[open_]])
    return order[kept]


def mean_distance(df: DataFrame, k: int, metric: str = "euclidean", id_col: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(id_col, mean_distance): mean distance of each row to its k nearest others (of its group)."""
    found = nearest(df, df, k, metric, id_col, id_col, vector, group, group)
    distance = F.col("score") if metric == "euclidean" else 1 - F.col("score")
    return found.groupBy(F.col("q").alias(id_col)).agg(F.avg(distance).alias("mean_distance"))


def purity(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", label: str = "label", exclude_self: bool = True) -> DataFrame:
    """(id_col, label, purity): share of a query's k nearest corpus rows that have its label. Labels travel with the vectors."""
    found = nearest(queries, corpus, k, metric, id_col, id_col, vector, exclude_self=exclude_self, query_value=label, corpus_value=label)
    return found.groupBy(F.col("q").alias(id_col), F.col("q_value").alias(label)).agg(F.avg((F.col("q_value") == F.col("c_value")).cast("double")).alias("purity"))


def distance_sums(df: DataFrame, id_col: str, vector: str, group: str) -> DataFrame:
    """(id, g, other, total): sum of Euclidean distances of each row to the rows of each group. Two blocks meet once, for both sides."""

    def sorted_by_group(t: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
        """(identifiers, groups, vectors, names of the groups, their first rows), in the order of the groups."""
        names = t.column("g").combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        g = t.column("g").combine_chunks().take(pa.array(order))
        return t.column("id").to_numpy()[order], g, matrix(t.column("v"))[order], names.dictionary, np.searchsorted(codes[order], np.arange(len(names.dictionary)))

    def told(ids: np.ndarray, g: pa.Array, names: pa.Array, total: np.ndarray) -> pa.Table:
        n, m = total.shape
        return pa.table({"id": np.repeat(ids, m), "g": g.take(pa.array(np.repeat(np.arange(n), m))), "other": names.take(pa.array(np.tile(np.arange(m), n))), "total": total.reshape(-1)})

    def work(x: pa.Table, y: pa.Table | None) -> pa.Table:
        if not x.num_rows or (y is not None and not y.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "g": pa.array([], pa.string()), "other": pa.array([], pa.string()), "total": pa.array([], pa.float64())})
        ids, g, v, names, first = sorted_by_group(x)
        ids_y, g_y, points, names_y, first_y = (ids, g, v, names, first) if y is None else sorted_by_group(y)
        rows, columns = np.zeros((len(ids), len(first_y))), np.zeros((len(first), len(ids_y)))
        ends = np.append(first[1:], len(ids))
        for i in range(0, len(ids), TILE):
            d = similarities(v[i : i + TILE], points, "euclidean")
            np.sqrt(np.maximum(np.negative(d, out=d), 0, out=d), out=d)
            rows[i : i + TILE] = np.add.reduceat(d, first_y, axis=1)
            for c in np.flatnonzero((first < i + TILE) & (ends > i)) if y is not None else ():
                columns[c] += d[max(0, first[c] - i) : ends[c] - i].sum(axis=0)
        out = told(ids, g, names_y, rows)
        return out if y is None else pa.concat_tables([out, told(ids_y, g_y, names, columns.T)])

    return cells(vectors(df, id_col, vector, group), None, work, "id long, g string, other string, total double").groupBy("id", "g", "other").agg(F.sum("total").alias("total"))


def pair_distances(df: DataFrame, vector: str, group: str, id_col: str) -> DataFrame:
    """(g, total, n): sum of the Euclidean distances of the pairs of each group, and their number."""

    def work(x: pa.Table, y: pa.Table | None) -> pa.Table:
        other, sums = x if y is None else y, {}
        xs = x.column("g").combine_chunks()
        v, points, left, right = matrix(x.column("v")), matrix(other.column("v")), x.column("id").to_numpy(), other.column("id").to_numpy()
        a, b = _codes(x, other) if len(left) and len(right) else (np.zeros(0), np.zeros(0))
        for code in np.intersect1d(a, b):
            at, to = np.flatnonzero(a == code), np.flatnonzero(b == code)
            t, n = sums.get(xs[int(at[0])].as_py(), (0.0, 0))
            for i in range(0, len(at), TILE):
                d = -scores(v[at[i : i + TILE]], points[to], "euclidean")
                hit = left[at[i : i + TILE], None] < right[None, to] if y is None else left[at[i : i + TILE], None] != right[None, to]
                t, n = t + float(d[hit].sum()), n + int(hit.sum())
            sums[xs[int(at[0])].as_py()] = (t, n)
        return pa.table({"g": pa.array(list(sums), pa.string()), "total": pa.array([s[0] for s in sums.values()], pa.float64()), "n": pa.array([s[1] for s in sums.values()], pa.int64())})

    return cells(vectors(df, id_col, vector, group), None, work, "g string, total double, n long", True).groupBy("g").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def moments(df: DataFrame, vector: str, group: str) -> DataFrame:
    """(g, m): the sum of (1, u)(1, u)ᵀ over the unit vectors u of each group, flattened. Summed in each task first, then by component: linear in the rows. Zero vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            v, names = matrix(b.column("v")), b.column("g").dictionary_encode()
            size = np.linalg.norm(v, axis=1)
            u = np.concatenate([np.ones((len(v), 1)), v / np.where(size > 0, size, 1)[:, None]], axis=1)
            codes = names.indices.to_numpy(zero_copy_only=False)
            for c, name in enumerate(names.dictionary.to_pylist()):
                x = u[(codes == c) & (size > 0)]
                sums[name] = sums.get(name, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([m.reshape(-1) for m in sums.values()], pa.list_(pa.float64()))], names=["g", "m"])

    each = df.filter(F.col(vector).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    parts = each.mapInArrow(run, "g string, m array<double>").select("g", F.posexplode("m").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    return parts.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))


def cosine_spread(df: DataFrame, classes: DataFrame, id_col: str, vector: str, group: str) -> DataFrame:
    """(id, mean, deviation) of the cosine similarities of each row to the rows of its group in classes, from the group's moments()."""
    left = vectors(df, id_col, vector, group)
    right = moments(classes, vector, group).select(F.lit(0).cast("long").alias("id"), "g", F.col("m").alias("v"))

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, mean, spread, at = x.column("id").to_numpy(), [], [], []
        v = matrix(x.column("v"))
        if len(ids) and y.num_rows:
            size = np.linalg.norm(v, axis=1, keepdims=True)
            u = np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)
            a, b = _codes(x, y)
            for code, m in zip(b, matrix(y.column("v")).reshape(y.num_rows, v.shape[1] + 1, -1), strict=True):
                who = np.flatnonzero(a == code)
                m = m / m[0, 0] if m[0, 0] else m * np.nan
                first = u[who] @ m[0, 1:]
                second = np.einsum("ij,jk,ik->i", u[who], m[1:, 1:], u[who])
                at.append(ids[who])
                mean.append(first)
                spread.append(np.sqrt(np.maximum(second - first * first, 0)))
        cat = lambda z, kind: np.concatenate(z) if z else np.zeros(0, kind)
        return pa.table({"id": cat(at, np.int64), "mean": cat(mean, float), "deviation": cat(spread, float)})

    return cells(left, right, work, "id long, mean double, deviation double", True)
