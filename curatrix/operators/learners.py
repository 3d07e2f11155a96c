"""Learners that Spark ML lacks: kernel features, softmax boosting on histograms, a network with rectified units and dropout; and the sums by which Spark ML's own network and support vectors are trained on whole blocks of rows.

Rows stay in a stored table; tasks send sums (histograms, gradients), the driver holds trees and weights.
Sums of many tasks are added up in groups of FAN first. A table of at most `one_task` rows runs the
same rounds within one task, which saves a job for each.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.neighbors import matrix
from curatrix.sources.storage import discard, source_of, stored

#: Rows that one task may hold, and partial sums added up at a time.
ONE_TASK, FAN = 20_000, 32
#: Rows of a boosting task.
LOT = 32_768
#: Rows of a batch that meet the weights in one group.
PART = 8192
#: Rows of a packed block, rows that are worth a task of their own, and rows of a task at most.
BLOCK, LITTLE, MUCH = 2048, 256, 65_536


class _Model(Transformer):
    """Adds probability and prediction to a column of vectors, batch by batch."""

    def __init__(self, score: Callable[[np.ndarray], np.ndarray], inputs: str):
        super().__init__()
        self.score, self.inputs = score, inputs

    def _transform(self, df: DataFrame) -> DataFrame:
        score = self.score

        @F.pandas_udf("array<double>")
        def proba(v: pd.Series) -> pd.Series:
            return pd.Series(list(score(np.stack(v.to_list()))) if len(v) else [], dtype=object)

        best = F.array_position("__p", F.array_max("__p")) - 1
        return df.withColumn("__p", proba(vector_to_array(self.inputs))).withColumns({"probability": array_to_vector("__p"), "prediction": best.cast("double")}).drop("__p")


class Fourier(Transformer):
    """Random Fourier features: inner products of `width` cosines of seeded projections come near the kernel exp(-gamma |x - y|²)."""

    def __init__(self, dimensions: int, width: int, gamma: float, inputs: str, outputs: str, seed: int = 42):
        super().__init__()
        rng = np.random.default_rng(seed)
        self.frequencies, self.phases = rng.normal(0, np.sqrt(2 * gamma), (dimensions, width)), rng.uniform(0, 2 * np.pi, width)
        self.inputs, self.outputs = inputs, outputs

    def of(self, x: np.ndarray) -> np.ndarray:
        """The features of rows: make them of a block at a time, they are wide."""
        z = x @ self.frequencies
        z += self.phases
        return np.multiply(np.cos(z, out=z), np.sqrt(2 / len(self.phases)), out=z)

    def _transform(self, df: DataFrame) -> DataFrame:
        of = self.of

        @F.pandas_udf("array<double>")
        def features(v: pd.Series) -> pd.Series:
            return pd.Series(list(of(np.stack(v.to_list()))) if len(v) else [], dtype=object)

        return df.withColumn(self.outputs, array_to_vector(features(vector_to_array(self.inputs))))


def added(parts: DataFrame, key: bool = False) -> DataFrame:
    """(part, x) or (key, part, x) with the x of each FAN consecutive parts added up, until there are at most FAN parts."""
    kind = ("key long, " if key else "") + "part long, x array<double>"

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        x = np.sum([np.asarray(v.values) for v in t.column("x")], axis=0)
        head = {"key": [t.column("key")[0].as_py()]} if key else {}
        return pa.table(head | {"part": [t.column("part")[0].as_py() // FAN], "x": pa.array([x], pa.list_(pa.float64()))})

    while (parts.agg(F.max("part")).first()[0] or 0) >= FAN:
        parts = stored(parts.groupBy(*(["key"] if key else []), F.floor(F.col("part") / FAN).alias("at")).applyInArrow(add, kind), "sums")
    return parts


def _one_task(rows: DataFrame, work: Callable[[pa.Table], object]) -> object:
    """What work makes of a small table in one task."""
    out = rows.withColumn("__g", F.lit(0)).groupBy("__g").applyInArrow(lambda t: pa.table({"m": pa.array([pickle.dumps(work(t))], pa.binary())}), "m binary")
    return pickle.loads(out.first().m)


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Tree:
    """Nodes by place: feature (-1: leaf), bin (rows of a greater one go right), left child (right: + 1), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, b: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left = map(np.array, (self.feature, self.bin, self.left))
        at = np.zeros(len(b), np.int64)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            at[i] = left[at[i]] + (b[i, feature[at[i]]] > cut[at[i]])
        return at

    def scores(self, b: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(b)]


def split(hist: np.ndarray, reg: float, least: float) -> tuple[float, int, int, float, float, float, float]:
    """(gain, feature, bin, G and H of both sides) of the best cut of a node: hist is (2, features, bins) sums of gradients and hessians. Ties: the first feature, then bin."""
    g, h = hist.cumsum(axis=2)
    total_g, total_h = g[0, -1], h[0, -1]
    gl, hl = g[:, :-1], h[:, :-1]
    gr, hr = total_g - gl, total_h - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + reg) + gr**2 / (hr + reg) - total_g**2 / (total_h + reg), -np.inf)
    gain = np.round(gain, 9)  # sums added in another order cut the same
    at = int(gain.argmax())
    j, k = divmod(at, gain.shape[1])
    return float(gain[j, k]), j, k, float(gl[j, k]), float(hl[j, k]), float(gr[j, k]), float(hr[j, k])


@dataclass(frozen=True)
class Boosted:
    """edges: cuts of each feature; prior: log shares of the classes; trees: one a class in each round; losses before each round."""

    edges: list[np.ndarray]
    prior: np.ndarray
    trees: list[list[Tree]]
    losses: list[float]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.prior + _scores(self.trees, self.bins(x), len(self.prior)))


def _scores(trees: list[list[Tree]], b: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(b), classes))
    for round_ in trees:
        for k, tree in enumerate(round_):
            out[:, k] += tree.scores(b)
    return out


def histograms(b: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, trees: list[Tree], open_: dict[tuple[int, int], int], bins: int) -> tuple[np.ndarray, float]:
    """(sums by (open node, 2, feature, bin), log loss) of rows: bins b, classes y, weights w, scores f. open_: (class, node) -> place."""
    p = softmax(f)
    loss = float(-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))).sum())
    out = np.zeros((len(open_), 2, b.shape[1], bins))
    for k, tree in enumerate(trees):
        place = np.full(len(tree.feature), -1)
        for (c, node), at in open_.items():
            if c == k:
                place[node] = at
        if (place < 0).all():
            continue
        at = place[tree.nodes(b)]
        rows = np.flatnonzero(at >= 0)
        gh = w[rows] * (p[rows, k] - (y[rows] == k)), w[rows] * p[rows, k] * (1 - p[rows, k])
        for j in range(b.shape[1]):
            key = at[rows] * bins + b[rows, j]
            for s in (0, 1):
                out[:, s, j] += np.bincount(key, gh[s], minlength=len(open_) * bins).reshape(-1, bins)
    return out, loss


def boosting_rounds(sums: Callable[[list[list[Tree]], list[Tree], dict], tuple[dict[int, tuple], float]], classes: int, rounds: int, depth: int, rate: float, reg: float, done: Callable[[list[list[Tree]]], None] = lambda trees: None) -> tuple[list[list[Tree]], list[float]]:
    """Trees of all rounds. sums(trees so far, trees of this round, open nodes) gives the best split of each open node's place and the loss."""
    trees: list[list[Tree]] = []
    losses: list[float] = []
    for _ in range(rounds):
        new = [Tree() for _ in range(classes)]
        open_ = {(k, 0): k for k in range(classes)}
        for level in range(depth):
            best, loss = sums(trees, new, open_)
            if level == 0:
                losses.append(loss)
            following: list[tuple[int, int]] = []
            for (k, node), at in open_.items():
                if at not in best or best[at][0] <= 1e-9:
                    continue
                _, j, cut, gl, hl, gr, hr = best[at]
                t = new[k]
                t.feature[node], t.bin[node], t.left[node] = j, cut, len(t.feature)
                for g, h in ((gl, hl), (gr, hr)):
                    t.feature.append(-1)
                    t.bin.append(0)
                    t.left.append(-1)
                    t.value.append(-rate * g / (h + reg))
                    following.append((k, len(t.feature) - 1))
            open_ = {x: i for i, x in enumerate(following)}
            if not open_:
                break
        trees.append(new)
        done(trees)
    return trees, losses


def boost(df: DataFrame, rounds: int = 100, depth: int = 5, rate: float = 0.1, bins: int = 64, reg: float = 1.0, least: float = 1e-3, keep: int = 10, one_task: int = ONE_TASK) -> Boosted:
    """Softmax boosting of df (x array<double>, y int, w double): in each round a tree for each class.

    Features are cut into at most `bins` (up to 256) bins at approximate quantiles of all rows, from a mergeable
    sketch. A level of a round's trees is one pass: tasks sum gradients p - y and hessians p (1 - p)
    by open node, feature and bin, the sums are added up, and each node's best cut is found
    in its own group; only cuts reach the driver. Scores of rows are stored anew every `keep` rounds, later
    trees are applied on the way.
    """
    data = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").cast("array<double>"), F.col("y").cast("int"), F.col("w").cast("double"))
    one = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max(F.size("x")).alias("d")).collect()  # one row a class
    if not one:
        raise ValueError("no rows to learn from")
    classes, d, n = max(r.y for r in one) + 1, max(r.d for r in one), sum(r.n for r in one)
    share = np.array([sum(r.w for r in one if r.y == k) for k in range(classes)]) / sum(r.w for r in one)
    cuts = data.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 10_000).alias("q")).collect()
    edges = [np.zeros(0)] * d
    for r in cuts:
        edges[r.i] = np.unique(np.array(r.q))
    prior = np.log(np.maximum(share, 1e-15))
    model = Boosted(edges, prior, [], [])

    def best_of(hist: np.ndarray) -> dict[int, tuple]:
        return {i: split(x, reg, least) for i, x in enumerate(hist)}

    if n <= one_task:

        def whole(t: pa.Table) -> tuple:
            t = t.combine_chunks()
            b, y, w = model.bins(matrix(t.column("x"))), t.column("y").to_numpy(), t.column("w").to_numpy()
            f, seen = np.tile(prior, (len(y), 1)), [0]

            def sums(trees, new, open_):
                f[:] += _scores(trees[seen[0] :], b, classes)
                seen[0] = len(trees)
                hist, loss = histograms(b, y, w, f, new, open_, bins)
                return best_of(hist), loss / w.sum()

            trees, losses = boosting_rounds(sums, classes, rounds, depth, rate, reg)
            return [[(x.feature, x.bin, x.left, x.value) for x in round_] for round_ in trees], losses

        trees, losses = _one_task(data, whole)
        return Boosted(edges, prior, [[Tree(*x) for x in round_] for round_ in trees], losses)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            b = model.bins(matrix(x.column("x"))) if x.num_rows else np.zeros((0, d), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), x.column("y"), x.column("w"), pa.array([prior.tolist()] * len(b), pa.list_(pa.float64()))], names=["b", "y", "w", "f"])

    # A pass sends sums of every open node from each task: tasks of LOT rows, so that these don't grow with the table's files.
    dealt = data.repartition(-(-n // LOT))
    state = [stored(dealt.mapInArrow(encode, "b binary, y int, w double, f array<double>"), "boosting"), 0]

    def read(x: pa.RecordBatch, later: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(x.column("b").to_pylist()), np.uint8).reshape(-1, d)
        return b, matrix(x.column("f")) + _scores(later, b, classes)

    def sums(trees, new, open_):
        later, size = trees[state[1] :], 2 * d * bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros((len(open_), 2, d, bins)), 0.0
            for x in batches:
                if x.num_rows:
                    b, f = read(x, later)
                    h, one_loss = histograms(b, x.column("y").to_numpy(), x.column("w").to_numpy(), f, new, open_, bins)
                    total, loss = total + h, loss + one_loss
            flat = [*total.reshape(len(open_), size), np.array([loss])]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(open_)), -1], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(flat), pa.int64()), pa.array(flat, pa.list_(pa.float64()))], names=["key", "part", "x"])

        def choose(t: pa.Table) -> pa.Table:
            t = t.sort_by("part")
            x, key = np.sum([np.asarray(v.values) for v in t.column("x")], axis=0), t.column("key")[0].as_py()
            return pa.table({"key": [key], "s": pa.array([list(x) if key < 0 else list(map(float, split(x.reshape(2, d, bins), reg, least)))], pa.list_(pa.float64()))})

        parts = state[0].mapInArrow(run, "key long, part long, x array<double>")
        if state[0].rdd.getNumPartitions() > FAN:
            parts = added(stored(parts, "histograms"), key=True)
        out = {r.key: r.s for r in parts.groupBy("key").applyInArrow(choose, "key long, s array<double>").collect()}
        loss = out.pop(-1)[0] / sum(r.w for r in one)
        return {k: (s[0], int(s[1]), int(s[2]), *s[3:]) for k, s in out.items()}, loss

    def done(trees):
        if len(trees) - state[1] >= keep:
            later = trees[state[1] :]

            def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for x in batches:
                    f = read(x, later)[1] if x.num_rows else np.zeros((0, classes))
                    yield pa.RecordBatch.from_arrays([x.column("b"), x.column("y"), x.column("w"), pa.array(list(f), pa.list_(pa.float64()))], names=["b", "y", "w", "f"])

            old = state[0]
            state[:] = [stored(old.mapInArrow(move, "b binary, y int, w double, f array<double>"), "boosting"), len(trees)]
            discard(df.sparkSession, *source_of(old))

    return Boosted(edges, prior, *boosting_rounds(sums, classes, rounds, depth, rate, reg, done))


def boosted(model: Boosted, inputs: str) -> _Model:
    return _Model(model.proba, inputs)


Weights = list[tuple[np.ndarray, np.ndarray]]


def initial(layers: list[int], seed: int) -> Weights:
    """Even draws within one over the root of the inputs, for weights and offsets."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(layers, layers[1:], strict=False)]


def forward(ws: Weights, x: np.ndarray) -> np.ndarray:
    for w, b in ws[:-1]:
        x = np.maximum(x @ w + b, 0)
    return softmax(x @ ws[-1][0] + ws[-1][1])


def gradients(ws: Weights, x: np.ndarray, y: np.ndarray, w: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
    """Sums over rows, in one vector: weight, log loss, then the loss's gradient by every weight and offset. Dropped units of hidden layers are zero, the others grow in proportion."""
    kept, inputs = [], [x]
    for a, b in ws[:-1]:
        z = inputs[-1] @ a + b
        mask = (z > 0) * (1.0 if not dropout else (rng.random(z.shape) >= dropout) / (1 - dropout))
        kept.append(mask)
        inputs.append(z * mask)
    p = softmax(inputs[-1] @ ws[-1][0] + ws[-1][1])
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))).sum()
    delta = p
    delta[np.arange(len(y)), y] -= 1
    delta *= w[:, None]
    out = []
    for i in range(len(ws) - 1, -1, -1):
        out += [delta.sum(axis=0), (inputs[i].T @ delta).reshape(-1)]
        if i:
            delta = delta @ ws[i][0].T * kept[i - 1]
    return np.concatenate([[w.sum(), loss], *out[::-1]])


def _shaped(flat: np.ndarray, ws: Weights) -> Weights:
    return _as_shaped(flat, _shapes(ws))


def _shapes(ws: Weights) -> list[tuple[int, ...]]:
    return [w.shape for w, _ in ws]


def _as_shaped(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> Weights:
    out, at = [], 0
    for a, b in shapes:
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def descend(ws: Weights, step: Callable[[Weights, int, int], np.ndarray], batches: int, check: Callable[[Weights], float] | None, epochs: int, rate: float, least: float, patience: int) -> tuple[Weights, list[float]]:
    """Adam over the sums of step(weights, epoch, batch), until the loss of an epoch (or of check) hasn't fallen by `least` for `patience` epochs; the best weights, and the losses."""
    flat = _flat(ws)
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
    best, lowest, stale, losses = flat, np.inf, 0, []
    for epoch in range(epochs):
        total = np.zeros(2)
        for batch in range(batches):
            out = step(_shaped(flat, ws), epoch, batch)
            if out[0] <= 0:
                continue
            total, g, t = total + out[:2], out[2:] / out[0], t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(check(_shaped(flat, ws)) if check else float(total[1] / max(total[0], 1e-15)))
        if losses[-1] < lowest - least:
            best, lowest, stale = flat, losses[-1], 0
        elif (stale := stale + 1) >= patience:
            break
    return _shaped(best, ws), losses


def batch_sums(rows: DataFrame, ws: Weights, epoch: int, batch: int | None, batches: int, dropout: float, seed: int) -> np.ndarray:
    """gradients() of a batch's rows, added up over the tasks. Rows are dealt to batches anew in each epoch by a hash of their number; batch None: all rows."""
    part = rows if batch is None else rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "k"), F.lit(batches)) == batch)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        total, rng = None, np.random.default_rng([seed, epoch, batch or 0, p])
        for x in stream:
            if x.num_rows:
                out = gradients(ws, matrix(x.column("x")), x.column("y").to_numpy(), x.column("w").to_numpy(), dropout, rng)
                total = out if total is None else total + out
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["part", "x"])

    parts = part.mapInArrow(run, "part long, x array<double>")
    if rows.rdd.getNumPartitions() > FAN:
        parts = added(stored(parts, "gradients"))
    found = sorted(parts.collect(), key=lambda r: r.part)  # at most FAN vectors of the weights' size
    return np.sum([np.array(r.x) for r in found], axis=0) if found else np.zeros(1)


def network(df: DataFrame, validation: DataFrame | None = None, hidden: tuple[int, ...] = (512, 256, 128), epochs: int = 100, batch: int = 64, batches: int = 8, rate: float = 0.001, dropout: float = 0.2, least: float = 0.001, patience: int = 10, seed: int = 42, one_task: int = ONE_TASK) -> tuple[Weights, list[float]]:
    """(weights, losses of the epochs) of a network on (x array<double>, y int, w double).

    A table in one task goes in batches of `batch` rows; a larger one in `batches` rounds an
    epoch, each a job that sums the gradients of its rows.
    """
    clean = lambda d: d.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").cast("array<double>"), F.col("y").cast("int"), F.col("w").cast("double"))
    rows = stored(clean(df).withColumn("k", F.monotonically_increasing_id()), "network")
    other = stored(clean(validation).withColumn("k", F.monotonically_increasing_id()), "network-validation") if validation is not None else None
    one = rows.agg(F.max("y").alias("k"), F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not one.n:
        raise ValueError("no rows to learn from")
    start = initial([one.d, *hidden, one.k + 1], seed)
    if one.n + (other.count() if other is not None else 0) <= one_task:
        both = rows.withColumn("check", F.lit(False))
        both = both if other is None else both.unionByName(other.withColumn("check", F.lit(True)))

        def whole(t: pa.Table) -> tuple:
            t = t.combine_chunks().sort_by([("check", "ascending"), ("k", "ascending")])
            x, y, w, held = matrix(t.column("x")), t.column("y").to_numpy(), t.column("w").to_numpy(), t.column("check").to_numpy()
            n = int((~held).sum())
            orders: dict[int, np.ndarray] = {}

            def step(ws: Weights, epoch: int, i: int) -> np.ndarray:
                if epoch not in orders:
                    orders.clear()
                    orders[epoch] = np.random.default_rng([seed, epoch]).permutation(n)
                at = orders[epoch][i * batch : (i + 1) * batch]
                return gradients(ws, x[at], y[at], w[at], dropout, np.random.default_rng([seed, epoch, i]))

            def check(ws: Weights) -> float:
                out = gradients(ws, x[n:], y[n:], w[n:])
                return float(out[1] / out[0])

            return descend(start, step, -(-n // batch), check if n < len(y) else None, epochs, rate, least, patience)

        return _one_task(both, whole)

    return _descend_afar(rows, other, start, one.n, batches, epochs, rate, least, patience, dropout, seed)


def _flat(ws: Weights) -> np.ndarray:
    return np.concatenate([np.concatenate([w.reshape(-1), b]) for w, b in ws])


def _loss(ws: Weights, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Sums over rows: weight and log loss."""
    return float(w.sum()), float(-(w * np.log(np.maximum(forward(ws, x)[np.arange(len(y)), y], 1e-15))).sum())


def _descend_afar(rows: DataFrame, other: DataFrame | None, start: Weights, n: int, batches: int, epochs: int, rate: float, least: float, patience: int, dropout: float, seed: int) -> tuple[Weights, list[float]]:
    """descend() with weights and moments in a stored table of one row: a step sends the driver the loss only.

    Rows are dealt to groups of about PART rows of a batch; each meets a copy of the weights, and
    the sum of their gradients meets the old state where the new one is made. The best weights are collected at the end.
    """
    spark, kind = rows.sparkSession, "w array<double>, m array<double>, v array<double>, t long, weight double, loss double"
    flat, shapes = _flat(start), _shapes(start)
    state = spark.createDataFrame([(flat.tolist(), [0.0] * flat.size, [0.0] * flat.size, 0, 0.0, 0.0)], kind)
    state = stored(state, "network-state")

    def met(data: DataFrame, parts: int, work: Callable[[int, Weights, pa.Table], pa.Table], schema: str) -> DataFrame:
        copies = state.select("w", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))

        def run(key: tuple, x: pa.Table, s: pa.Table) -> pa.Table:
            return work(key[0].as_py(), _as_shaped(np.asarray(s.column("w")[0].values), shapes), x.combine_chunks())

        dealt = data.withColumn("p", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
        return dealt.groupBy("p").cogroup(copies.groupBy("p")).applyInArrow(run, schema)

    def columns(x: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return matrix(x.column("x")), x.column("y").to_numpy(), x.column("w").to_numpy()

    def step(epoch: int, batch: int, parts: int) -> DataFrame:
        part = rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "k"), F.lit(batches)) == batch)

        def sums(p: int, ws: Weights, x: pa.Table) -> pa.Table:
            out = [gradients(ws, *columns(x), dropout, np.random.default_rng([seed, epoch, batch, p]))] if x.num_rows else []
            return pa.table({"part": pa.array([p] * len(out), pa.int64()), "x": pa.array(out, pa.list_(pa.float64()))})

        def update(key: tuple, g: pa.Table, s: pa.Table) -> pa.Table:
            x = np.sum([np.asarray(a.values) for a in g.sort_by("part").column("x")], axis=0) if g.num_rows else np.zeros(2)
            w, m, v = (np.asarray(s.column(c)[0].values) for c in ("w", "m", "v"))
            t = s.column("t")[0].as_py()
            if x[0] > 0:
                d, t = x[2:] / x[0], t + 1
                m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
                w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            return pa.table({"w": pa.array([w], pa.list_(pa.float64())), "m": pa.array([m], pa.list_(pa.float64())), "v": pa.array([v], pa.list_(pa.float64())), "t": [t], "weight": [float(x[0])], "loss": [float(x[1])]})

        gs = met(part, parts, sums, "part long, x array<double>")
        gs = added(stored(gs, "gradients")) if parts > FAN else gs
        one = lambda d: d.withColumn("at", F.lit(0)).groupBy("at")
        return stored(one(gs).cogroup(one(state)).applyInArrow(update, kind), "network-state")

    def check(parts: int) -> float:
        def sums(p: int, ws: Weights, x: pa.Table) -> pa.Table:
            found = [_loss(ws, *columns(x))] if x.num_rows else []
            return pa.table({"weight": pa.array([f[0] for f in found], pa.float64()), "loss": pa.array([f[1] for f in found], pa.float64())})

        r = met(other, parts, sums, "weight double, loss double").agg(F.sum("weight"), F.sum("loss")).first()
        return r[1] / r[0]

    parts = max(1, -(-n // batches // PART))
    checked = max(1, -(-other.count() // PART)) if other is not None else 1
    best, lowest, stale, losses = state, np.inf, 0, []
    for epoch in range(epochs):
        total = np.zeros(2)
        for batch in range(batches):
            old, state = state, step(epoch, batch, parts)
            if old is not best:
                discard(spark, *source_of(old))
            r = state.select("weight", "loss").first()
            total += (r.weight, r.loss)
        losses.append(check(checked) if other is not None else float(total[1] / max(total[0], 1e-15)))
        if losses[-1] < lowest - least:
            if best is not state:
                discard(spark, *source_of(best))
            best, lowest, stale = state, losses[-1], 0
        elif (stale := stale + 1) >= patience:
            break
    return _as_shaped(np.array(best.first().w), shapes), losses


def networked(ws: Weights, inputs: str) -> _Model:
    return _Model(lambda x: forward(ws, x), inputs)


def packed(rows: DataFrame, n: int, name: str) -> DataFrame:
    """n rows (x array<double>, y int, w double if any) as stored blocks (x, y, w binary) of up to BLOCK rows, dealt evenly to as many tasks as run at a time, or a multiple of them."""
    slots, kinds = rows.sparkSession.sparkContext.defaultParallelism, {c: t for c, t in (("y", np.int32), ("w", np.float64)) if c in rows.columns}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = np.array(part.column("x").to_pylist()) if part.column("x").offset else matrix(part.column("x"))
                rest = [part.column(c).to_numpy().astype(t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x.astype(np.float64), *rest)], names=["x", *kinds])

    tasks = max(1, min(-(-n // LITTLE), slots * -(-n // (slots * MUCH))))
    return stored(rows.repartition(tasks).mapInArrow(pack, ", ".join(f"{c} binary" for c in ("x", *kinds))), name)


def sigmoid_sums(ws: Weights, x: np.ndarray, y: np.ndarray, slopes: bool = True) -> np.ndarray:
    """Sums over rows, in one vector: rows, log loss, then (where asked for) its gradient by every weight and offset, of a network with sigmoid hidden units and a softmax."""
    inputs = [x]
    with np.errstate(over="ignore"):
        for a, b in ws[:-1]:
            inputs.append(1 / (1 + np.exp(-(inputs[-1] @ a + b))))
    delta = softmax(inputs[-1] @ ws[-1][0] + ws[-1][1])
    row = np.arange(len(y))
    out = [np.array([len(y), -np.log(np.maximum(delta[row, y], 1e-15)).sum()])]
    if not slopes:
        return out[0]
    delta[row, y] -= 1
    back = []
    for i in range(len(ws) - 1, -1, -1):
        back += [delta.sum(axis=0), (inputs[i].T @ delta).reshape(-1)]
        if i:
            delta = delta @ ws[i][0].T * (inputs[i] * (1 - inputs[i]))
    return np.concatenate([*out, *back[::-1]])


def block_sums(blocks: DataFrame, layers: list[int], flat: np.ndarray, slopes: bool = True) -> np.ndarray:
    """sigmoid_sums() over packed() rows; tasks add up theirs, then each other's. flat: the weights in the order of Spark ML's network."""
    shared = blocks.sparkSession.sparkContext.broadcast(flat)
    shapes = list(zip(layers, layers[1:], strict=False))

    def part(rows: Iterator) -> Iterator[np.ndarray]:
        ws, total = _as_shaped(shared.value, shapes), None
        for r in rows:
            y = np.frombuffer(r.y, np.int32)
            out = sigmoid_sums(ws, np.frombuffer(r.x, np.float64).reshape(len(y), -1), y, slopes)
            total = out if total is None else total + out
        if total is not None:
            yield total

    total = blocks.rdd.mapPartitions(part).treeReduce(np.add)
    shared.destroy()
    return total


Point = tuple[np.ndarray, float, np.ndarray]


class _NoStep(Exception):
    """A line search or direction failed."""


def quasi_newton(of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: Point, most: int, memory: int = 10, tolerance: float = 1e-6) -> Point:
    """The point, value and gradient after at most so many steps of limited-memory BFGS with a search for the strong Wolfe conditions: the method, and the stops, of Spark ML's network."""
    x, value, grad = start
    first, seen, steps, failed = value, [np.inf], [], False
    done = 0
    while done < most and np.linalg.norm(grad) > max(tolerance * abs(value), 1e-8) and not (len(seen) > 1 and abs(value - max(seen)) <= tolerance * first):
        try:
            way = _direction(grad, steps)
            new = _searched(of, (x, value, grad), way, 1.0 if done else 1 / np.linalg.norm(way))
        except _NoStep:
            if failed:
                break
            steps, failed = [], True
            continue
        steps, failed, done = [(new[0] - x, new[2] - grad), *steps][:memory], False, done + 1
        x, value, grad = new
        seen = [*seen, value][-20:]
    return x, value, grad


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill, by the curvature of the latest steps (moves and changes of the gradient, the newest first)."""
    way, shares = grad.copy(), []
    for s, g in steps:
        shares.append(s @ way / (s @ g))
        way -= shares[-1] * g
    if steps:
        s, g = steps[0]
        if not s @ g >= 0:
            raise _NoStep
        way *= s @ g / (g @ g)
    for (s, g), share in zip(reversed(steps), reversed(shares), strict=True):
        way += (share - g @ way / (s @ g)) * s
    if not np.isfinite(way).all():
        raise _NoStep
    return -way


def _searched(of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: Point, way: np.ndarray, t: float, little: float = 1e-4, flat: float = 0.9, tries: int = 10) -> Point:
    """A point along the way whose value has fallen by `little` of the slope at least and whose slope is at most `flat` of it: steps grow by half, then brackets shrink by cubic interpolation."""
    x, value, grad = start
    slope = grad @ way
    if slope > 0:
        raise _NoStep

    def at(t: float) -> tuple[float, float, float, Point]:
        there = x + t * way
        v, g = of(there)
        return t, v, g @ way, (there, v, g)

    def between(low: tuple, high: tuple) -> float:
        (a, fa, da, _), (b, fb, db, _) = sorted((low, high), key=lambda p: p[0])
        d1 = da + db - 3 * (fa - fb) / (a - b)
        d2 = np.sqrt(max(d1 * d1 - da * db, 0.0))
        t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
        return float(np.clip(t, a + 0.1 * (b - a), a + 0.9 * (b - a))) if np.isfinite(t) else (a + b) / 2

    def shrunk(low: tuple, high: tuple) -> Point:
        for _ in range(tries):
            c = at(between(low, high))
            if c[1] > value + little * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= flat * abs(slope):
                return c[3]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _NoStep

    low = 0.0, value, slope, start
    for i in range(tries):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + little * t * slope or (c[1] >= low[1] and i):
            return shrunk(low, c)
        if abs(c[2]) <= flat * abs(slope):
            return c[3]
        if c[2] >= 0:
            return shrunk(c, low)
        low, t = c, t * 1.5
    raise _NoStep


class Supported(Transformer):
    """Adds the prediction of support vectors on kernel features, one class against the rest: the class of the greatest margin."""

    def __init__(self, kernel: Fourier, coefficients: np.ndarray, intercepts: np.ndarray):
        super().__init__()
        self.kernel, self.coefficients, self.intercepts = kernel, coefficients, intercepts

    def _transform(self, df: DataFrame) -> DataFrame:
        of, u, v = self.kernel.of, self.coefficients, self.intercepts

        @F.pandas_udf("double")
        def best(x: pd.Series) -> pd.Series:
            parts = (np.stack(x.iloc[at : at + BLOCK].to_list()) for at in range(0, len(x), BLOCK))
            return pd.Series(np.concatenate([np.zeros(0), *((of(p) @ u.T + v).argmax(axis=1) for p in parts)]))

        return df.withColumn("prediction", best(vector_to_array(self.kernel.inputs)))


def _over_blocks(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], object], add: Callable) -> object:
    """What work makes of packed() rows (x, y, w), added up by task, then over the tasks."""

    def part(rows: Iterator) -> Iterator:
        total = None
        for r in rows:
            y, w = np.frombuffer(r.y, np.int32), np.frombuffer(r.w, np.float64)
            out = work(np.frombuffer(r.x, np.float64).reshape(len(y), -1), y, w)
            total = out if total is None else add(total, out)
        if total is not None:
            yield total

    return blocks.rdd.mapPartitions(part).treeReduce(add)


def _moments(z: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums of weights and of their squares, mean and sum of squares about it of each column."""
    mean = w @ z / (total := max(w.sum(), 1e-300))
    apart = z - mean
    return total, (w * w).sum(), mean, w @ np.multiply(apart, apart, out=apart)


def _joined(a: tuple, b: tuple) -> tuple:
    total, apart = a[0] + b[0], b[2] - a[2]
    return total, a[1] + b[1], a[2] + apart * (b[0] / total), a[3] + b[3] + apart**2 * (a[0] * b[0] / total)


def hinge_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, classes: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A row for each class, against the rest: sums over rows of the hinge loss and its gradient by intercept and coefficients. u, v: those of each class."""
    side = np.where(y[:, None] == classes, 1.0, -1.0)
    slack = np.maximum(1 - side * (z @ u.T + v), 0)
    slope = np.where(slack > 0, -side * w[:, None], 0.0)
    return np.concatenate([(w @ slack)[:, None], slope.sum(axis=0)[:, None], slope.T @ z], axis=1)


def support_vectors(rows: DataFrame, n: int, kernel: Fourier, classes: int, reg: float, most: int = 100, one_task: int = ONE_TASK) -> Supported:
    """Linear support vectors on kernel features of n rows (x array<double>, y int, w double), one class against the rest: the objective and stops of Spark ML's LinearSVC without standardization, by a like search.

    Features are made of a block of rows at a time and not kept, except in a table for one task. A pass takes the
    sums of all classes that aren't done; only coefficients and their gradients pass the driver.
    """
    if n <= one_task:

        def whole(t: pa.Table) -> tuple:
            t = t.combine_chunks()
            z, y, w = kernel.of(matrix(t.column("x"))), t.column("y").to_numpy(), t.column("w").to_numpy()
            return one_against_rest(lambda *point: hinge_sums(z, y, w, *point), _moments(z, w), classes, reg, most)

        return Supported(kernel, *_one_task(rows, whole))
    blocks, context = packed(rows, n, "kernel-rows"), rows.sparkSession.sparkContext

    def sums(*point: np.ndarray) -> np.ndarray:
        shared = context.broadcast((kernel, point))
        out = _over_blocks(blocks, lambda x, y, w: hinge_sums(shared.value[0].of(x), y, w, *shared.value[1]), np.add)
        shared.destroy()
        return out

    return Supported(kernel, *one_against_rest(sums, _over_blocks(blocks, lambda x, y, w: _moments(kernel.of(x), w), _joined), classes, reg, most))


def one_against_rest(sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], moments: tuple, classes: int, reg: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of each class. sums: hinge_sums() over all rows, of classes and their coefficients and intercepts; searches go in the space of centred and scaled columns."""
    total, squares, mean, about = moments
    std = np.sqrt(about / max(total - squares / total, 1e-300))
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 1e-12)
    plain = lambda c: (c[:-1] * scale, c[-1] - mean @ (c[:-1] * scale))
    searches, found = {k: descent(np.zeros(len(std) + 1), most) for k in range(classes)}, {}
    asked = {k: next(s) for k, s in searches.items()}
    while asked:
        at = np.array(sorted(asked))
        us, vs = (np.array(a) for a in zip(*(plain(asked[k]) for k in at), strict=True))
        for k, u, x in zip(at, us, sums(at, us, vs) / total, strict=True):
            try:
                asked[k] = searches[k].send((x[0] + reg * (u @ u) / 2, np.append((x[2:] - mean * x[1] + reg * u) * scale, x[1])))
            except StopIteration as end:
                found[k] = plain(end.value)
                del asked[k]
    us, vs = zip(*(found[k] for k in range(classes)), strict=True)
    return np.array(us), np.array(vs)


def descent(x: np.ndarray, most: int, memory: int = 10, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Asks for the value and gradient at one point after another, and returns the last of at most so many steps of limited-memory BFGS, with the stops of Spark ML's."""
    value, grad = yield x
    first, seen, steps, failed, done = value, [np.inf], [], False, 0
    while done < most and np.linalg.norm(grad) > max(tolerance * abs(value), 1e-8) and not (len(seen) > 1 and abs(value - max(seen)) <= tolerance * first):
        try:
            way = _direction(grad, steps)
            new = yield from _bracketed((x, value, grad), way, 1.0 if done else 0.5 / np.linalg.norm(grad))
        except _NoStep:
            if failed:
                break
            steps, failed = [], True
            continue
        steps, failed, done = [(new[0] - x, new[2] - grad), *steps][:memory], False, done + 1
        x, value, grad = new
        seen = [*seen, value][-20:]
    return x


def _bracketed(start: Point, way: np.ndarray, t: float, little: float = 1e-4, flat: float = 0.9, tries: int = 20) -> Generator[np.ndarray, tuple[float, np.ndarray], Point]:
    """A point along the way that meets the weak Wolfe conditions, which a hinge's corners don't rule out: steps grow, then brackets are halved; or the last that fell."""
    x, value, grad = start
    slope, low, high, best = grad @ way, 0.0, np.inf, None
    for _ in range(tries):
        there = x + t * way
        v, g = yield there
        if v > value + t * slope * little:
            high = t
        else:
            low, best = t, (there, v, g)
            if g @ way >= flat * slope:
                break
        t = (low + high) / 2 if np.isfinite(high) else t * 2.1
    if best is None:
        raise _NoStep
    return best
