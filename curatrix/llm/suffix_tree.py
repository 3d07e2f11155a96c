"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to DEPTH words (BEGIN counts as one). A context seen LEAST times in training, whatever the
corpus's size, is a candidate. It is retained if its next-word distribution diverges from that of
the context one word shorter: the log likelihood ratio of the two, summed over its training
occurrences (each rounded to 1/256) with the occurrence itself left out of every count, must
reach GAIN nats. A context whose shorter one was always followed by one word can't diverge from it and
isn't retained. Next-word distributions are smoothed down the chain of suffixes:
p(w|s) = (c(s,w) + m p(w|s')) / (c(s) + m), m by the length of s, the root's being
(c + 0.1) / (N + 0.1 (V + 1)). Each token is scored in the state of the longest retained suffix
of what precedes it.

Neither corpus nor model is ever in one place. The documents are packed once, where they are
read, into blocks of token numbers (rows of a table in the shared folder, bucketed by block so that
later joins don't move them). Words are numbered once they have met in their buckets; from then on their
hashes are neither kept nor sent. For each n-gram length, every block sends its distinct n-grams
with their training counts, as sorted hashes, to buckets by hash; buckets add up and answer each block in its
own order. So the tree grows level by level, and is pruned before it is sent: longer n-grams only after
candidates, and only where no shorter context was always followed by the same word, as then
all counts follow from the shorter ones. The divergence of each context is added up the same way, with
later n-grams, that of single words at the end; the longest n-grams go with those a word shorter. A key comes at most once from each block, so no key is hot,
and nothing is broadcast. A level sends at most blocks times buckets messages, and never more than its
n-grams.

N-grams of two words and more are compared by hashes of as many bits as the corpus needs for any
one to be mistaken with a chance of about 2^-MARGIN; words by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, quoted, shuffle_partitions, small_batches, source_of, table
from .wordhash import Words, buffers, mix, pieces, release

DEPTH, LEAST, GAIN = 4, 5, 1.5
#: Weight of the shorter context's distribution by context length (the last holds for longer ones), picked with LEAST and GAIN by the score of a tenth of the training rows left out of training: one word says little about the next, more often stand in a copied passage.
MU = (2000.0, 5.0, 2.0)
BLOCK_BYTES, BUCKET_BYTES, FILE_BYTES = 5 << 20, 16 << 20, 64 << 20
MARGIN = 20
END, BEGIN = np.uint64(0x1B873593CC9E2D51), np.uint64(0xE6546B64B5297A4D)
_STEP = np.uint64(0x2545F4914F6CDD1D)
#: Levels: n for n-grams, 100 + n for contexts of n symbols, ONE those of one word; NUMBERS those of words.
ONE, NUMBERS = 101, 0


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays after each other, zstd-compressed; sorted uint64 ones as differences, byte planes together."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        for a in arrays:
            if a.dtype == np.uint64:
                a = np.diff(a, prepend=np.uint64(0))
            planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T) if len(a) else a
            out.write(np.int64(len(a)).tobytes() + planes.tobytes())
    return sink.getvalue().to_pybytes()


def _unpress(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = pa.CompressedInputStream(pa.BufferReader(blob), "zstd").read(), 0, []
    for kind in map(np.dtype, kinds):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 8).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += 8 + n * kind.itemsize
    return out


class Block:
    """The token sequences BEGIN words END of some texts: the number of each token among the block's sorted distinct hashes. They are stored by falling frequency, which takes fewer bytes."""

    def __init__(self, blob: bytes):
        head = int.from_bytes(blob[:8], "little")
        t = pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(blob[8 : 8 + head]), "zstd")).read_all().combine_chunks()
        self.ids, self.train, self.n_words = t.column(0), t.column(1).to_numpy(), t.column(2).to_numpy()
        often, ranks = _unpress(blob[8 + head :], np.uint32, np.uint32)
        self.n_uniq, self.codes = len(often), self._by_frequency(often)[ranks]
        size = self.n_words + 2
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.place = (np.arange(len(self.codes)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.trained = self.train[self.doc] & (self.place > 0)

    @staticmethod
    def _by_frequency(often: np.ndarray) -> np.ndarray:
        return np.argsort(-often.astype(np.int64), kind="stable")

    @classmethod
    def pack(cls, batches: list[pa.RecordBatch]) -> tuple[bytes, bytes]:
        """Of batches (identifier, whether to learn from it, text): the block, and apart from it its distinct hashes."""
        hashes, counts = [], []
        for b in batches:
            words = Words(*buffers(b.column(2), lower=True))
            first = np.searchsorted(words.doc, np.arange(b.num_rows), side="left")
            n = np.diff(np.append(first, len(words)))
            h = np.insert(words.hashes(), first + n, END)
            hashes.append(np.insert(h, first + np.arange(b.num_rows), BEGIN))
            counts.append(n)
        t = pa.table({"id": pa.chunked_array([b.column(0) for b in batches]), "train": pa.chunked_array([b.column(1) for b in batches]), "n": np.concatenate(counts)})
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "zstd") as z, pa.ipc.new_stream(z, t.schema) as out:
            out.write_table(t)
        head = sink.getvalue().to_pybytes()
        uniq, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        often = np.bincount(codes, minlength=len(uniq)).astype(np.uint32)
        ranks = np.empty(len(uniq), np.uint32)
        ranks[cls._by_frequency(often)] = np.arange(len(uniq), dtype=np.uint32)
        return len(head).to_bytes(8, "little") + head + _press(often, ranks[codes]), _press(uniq)


class Level:
    """Contexts of n symbols: the places of tokens for which they are asked (ask), there the keys of context (one word: its number) and n-gram, and the smoothed probabilities by the context and by the one a symbol shorter (None where the n-grams' counts aren't known yet). n = 0: all tokens by the root."""

    __slots__ = ("n", "ask", "context", "gram", "p", "shorter")

    def __init__(self, n: int, ask: np.ndarray, context: np.ndarray, gram: np.ndarray):
        self.n, self.ask, self.context, self.gram, self.p, self.shorter = n, ask, context, gram, None, None

    def longer(self, at: np.ndarray, gram: np.ndarray, word: np.ndarray, mask: np.uint64) -> Level:
        """The next level's tokens and n-grams, as far as they can be told before the answers of this one: more than will be needed. at, gram: all tokens with such a context, and their n-grams."""
        before = np.minimum(np.searchsorted(at, self.ask - 1), len(at) - 1)
        ok = at[before] == self.ask - 1 if len(at) else np.zeros(0, bool)
        ask, context = self.ask[ok], gram[before[ok]]
        return Level(self.n + 1, ask, context, mix(context * _STEP + word[ask] + np.uint64(self.n + 1)) & mask)


class Model:
    """What every task needs: the parameters, the bits of n-grams' keys, training tokens and types."""

    def __init__(self, depth: int, least: int, mu: tuple[float, ...], bits: int, n_tokens: int, n_types: int):
        self.depth, self.least, self.mu, self.bits, self.n_tokens, self.n_types = depth, least, mu, bits, n_tokens, n_types

    def walk(self, b: Block, told: dict[int, np.ndarray], out_one: bool) -> Iterator[Level]:
        """The levels of a block as far as the buckets have answered, and one more whose n-grams are to be asked for. out_one: probabilities without the occurrence itself."""
        if 1 not in told:
            return
        one = float(out_one)
        count = told[1][b.codes].astype(np.float64)
        root = Level(0, b.place, b.place, b.place)
        root.shorter = count
        p = root.p = (np.maximum(count - one, 0) + 0.1) / (self.n_tokens - one + 0.1 * (self.n_types + 1))
        yield root
        del root
        count[b.place == 0] = float(told[1][b.codes[-1]]) if len(b.codes) else 0.0  # BEGIN is seen as often as END, the last token
        mask = ~np.uint64((1 << (64 - self.bits)) - 1)
        word = mix(told[NUMBERS])
        #: Tokens after a context (shorter than those now looked at) that was always followed by them: counts go on, nothing is asked.
        known = np.zeros(len(count), bool)

        def after(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The tokens that come after these, and for which of these there is one."""
            ok = at + 1 < len(b.codes)
            ok[ok] = b.place[at[ok] + 1] > 0
            return at[ok] + 1, ok

        each, asked = word[b.codes], None
        at, _ = after(np.flatnonzero(count >= self.least))
        before, context = count[at - 1], each[at - 1]
        for n in range(1, self.depth + 1):
            gram = mix(context * _STEP + each[at] + np.uint64(n)) & mask
            new = ~known[at]
            level = Level(n, at[new], context[new] if n > 1 else told[NUMBERS][b.codes[at[new] - 1]], gram[new])
            ahead = level.longer(at, gram, each, mask) if n == self.depth - 1 else None
            if n + 1 not in told:
                yield level
                if ahead is not None:
                    yield ahead
                return
            count = before.copy()
            if len(level.ask):
                count[new] = told[n + 1][np.unique(level.gram, return_inverse=True)[1] if asked is None else np.searchsorted(asked, level.gram)]
            asked = np.unique(ahead.gram) if ahead is not None else None
            del ahead
            known[at[count == before]] = True
            m = self.mu[min(n, len(self.mu)) - 1]
            shorter = p[at]
            p[at] = longer = (np.maximum(count - one, 0) + m * shorter) / (np.maximum(before - one, 0) + m)
            level.p, level.shorter = longer[new], shorter[new]
            yield level
            del level
            # Longer contexts: of tokens that may be asked for, and of known ones as far as those need their counts.
            need, reach = ~known, ~known
            for _ in range(self.depth - n):
                reach = np.append(reach[1:], False)
                need = need | reach
            keep = np.flatnonzero((count >= self.least) & need[at])
            at, ok = after(at[keep])
            before, context = count[keep][ok], gram[keep][ok]


def _cut(uniq: np.ndarray, values: np.ndarray, level: int, block_id: int, buckets: int) -> Iterator[tuple]:
    """Sorted hashes (of level ONE: numbers of words) and their values, cut so that each part belongs to one bucket."""
    bucket = uniq >> np.uint64(32)
    if level != ONE:
        bucket = bucket * np.uint64(buckets) >> np.uint64(32)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))), len(uniq)) if len(uniq) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield level, int(bucket[i]), block_id, _press(uniq[i:j], values[i:j])


def _words(b: Block, words: bytes, block_id: int, buckets: int) -> Iterator[tuple]:
    """The block's distinct tokens with their training counts."""
    seen = np.bincount(b.codes, weights=b.trained, minlength=b.n_uniq)
    yield from _cut(_unpress(words, np.uint64)[0], seen.astype(np.uint32), 1, block_id, buckets)


def _grams(b: Block, level: Level, block_id: int, buckets: int) -> Iterator[tuple]:
    """The block's distinct n-grams that are asked for after contexts of n symbols, with their training counts."""
    uniq, back = np.unique(level.gram, return_inverse=True)
    yield from _cut(uniq, np.bincount(back, weights=b.trained[level.ask], minlength=len(uniq)).astype(np.uint32), level.n + 1, block_id, buckets)


def _gains(b: Block, level: Level, block_id: int, buckets: int) -> Iterator[tuple]:
    """The block's contexts of n symbols with their part of the log likelihood ratio."""
    uniq, back = np.unique(level.context, return_inverse=True)
    each = np.rint(256 * (np.log(level.p) - np.log(level.shorter))) * b.trained[level.ask]
    total = np.clip(np.bincount(back, weights=each, minlength=len(uniq)), -(1 << 30), 1 << 30)
    yield from _cut(uniq, total.astype(np.int32), 100 + level.n, block_id, buckets)


def _answers(lists: list[list[dict] | None]) -> dict[int, np.ndarray]:
    """level -> counts (or whether the context is retained) in the order of the block's sorted keys; NUMBERS -> the words' numbers: bucket and place in it."""
    by: dict[int, list] = {}
    for r in sorted((r for x in lists for r in x or ()), key=lambda r: (r["level"], r["bucket"])):
        found, *place = _unpress(r["blob"], np.uint8 if r["level"] > 100 else np.uint32, *[np.uint64] * (r["level"] == 1))
        by.setdefault(r["level"], []).append(found)
        for x in place:
            by.setdefault(NUMBERS, []).append(x + np.uint64(r["bucket"] << 32))
    return {k: np.concatenate(v) for k, v in by.items()}


def _add_up(group: pa.Table, gain: float) -> pa.Table:
    """Sums of one level and bucket, answered to each block in its own order, those of words with their place among the bucket's; and its tokens and types."""
    level, bucket = group.column("level")[0].as_py(), group.column("bucket")[0].as_py()
    ids = group.column("block").to_pylist()
    parts = [_unpress(x.as_py(), np.uint64, np.int32 if level > 100 else np.uint32) for x in group.column("blob")]
    uniq, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(uniq))
    answer = (total >= 256 * gain).astype(np.uint8) if level > 100 else total.astype(np.uint32)
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    blobs = [_press(answer[back[i:j]], *[back[i:j].astype(np.uint64)] * (level == 1)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(ids)
    release()
    return pa.table({"block": ids, "level": pa.array([level] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "blob": pa.array(blobs, pa.binary()), "tokens": pa.array([int(total.sum()) if level == 1 else 0] + [0] * (n - 1), pa.int64()), "types": pa.array([int((total > 0).sum()) if level == 1 else 0] + [0] * (n - 1), pa.int64())})


_REQUEST = "level int, bucket int, block long, blob binary"
_ANSWER = "block long, level int, bucket int, blob binary, tokens long, types long"


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, mu: tuple[float, ...] = MU, gain: float = GAIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: id_col (long), train boolean, n_tokens, n_known, train_tokens long, base_score, score double, mean_depth double.

    train: whether a row is learned from (null: it is not). Tokens are the text's words, A-Z
    lower-cased, and one end. A null text counts as empty: one token, the end. Scores are sums
    of log10 probabilities, base_score the root's alone; a token unseen in training takes the
    root's share of one unseen type. mean_depth is the mean length of the states used.
    Repeated rows are learned from as often as they come and get equal scores. An empty table
    gives an empty result; with nothing to learn from, every token has its root share. Other
    columns of df are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(quoted(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(shuffle_partitions(spark), size // FILE_BYTES)
    bits = min(64, (size // 4).bit_length() + MARGIN)
    buckets = 1 + size // BUCKET_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal at
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at - 1], pa.int64()), *(pa.array([x], pa.binary()) for x in Block.pack(waiting))], names=["block", "tokens", "words"])

        for b in pieces(batches, 2, block_bytes):
            n = pa.compute.sum(pa.compute.binary_length(b.column(2))).as_py() or 0
            if waiting and held + n > block_bytes:
                yield flush()
                waiting, held = [], 0
            waiting.append(b)
            held += n
        if waiting:
            yield flush()

    packed = bucketed(rows.mapInArrow(pack, "block long, tokens binary, words binary"), "lm_packed", "block", files)
    answers: list[DataFrame] = []

    def meet() -> DataFrame:
        """Blocks with what has been answered to each; all tables are bucketed alike."""
        out = blocks
        for i, a in enumerate(answers):
            out = out.join(a.withColumnRenamed("answers", f"a{i}").hint("merge"), "block", "left")
        return out

    def read(b: pa.RecordBatch) -> Iterator[tuple[int, Block, dict[int, np.ndarray]]]:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), Block(b.column(1)[i].as_py()), _answers([c[i].as_py() for c in b.columns[2:]])

    def ask(of: DataFrame, send) -> DataFrame:
        """One round: each block's requests, added up by bucket and answered. The answers' totals."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in send(b):
                    if found := list(x):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["level", "bucket", "block", "blob"])
            release()

        told = of.mapInArrow(run, _REQUEST).groupBy("level", "bucket").applyInArrow(lambda g: _add_up(g, gain), _ANSWER)
        each = told.repartition(files, "block").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "blob")).alias("answers"), F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
        kept = bucketed(each, "lm_answers", "block", files)
        answers.append(kept.select("block", "answers"))
        return kept

    def send_words(b: pa.RecordBatch) -> Iterator[Iterator[tuple]]:
        for at, tokens, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield _words(Block(tokens), words, at, buckets)

    first = ask(packed, send_words)
    model = Model(depth, least, mu, bits, *first.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    blocks = bucketed(packed.select("block", "tokens"), "lm_blocks", "block", files)
    discard(spark, *source_of(packed))

    # Round k asks for k-grams; the last one that does, for those a word longer too. Divergences follow as soon as they can be told, those of single words in the last round.
    last = max(depth, 2)

    def send_level(k: int):
        def found(at: int, block: Block, told: dict[int, np.ndarray]) -> Iterator[tuple]:
            for level in model.walk(block, told, True):
                if level.n and level.p is None:
                    if k <= last:
                        yield from _grams(block, level, at, buckets)
                elif level.n and (1 < level.n == k - 2 or k > last and (level.n == 1 or level.n > k - 2)):
                    yield from _gains(block, level, at, buckets)

        def send(b: pa.RecordBatch) -> Iterator[Iterator[tuple]]:
            for at, block, told in read(b):
                yield found(at, block, told)

        return send

    for k in range(2, last + 1):
        if ask(meet(), send_level(k)).isEmpty():
            break
    ask(meet(), send_level(last + 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block, told in read(b):
                used = np.zeros(len(block.codes), np.int8)
                for level in model.walk(block, told, False):
                    if level.n == 0:  # the walk goes on with these arrays
                        base, best, count = np.log10(level.p), level.p.copy(), level.shorter > 0
                    elif level.p is not None and 100 + level.n in told:
                        kept = told[100 + level.n][np.unique(level.context, return_inverse=True)[1]] > 0
                        best[level.ask[kept]], used[level.ask[kept]] = level.p[kept], level.n
                own = block.place > 0
                size = len(block.train)
                add = lambda x: np.bincount(block.doc[own], weights=x[own], minlength=size)  # noqa: B023,E731
                known = add(count)
                length = block.n_words + 1
                yield pa.RecordBatch.from_arrays(
                    [block.ids.combine_chunks() if isinstance(block.ids, pa.ChunkedArray) else block.ids, pa.array(block.train), pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array([model.n_tokens] * size, pa.int64()), pa.array(add(base)), pa.array(add(np.log10(best))), pa.array(add(used) / length)],
                    names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_depth"],
                )
            release()

    done = meet().mapInArrow(finish, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_depth double")
    return done.withColumnRenamed("id", id_col)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_depth")
