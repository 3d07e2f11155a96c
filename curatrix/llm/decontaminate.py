"""Benchmark decontamination by template canonicalisation.

Texts become token sequences: A-Z, À-Þ lower-cased, punctuation dropped. Three canonical forms
are made: numbers and the units that follow them as placeholders; besides that names, once
capitalised words inside a sentence, once all capitalised words that aren't function words, as
names open sentences and lines too. Numbers are tokens with a digit and number words.

Windows of WINDOW tokens of the benchmark's items are hash-joined with those of the documents by
seeds: of every GROUP consecutive windows of an item the one with a literal that is rarest in
the benchmark, so a hit of SHARE of an item's windows or of RUN tokens holds a seed. A window of
numbers and units alone is joined by its own values. A seed that an item repeats is joined at
its first place in the item, with the first of each stretch of its places in a document. Seeds that
meet give a diagonal (item and document in step); along it all windows of the item are compared in
every form, those of placeholders alone too. A window of the item that no diagonal has counts
at its place nearest to one. So the work is linear in the windows and diagonals.

Slots must be consistent: every value of an item's slot stands for one value in the document;
windows against the majority value don't count, unless they have the item's own values. A
document holds an item if SHARE of the item's windows count, or RUN tokens in a row do; first
without the third form, then with it. An item whose counted tokens are other names for the most
part (RENAMED) is not held. An item of fewer than WINDOW tokens is held where a sentence or a line
has just its words.

The item side is joined as a broadcast sorted hash index. Its size is checked: items are cut
into blocks of at most INDEX_BYTES of text and each block is run against all documents, so no
broadcast grows with the benchmark. Documents are only mapped, never shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, quoted, small_batches, table
from .wordhash import TO_LOWER, Words, buffers, ngrams, pieces

WINDOW, SHARE, RUN = 5, 0.8, 13
#: Of so many consecutive windows one is a seed: RUN tokens hold a whole group, and fewer than 1 - SHARE of the windows can't be all seeds.
GROUP = 4
#: An item with more than this share of its counted tokens renamed is not held: such are lists of names.
RENAMED = 0.6
INDEX_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ton tons ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers".split()

_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: A hyphen is dropped, so twenty-five is twentyfive.
NUMBER_WORDS = [*_ONES, *_TENS, *(t + o for t in _TENS for o in _ONES), *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split()]
#: Words that aren't names where they open a sentence. Those that are names too (will, may) are not among them.
FUNCTION_WORDS = "a about above after again against all although an and another any are as at be because been before being below between both but by can could did do does during each either every few find for from given had has have he her hers him his how i if in into is it its let many more most much must my neither no nor not now of off on once only or other our out over she should since so some such than that the their them then there these they this those through to under until up upon us was we were what when where whether which while who whom whose why with within without would you your".split()

_CLASS = np.zeros(256, np.uint8)  # 1 kept, 2 digit (kept), 3 upper-case (kept), 4 ends a sentence
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[list(b".!?:\n")] |= 4
_NUM, _UNIT, _NAME = (np.uint64(0xA0761D6478BD642F + i) for i in range(3))


class Templates:
    """Tokens of some texts in the canonical forms."""

    def __init__(self, column: pa.Array):
        count = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
        data, offsets = buffers(column)
        two = np.zeros(len(data), bool)  # second bytes of À to Þ
        if len(data) > 1:
            two[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low = TO_LOWER[data] + (two.view(np.uint8) << 5)
        kind = _CLASS[data]
        keep = (kind & 3) > 0
        if len(data) > 2:  # general punctuation, U+2000 to U+203F
            for at in np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)):
                keep[at : at + 3] = False
        at = np.flatnonzero(keep)
        before = count(keep)
        self.words = words = Words(low[at], before[offsets])
        left, right = (at[words.starts], at[words.ends - 1] + 1) if len(words) else (words.starts, words.ends)
        digits, stops = count(kind == 2), count(kind >= 4)
        h = words.hashes()
        spelled = _among(h, NUMBER_HASHES)
        number = (digits[right] > digits[left]) | spelled
        upper = (kind[left] == 3) | ((data[left] == 0xC3) & two[np.minimum(left + 1, max(len(data) - 1, 0))]) if len(words) else number
        opens = np.ones(len(words), bool)
        if len(words) > 1:
            opens[1:] = (stops[left[1:]] > stops[right[:-1]]) | (words.doc[1:] != words.doc[:-1])
        unit = np.zeros(len(words), bool)
        unit[1:] = number[:-1] & _among(h[1:], UNIT_HASHES) & (words.doc[1:] == words.doc[:-1])
        self.slot = np.where(number, 1, np.where(unit, 2, 0)).astype(np.int8)
        spelled[1:] |= spelled[:-1] & unit[1:]
        self.slot[spelled] = 4  # may be plain words too, as in "one of them"
        self.name = upper & ~opens & (self.slot == 0)
        wide = upper & (self.slot == 0) & ~_among(h, FUNCTION_HASHES)
        plain = np.where(number, _NUM, np.where(unit, _UNIT, h))
        n = len(words) - WINDOW + 1
        whole = words.doc[:n] == words.doc[WINDOW - 1 :] if n > 0 else np.zeros(0, bool)
        first = ngrams(plain, WINDOW)
        self.whole = whole
        exact = ngrams(h, WINDOW)
        self.exact_words = h

        def bare(name: np.ndarray) -> np.ndarray:
            """Which windows hold no literal."""
            literal = count((self.slot == 0) & ~name)
            return whole & (literal[WINDOW : WINDOW + len(whole)] == literal[: len(whole)])

        nothing = np.zeros(len(words), bool)
        #: The windows' hashes in each form, and those to join by; zero where the form has nothing of its own.
        self.forms, self.joined, self.bare = [first], [np.where(bare(nothing), exact ^ np.uint64(0x2545F4914F6CDD1D), first)], bare(wide | self.name)
        for name, salt in ((self.name, 0x5851F42D4C957F2D), (wide, 0x14057B7EF767814F)):
            other = ngrams(np.where(name, _NAME, plain), WINDOW)
            self.forms.append(other)
            self.joined.append(np.where((other != first) & ~bare(name), other ^ np.uint64(salt), np.uint64(0)))
        self.name = self.name | wide
        self.begin = np.searchsorted(words.doc, np.arange(len(offsets)), side="left")
        self.opens = np.flatnonzero(opens | np.concatenate([[True], words.doc[1:] != words.doc[:-1]])) if len(words) else np.zeros(0, np.int64)

    def value(self, i: int) -> bytes:
        return self.words.data[self.words.starts[i] : self.words.ends[i]].tobytes()

    def sentences(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First tokens and hashes of the sentences and lines of 1, 2, ... WINDOW - 1 tokens."""
        size = np.diff(np.append(self.opens, len(self.words)))
        for n in range(1, WINDOW):
            at = self.opens[size == n]
            yield at, ngrams(self.exact_words, n)[at] if len(at) else np.zeros(0, np.uint64)


def _hashes_of(names: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(names))
    return np.sort(Words(data, offsets).hashes())


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted table."""
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


UNIT_HASHES, NUMBER_HASHES, FUNCTION_HASHES = (_hashes_of(x) for x in (UNITS, NUMBER_WORDS, FUNCTION_WORDS))


class Index:
    """Seeds of benchmark items by hash, sorted, for each form, and the items' windows."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        t = Templates(pa.array([x for _, x in items], pa.string()))
        self.windows = np.maximum(np.diff(t.begin) - WINDOW + 1, 0)
        self.begin, self.forms, self.bare = t.begin, t.forms, t.bare
        self.slots = {int(i): (int(t.slot[i]) or 3, t.value(int(i))) for i in np.flatnonzero((t.slot > 0) | t.name)}
        self.short = {n: {} for n in range(1, WINDOW)}
        size = np.diff(t.begin)
        for i in np.flatnonzero((size > 0) & (size < WINDOW)):
            key = int(ngrams(t.exact_words[t.begin[i] : t.begin[i + 1]], int(size[i]))[0])
            self.short[int(size[i])].setdefault(key, []).append(int(i))
        # The rarest window with a literal of each group of windows of an item.
        at = np.flatnonzero(t.whole)
        item = t.words.doc[at]
        _, back, times = np.unique(t.joined[0][at], return_inverse=True, return_counts=True)
        group = (at - t.begin[item]) // GROUP
        order = np.lexsort((at, times[back], t.bare[at], group, item))
        new = np.ones(len(order), bool)
        new[1:] = (item[order][1:] != item[order][:-1]) | (group[order][1:] != group[order][:-1])
        seeds = np.sort(at[order[new]]) if len(at) else at
        self.seeds = []
        for joined in t.joined:
            own = seeds[joined[seeds] != 0]
            by = np.lexsort((own, t.words.doc[own], joined[own]))
            h, place, of = joined[own][by], own[by], t.words.doc[own][by]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            # (hash, place, item) of the first of equal seeds of an item; hashes that an item repeats.
            self.seeds.append((h[first], place[first], of[first], np.unique(h[~first])))

    def find(self, t: Templates) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item number, first and end token in the document, share of the item's windows)."""
        for n, (at, h) in enumerate(t.sentences(), 1):
            if self.short[n] and len(at):
                seen = set()
                for k in np.flatnonzero(np.isin(h, np.fromiter(self.short[n], np.uint64))):
                    doc = int(t.words.doc[at[k]])
                    for item in self.short[n][int(h[k])]:
                        if (doc, item) not in seen:
                            seen.add((doc, item))
                            start = int(at[k] - t.begin[doc])
                            yield doc, item, start, start + n, 1.0
        steps: dict[tuple[int, int], set[int]] = defaultdict(set)
        for (have, place, of, repeated), joined in zip(self.seeds, t.joined, strict=True):
            if not len(have) or not len(joined):
                continue
            at = np.flatnonzero(t.whole & (joined[: len(t.whole)] != 0) & _among(joined[: len(t.whole)], have))
            at = at[~_stretched(joined[at], at, t.words.doc[at], repeated)]
            lo, hi = np.searchsorted(have, joined[at], "left"), np.searchsorted(have, joined[at], "right")
            for d, i, j in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                doc = int(t.words.doc[d])
                for k in range(i, j):
                    steps[doc, int(of[k])].add(d - int(place[k]))
        for (doc, item), by in steps.items():
            strict, every = self._pairs(t, doc, item, sorted(by))
            for pairs in (strict, every) if len(every) > len(strict) else (strict,):
                if pairs and (row := self._held(t, item, pairs)):
                    start = int(t.begin[doc])
                    yield doc, item, row[0] - start, row[1] - start, row[2]
                    break

    def _pairs(self, t: Templates, doc: int, item: int, steps: list[int]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        """The places (document, item) where windows of both are equal in the first two forms, and in any."""
        first, n = int(self.begin[item]), int(self.windows[item])
        begin, end = int(t.begin[doc]), int(np.searchsorted(t.words.doc, doc, side="right")) - WINDOW + 1
        found: tuple[set, set] = (set(), set())
        for step in steps:
            i, j = max(first, begin - step), min(first + n, end - step)
            if i >= j:
                continue
            same = [f[i + step : j + step] == g[i:j] for f, g in zip(t.forms, self.forms, strict=True)]
            for into, hit in zip(found, (same[0] | same[1], same[0] | same[1] | same[2]), strict=True):
                into.update((int(x) + step, int(x)) for x in np.flatnonzero(hit) + i)
        for into, forms in zip(found, ((0, 1), (0, 1, 2)), strict=True):
            have = {i for _, i in into}
            rest = [i for i in range(first, first + n) if i not in have and not self.bare[i]]
            for f in forms if rest else ():
                mine = t.forms[f][begin:end]
                order = np.argsort(mine, kind="stable")
                values = self.forms[f][rest]
                lo, hi = np.searchsorted(mine[order], values, "left"), np.searchsorted(mine[order], values, "right")
                for x, i, j in zip(rest, lo.tolist(), hi.tolist(), strict=True):
                    if i < j:
                        places = order[i:j] + begin
                        into.add((int(places[int(np.argmin(_away(places - x, np.array(steps))))]), x))
        return found

    def _held(self, t: Templates, item: int, pairs: set[tuple[int, int]]) -> tuple[int, int, float] | None:
        """First and end token and share, if these pairs of windows suffice."""
        most = len({i for _, i in pairs}) / self.windows[item]
        if most < SHARE and len(pairs) < RUN - WINDOW + 1:
            return None
        votes: dict[tuple[int, bytes], Counter] = defaultdict(Counter)
        seen = {(d + o, i + o) for d, i in pairs for o in range(WINDOW) if i + o in self.slots}
        for d, i in seen:
            votes[self.slots[i]][t.value(d)] += 1
        # The item's own value wins ties, then the smallest.
        means = {k: min(v, key=lambda x: (-v[x], x != k[1], x)) for k, v in votes.items()}
        clash = {(d, i) for d, i in seen if t.value(d) != means[self.slots[i]] and (self.slots[i][0] != 4 or t.value(d) != self.slots[i][1])}
        new = {(d, i) for d, i in seen if t.value(d) != self.slots[i][1]} if clash else clash
        touches = lambda d, i, x: any((d + o, i + o) in x for o in range(WINDOW))
        good = {(d, i) for d, i in pairs if not clash or not touches(d, i, clash) or not touches(d, i, new)}
        held = {(d + o, i + o) for d, i in good for o in range(WINDOW)}
        if sum(self.slots[i][0] == 3 and t.value(d) != self.slots[i][1] for d, i in held if i in self.slots) > RENAMED * len(held):
            return None
        share = len({i for _, i in good}) / self.windows[item]
        if share >= SHARE or _longest(good) >= RUN - WINDOW + 1:
            return min(d for d, _ in good), max(d for d, _ in good) + WINDOW, share
        return None


def _stretched(h: np.ndarray, at: np.ndarray, doc: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which windows (hash, place, document) an item repeats and the document had at most 2 WINDOW places before."""
    out = np.zeros(len(h), bool)
    if not len(h) or not len(repeated):
        return out
    order = np.lexsort((at, doc, h))
    close = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (at[order][1:] - at[order][:-1] <= 2 * WINDOW)
    out[order[1:]] = close
    return out & _among(h, repeated)


def _away(values: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How far each value is from the nearest of some sorted steps."""
    at = np.searchsorted(steps, values)
    return np.minimum(np.abs(values - steps[np.maximum(at - 1, 0)]), np.abs(values - steps[np.minimum(at, len(steps) - 1)]))


def _longest(pairs: set[tuple[int, int]]) -> int:
    best = 0
    for d, i in pairs:
        if (d - 1, i - 1) not in pairs:
            n = 1
            while (d + n, i + n) in pairs:
                n += 1
            best = max(best, n)
    return best


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and item it holds: id_col, item_id, start_token, end_token, share.

    Units, number words and the function words that may open a sentence are English; in other languages numbers are
    told by digits, names by capitals within a sentence, and literal windows as everywhere.
    Null and empty texts hold nothing; a null or empty item or one without identifier is never
    held. An item under WINDOW tokens is held (share 1) by a text with a sentence or line of
    just its words. Slots with equally many votes for two values take the item's own, then the
    smallest. Rows with a null identifier are reported with it. Repeated rows
    of documents or items give repeated rows. An empty table gives an empty result; other
    columns are ignored.
    """
    small_batches(df.sparkSession)
    docs = df.select(quoted(id_col).cast("long").alias("id"), quoted(text).alias("text"))
    out = None
    for index in _indices(benchmark, item_id, item_text, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1, PIECE_BYTES):
                ids, rows = b.column(0).to_pylist(), list(index.find(Templates(b.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([index.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in ((2, pa.int32()), (3, pa.int32()), (4, pa.float64())))], names=["id", "item", "start", "end", "share"])

        part = docs.mapInArrow(run, f"`{id_col}` long, item_id long, start_token int, end_token int, share double")
        out = part if out is None else out.unionByName(part)
    return out


def _indices(benchmark: DataFrame, item_id: str, item_text: str, index_bytes: int) -> Iterator[Index]:
    """The benchmark in blocks of a bounded size."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna()
    total = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = 1 + total // index_bytes
    for block in range(blocks):
        yield Index([tuple(r) for r in items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()])


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """df without the rows whose text holds an item, as leaks() tells; a map for each block of items, no shuffle.

    Rows with a null or empty text stay, as do all if the benchmark is empty; a null identifier
    doesn't matter. Repeated rows share one verdict, repeated items change nothing, an empty
    table stays empty. Columns may have any name.
    """
    small_batches(df.sparkSession)
    at, schema = df.columns.index(text), df.schema
    for index in _indices(benchmark, item_id, item_text, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, at, PIECE_BYTES):
                held = {r[0] for r in index.find(Templates(b.column(at)))}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)])) if held else b

        df = numbered(df, df.columns).mapInArrow(run, schema)
    return df


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start_token", "end_token", "share")
