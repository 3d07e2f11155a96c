"""Words of Arrow string columns and their 64-bit hashes, with numpy.

Everything works on UTF-8 bytes; the white space of the word contracts is ASCII, so words
never need decoding.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


TABLES = (_table(1), _table(2))
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)


class Words:
    """The words of some texts: byte starts and ends in data, and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~IS_SPACE[data]
        first, last = word.copy(), word.copy()
        inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
        if len(data):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets[1:], self.starts, side="right")

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; which: one of two independent ones."""
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _BLOCK, side="right")))
            s, n = self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i:j]
            at = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            part = TABLES[which][self.data[self.starts[i] + np.repeat(s, n) + place]] * powers(BASES[which], int(n.max()))[place]
            out[i:j] = np.add.reduceat(part, at) + n.astype(np.uint64)
            i = j
        return mix(out)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; len(h) - n + 1 of them, also across texts."""
    count = max(0, len(h) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + h[j : j + count]
    return mix(out + np.uint64(n))


def buffers(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pa.array(column.fill_null("") if column.null_count else column).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return (TO_LOWER[data] if lower else data), offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: a reused worker otherwise keeps what an earlier task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `most` bytes of text (a longer text is a slice by itself)."""
    for b in batches:
        size = np.cumsum(np.asarray(pa.compute.binary_length(b.column(column).fill_null("")), np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i)
            i = j
    release()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - at, lengths)


import pyarrow.compute  # noqa: E402,F401  pa.compute above
