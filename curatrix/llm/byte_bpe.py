"""Byte-level BPE encoding and decoding with sentencepiece.

The rank file of a byte-level vocabulary is turned into a sentencepiece BPE model: the
protobuf is serialised here field by field, no trainer runs. Every token's bytes are mapped
one to one to printable characters; a piece's score is its negative rank, so sentencepiece's
best-score merge is the lowest-rank merge; normalisation is the identity. A text is split by
the pre-token pattern and each pre-token is encoded by itself. A pre-token that is itself a
token takes that id at once, as rank tokenizers do. Decoding maps ids back to bytes.

The work is one narrow map over the input: no shuffle. The model (about 1 MB, bounded by the
vocabulary) is broadcast; each worker keeps a bounded cache from pre-token to packed ids.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import numbered, quoted, small_batches, table
from .wordhash import pieces

#: Distinct pre-tokens that a worker remembers as the newer half; the half before it is kept too, older ones are encoded again.
CACHE = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stays, others take U+0100 and up."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank, from lines of "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece 0 is <unk>, piece i + 1 the i-th token by rank."""
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        self.by_piece = [r for _, r in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.split = regex.compile(pattern).findall
        self.mapped = {b: c for b, c in enumerate(byte_characters())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.cache_size, self.cache, self.older = cache, {}, {}

    def _learn(self, words: set[str]) -> None:
        rest = []
        for w in words:
            if (r := self.ranks.get(w.encode())) is not None:
                self.cache[w] = struct.pack("<I", r)
            else:
                rest.append(w)
        mapped = [w.encode().decode("latin-1").translate(self.mapped) for w in rest]
        for w, ids in zip(rest, self.processor.encode(mapped, out_type=int, num_threads=1), strict=True):
            self.cache[w] = struct.pack(f"<{len(ids)}I", *(self.by_piece[i - 1] for i in ids))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = self.split(text)
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in self.cache}
            if len(self.cache) + len(new) > self.cache_size:
                self.older, self.cache = self.cache, {}
                new = set(words)
            self.cache |= {w: self.older[w] for w in new if w in self.older}
            self._learn({w for w in new if w not in self.older})
            return b"".join(map(self.cache.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist() if ids else ()))


def byte_bpe(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Encode and decode the column ``text`` of every row.

    Returns the columns ``keep`` (default: all) and n_tokens long, token_ids binary (packed
    unsigned 32-bit, unless ids is False), ids_sha256, decoded_sha256 (lowercase hex) and
    round_trip boolean (decoding gave the text's bytes). A null text counts as empty: no
    token, digests of nothing. Repeated rows give repeated results, an empty table an empty
    one. Columns of df with the name of a result column are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    made = pa.schema([("n_tokens", pa.int64()), *[("token_ids", pa.binary())] * ids, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in made.names]
    given = spark.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*given.value)
        for b in pieces(batches, len(kept)):
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                packed = codec.encode(t)
                back = codec.decode(packed)
                out.append((len(packed) // 4, *[packed] * ids, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), back == (t or "").encode()))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(made), made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *cols], names=[*kept, *made.names])

    from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

    kinds = {"n_tokens": LongType(), "token_ids": BinaryType(), "round_trip": BooleanType()}
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(n, kinds.get(n, StringType())) for n in made.names)])
    return numbered(df, kept, quoted(text)).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return byte_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"], ids=False)
