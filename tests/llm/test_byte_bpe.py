import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken

from curatrix.llm.byte_bpe import Codec, byte_bpe, op8_byte_bpe

RANKS = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
TEXTS = ["", None, " ", "a", "Hello  world's\t\n end", "éêß ñ 中文 \U0001f600 " * 3, "x" * 30_000, "ab" * 5000 + " 12345", "\x00\x01 ▁▁", "  \n\n  x"]


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(other):
    for cache in (400_000, 3):
        codec = Codec(RANKS, P.PATTERN, cache)
        for t in TEXTS * 2:
            ids = codec.encode(t)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == other.encode_ordinary(t or "")
            assert codec.decode(ids) == (t or "").encode()


def test_operator(spark, other):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "a", None)] * 2, "doc_id long, text string, n_tokens int")
    rows = byte_bpe(df, RANKS, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[4] == len(other.encode_ordinary(TEXTS[4]))
    assert byte_bpe(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query(spark, sf, other):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = other.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
