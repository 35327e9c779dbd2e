import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from livgrid.llm import bpe

CODER = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


def test_every_entry_is_found_by_the_perfect_hash_and_others_are_not():
    assert all(CODER.table.get(k) == v for k, v in CODER.ranks.items())
    assert len(CODER.table.keys) == len(CODER.ranks) and None not in CODER.table.keys
    assert CODER.table.get(b"no such entry \xff\xfe") is None


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library_and_decode_back(text):
    ids = CODER.encode(text)
    assert list(ids) == REAL.encode_ordinary(text) and CODER.decode(ids) == text.encode()


def test_long_unbroken_text():
    text = "ab" * 20_000 + "!" * 5000
    assert list(CODER.encode(text)) == REAL.encode_ordinary(text)


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0}, P.PATTERN)


def test_frames(spark):
    rows = [(1, "It's   a test\n", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "é😀", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = bpe.encode(df, CODER)
    assert [f.name for f in made.schema] == ["doc_id", "text", "ids", "n_tokens"]
    back = bpe.decode(made, CODER).collect()
    assert sorted((r["text"] or "").encode() for r in back) == sorted(bytes(r["decoded"]) for r in back)
    checked = bpe.encode_checked(df, CODER).collect()
    assert sorted(r["n_tokens"] for r in checked) == sorted(r["n_tokens"] for r in made.collect()) and all(r["intact"] for r in checked)
    digests = bpe.round_trip(df.select("doc_id", "text"), CODER).collect()
    assert len(digests) == 5
    for r, (_, text, _) in zip(digests, rows, strict=True):
        ids = REAL.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert bpe.round_trip(df.select("doc_id", "text").limit(0), CODER).count() == 0
