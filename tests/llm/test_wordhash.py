import re

import pyarrow as pa
import pytest

from livgrid.llm import wordhash


def plain(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
@pytest.mark.parametrize("k", [4, 5])
def test_shingles_equal_plain_ones(monkeypatch, segment, k):
    monkeypatch.setattr(wordhash, "SEGMENT", segment)
    texts = ["", None, "a", "A b", "b a", "ab", "a b c d e  f a b c d e", " \x0b x\ty\r\nz  ", "É é É é é", "w" * 300 + " q q q q q q q", "one two three four five six seven"]
    data, offsets = wordhash.text_buffer(pa.array(texts))
    s = wordhash.shingles(wordhash.words(data, offsets), k)
    value, first = wordhash.distinct(s)
    seen = {}
    for i, text in enumerate(texts):
        expected = plain(text, k)
        got = list(s.hash[s.first[i] : s.first[i + 1]])
        assert len(got) == len(expected) and first[i + 1] - first[i] == len(set(expected))
        for a, b in zip(expected, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_chunks_keep_every_row():
    batch = pa.record_batch({"text": pa.array(["x" * 1000] * 50 + [None, ""])})
    old, wordhash.CHUNK = wordhash.CHUNK, 5000
    try:
        parts = list(wordhash.chunks(iter([batch]), "text"))
    finally:
        wordhash.CHUNK = old
    assert len(parts) > 5 and sum(len(p) for p in parts) == 52
