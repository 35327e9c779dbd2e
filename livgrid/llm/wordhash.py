"""Words and word shingles of whole Arrow batches as 64-bit hashes, computed with numpy.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text of at least k words has its distinct
k-word shingles; one with fewer words has the whole sequence as its one shingle; one without words has
none. A null text counts as empty. Memory is bounded: bytes are hashed in segments of SEGMENT bytes
cut at white space, and callers hand over batches of texts of at most about CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_LETTER[_SPACE] = 0
_POW = np.ones(1, np.uint64)
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        out = np.full(max(n, 2 * len(_POW)), _BASE, np.uint64)
        out[0] = 1
        _POW = np.multiply.accumulate(out)
    return _POW


def _segments(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of data of about SEGMENT bytes that end at a text's end or at white space (a longer word stays whole)."""
    at, n = 0, len(data)
    while at < n:
        end = at + SEGMENT
        if end < n:
            k = np.searchsorted(cuts, end, "right") - 1
            if k >= 0 and cuts[k] > at:
                end = int(cuts[k])
            else:
                stop = int(cuts[k + 1]) if k + 1 < len(cuts) else n
                while end < stop and not (gap := np.flatnonzero(_SPACE[data[end : min(stop, end + SEGMENT)]])).size:
                    end = min(stop, end + SEGMENT)
                if end < stop:
                    end += int(gap[0])
        yield at, min(end, n)
        at = min(end, n)


class Words(NamedTuple):
    """Of a batch of texts: each word's hash, the byte where it starts, and the first word of each text (one more at the end)."""

    hash: np.ndarray
    start: np.ndarray
    first: np.ndarray


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, end to end, and their offsets; nulls are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    hashes, starts = [], []
    for a, b in _segments(data, offsets):
        value = _LETTER[data[a:b]]
        solid = value != 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        begins[inner] = solid[inner]
        at = np.flatnonzero(begins)
        if not at.size:
            continue
        place = np.arange(at[0], b - a) - np.repeat(at, np.diff(at, append=b - a))
        place *= solid[at[0] :]
        hashes.append(mix(np.add.reduceat(value[at[0] :] * _powers(int(place.max()) + 1)[place], at - at[0])))
        starts.append(at + a)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), start, np.searchsorted(start, offsets, "left"))


class Shingles(NamedTuple):
    """Of a batch of texts: each shingle's hash, its first word, and the first shingle of each text (one more at the end)."""

    hash: np.ndarray
    word: np.ndarray
    first: np.ndarray


def shingles(w: Words, k: int) -> Shingles:
    count = np.diff(w.first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    value = np.full(len(word), _U(k), np.uint64)
    short = np.repeat(np.where(count < k, count, k), n)
    value = short.astype(np.uint64)
    for j in range(k):
        value = value * _STEP + np.where(j < short, padded[word + j], _U(0))
    return Shingles(mix(value, 1), word, first)


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about CHUNK bytes of text."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        size = np.diff(text_buffer(batch.column(column_at))[1]) + 64
        total = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
            yield batch.slice(a, b - a)
            a = b


def distinct(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by text and value, and the first of each text (one more at the end)."""
    text = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
    order = np.lexsort((s.hash, text))
    value, text = s.hash[order], text[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], np.searchsorted(text[keep], np.arange(len(s.first)), "left")
