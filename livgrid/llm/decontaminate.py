"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is contained in a document when the document has at least PERCENT of the item's distinct k-word shingles,
wherever they stand. Items are partitioned by size (powers of two); a partition's sketches are the bottom values of
one hash over the item's shingles, as many as an item of the partition can miss and still be contained, plus one. So a
containing document holds at least one sketch value, however long it is: all its shingles probe the sketches,
and no link is lost. A candidate's whole set is then counted, and its shingles compared word by word.

Items are read in blocks of at most about BLOCK_SHINGLES shingles; a block's index is what is broadcast, whatever the
benchmark's size, and every block meets every document.

Defined cases: a null or empty item is in no document, and a null or empty document holds none; an item with fewer than
k words is contained where its whole sequence stands; a repeated item_id or doc_id gives a pair for each row
that holds; the other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livgrid.llm import wordhash
from livgrid.llm.storage import bound_batches
from livgrid.llm.wordhash import mix

K, PERCENT = 5, 80
BLOCK_SHINGLES = 1_000_000
#: Bits of the table that most probes end at.
TABLE_BITS = 22


class Item(NamedTuple):
    item_id: int | None
    words: tuple[str, ...]


def plain_words(text: str | None) -> tuple[str, ...]:
    """Words as wordhash takes them."""
    return tuple((text or "").translate(_LOWER).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def sketch_size(n: int, percent: int) -> int:
    """Of the partition of sets of n shingles: what its largest can miss, plus one."""
    largest = (1 << n.bit_length()) - 1
    return largest - -(-percent * largest // 100) + 1


class Index:
    """The items of a block whose shingles have k words: sketches, whole sets, and the words of each shingle."""

    def __init__(self, items: list[Item], k: int, percent: int):
        self.k, self.percent = k, percent
        texts = pa.array([" ".join(i.words) for i in items], pa.string())
        w = wordhash.words(*wordhash.text_buffer(texts))
        s = wordhash.shingles(w, k)
        self.ids = [i.item_id for i in items]
        self.sets, self.words, sketches, owners = [], [], [], []
        for n, item in enumerate(items):
            own, first = np.unique(s.hash[s.first[n] : s.first[n + 1]], return_index=True)
            self.sets.append(own)
            self.words.append([item.words[j : j + k] for j in first.tolist()])
            bottom = np.argsort(mix(own, 31))[: sketch_size(len(own), percent)]
            sketches.append(own[bottom])
            owners.append(np.full(len(bottom), n))
        sketch, owner = np.concatenate(sketches), np.concatenate(owners)
        order = np.argsort(sketch, kind="stable")
        self.sketch, self.owner = sketch[order], owner[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(sketch)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, w: wordhash.Words) -> Iterator[tuple[int, int, int]]:
        """(text, item, shingles in common) of the texts that contain items."""
        s = wordhash.shingles(w, self.k)
        probe = np.flatnonzero(self.table[self._slot(s.hash)])
        value = s.hash[probe]
        lo, hi = np.searchsorted(self.sketch, value, "left"), np.searchsorted(self.sketch, value, "right")
        n = hi - lo
        if not n.sum():
            return
        text = np.repeat(np.searchsorted(s.first, probe, "right") - 1, n)
        item = self.owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        pairs = np.unique(np.stack([text, item], 1), axis=0)
        last, own, place = -1, None, None
        for t, i in pairs.tolist():
            if t != last:
                last = t
                own, place = np.unique(s.hash[s.first[t] : s.first[t + 1]], return_index=True)
            there = np.minimum(np.searchsorted(own, self.sets[i]), len(own) - 1)
            found = np.flatnonzero(own[there] == self.sets[i])
            if 100 * len(found) < self.percent * len(self.sets[i]):
                continue
            same = sum(self._same(data, w, int(s.word[s.first[t] + place[there[j]]]), self.words[i][j]) for j in found.tolist())
            if 100 * same >= self.percent * len(self.sets[i]):
                yield t, i, same

    @staticmethod
    def _same(data: np.ndarray, w: wordhash.Words, word: int, words: tuple[str, ...]) -> bool:
        end = word + len(words)
        text = data[w.start[word] : w.start[end] if end < len(w.start) else len(data)].tobytes().decode("utf-8", "replace")
        return tuple(x for x in plain_words(text) if x)[: len(words)] == words


def _blocks(benchmark: DataFrame, item_id: str, text: str, k: int) -> Iterator[list[Item]]:
    """The items, in blocks of a bounded number of shingles."""
    bound_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * BLOCK_SHINGLES)))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        found = [Item(r["item_id"], tuple(x for x in plain_words(r["text"]) if x)) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))]
        if found := [i for i in found if i.words]:
            yield found


def _indexes(items: list[Item], k: int, percent: int) -> list[Index]:
    """An index for each length of shingle: k, and the lengths of the items that have fewer words."""
    sizes = sorted({min(k, len(i.words)) for i in items})
    return [Index([i for i in items if min(k, len(i.words)) == size], size, percent) for size in sizes]


def contained(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_common, n_item: each document with each item that it contains."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = []
    for items in _blocks(benchmark, item_id, item_text, k):
        held = spark.sparkContext.broadcast(_indexes(items, k, percent))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in wordhash.chunks(batches, "text"):
                ids, (data, offsets) = batch.column(0).to_pylist(), wordhash.text_buffer(batch.column(1))
                w = wordhash.words(data, offsets)
                if rows := [(ids[t], x.ids[i], n, len(x.sets[i])) for x in held.value for t, i, n in x.search(data, w)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "n_common", "n_item"])

        out.append(texts.mapInArrow(run, "doc_id long, item_id long, n_common long, n_item long"))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "doc_id long, item_id long, n_common long, n_item long")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose text contains no item, as they are."""
    for items in _blocks(benchmark, item_id, item_text, k):
        held = docs.sparkSession.sparkContext.broadcast(_indexes(items, k, percent))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in wordhash.chunks(batches, text):
                data, offsets = wordhash.text_buffer(batch.column(batch.schema.get_field_index(text)))
                w = wordhash.words(data, offsets)
                keep = np.ones(len(batch), bool)
                keep[[t for x in held.value for t, *_ in x.search(data, w)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
