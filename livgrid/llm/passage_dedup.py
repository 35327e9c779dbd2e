"""Substring dedup by hashing of normalised units: the earliest ranked occurrence stays, the rest is removed by its offsets.

Units are lines (of `line_words` words or more), and, for passages that stand inside longer lines or are wrapped anew, runs of words
whose ends the words themselves choose (winnowing: a word pair whose hash is the least of WINDOW neighbours; a unit is UNIT such
pieces), so that a passage has the same units wherever it stands. Words are normalised as wordhash does; white space and
case don't matter. Digests are grouped globally and ranked by doc_id, text and first word: every occurrence but the
first is a repeat, also one further on in the same text. Repeated lines are removed; so are runs of overlapping repeated word
units of RUN_WORDS words or more: with WINDOW 4, every passage of more than 50 words that stood earlier has at least that many.

Before the shuffle each batch of texts keeps the first occurrence of a digest and sends the others on as repeats, merged and under keys of
their own text. So a line or passage of all documents costs one row a batch in the task of its digest, which reads a
stream of sorted rows.

Defined cases: a null or empty text has no units; rows with a null id can't be ranked and stay as they are; rows with the same
id and different texts are ranked by a hash of the text, each one's runs are applied to its own text alone, and rows that
repeat both are treated alike; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from livgrid.llm import wordhash
from livgrid.llm.storage import Work
from livgrid.llm.wordhash import mix

WINDOW, UNIT, RUN_WORDS = 4, 4, 36
#: Slots that the hashes of texts with something to remove are dealt to; those in use are broadcast (some 20 MB at most), so that few other texts are
#: shuffled.
SLOTS = 1 << 20
#: An occurrence's place in one number: its first word, its number of words, and whether it is a line.
_WORDS_BITS = 28
_ONES = (1 << _WORDS_BITS) - 1
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def cuts(w: wordhash.Words) -> np.ndarray:
    """The words at which pieces begin, over the batch; each text's first word is one, and the number of words is the last."""
    count = np.diff(w.first)
    n = len(count)
    pad = WINDOW + 1
    # texts apart, with the largest value between them, so that no text changes another's cuts
    place = np.arange(len(w.hash)) + np.repeat(np.arange(n) * pad, count) + pad
    value = np.full(len(w.hash) + (n + 2) * pad, np.uint64(0xFFFFFFFFFFFFFFFF))
    single = np.zeros_like(value)
    single[place] = w.hash
    pairs = mix(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:], 41) >> np.uint64(1)
    inner = np.ones(len(w.hash), bool)
    inner[w.first[1:][count > 0] - 1] = False  # the last word of a text begins no pair
    value[place[inner]] = pairs[place[inner]]
    least = value.copy()
    for j in range(1, WINDOW):
        least[:-j] = np.minimum(least[:-j], value[j:])
    most = least.copy()
    for j in range(1, WINDOW):
        most[j:] = np.maximum(most[j:], least[:-j])
    chosen = (value == most)[place] & inner
    chosen[w.first[:-1][count > 0]] = True
    return np.append(np.flatnonzero(chosen), len(w.hash))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def digests(w: wordhash.Words, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Of the words from start to end each: the value of a polynomial over them, by sums from the batch's beginning."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash, 42) * _powers(_BASE, len(w.hash)), dtype=np.uint64)])
    return mix((total[end] - total[start]) * _powers(_INVERSE, len(w.hash) + 1)[start] ^ mix((end - start).astype(np.uint64), 43), salt)


def units(w: wordhash.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, text, first word in the text, and number of words of each word unit. The last unit of a text ends with it."""
    cut = cuts(w)
    if len(cut) == 1:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    text = np.searchsorted(w.first, cut[:-1], "right") - 1
    last_piece = np.searchsorted(text, text, "right")  # one past the text's last piece
    begin = np.arange(len(text))
    whole = begin + UNIT <= last_piece
    short = ~whole & (np.searchsorted(text, text, "left") == begin)  # a text of fewer pieces is one unit
    keep = np.flatnonzero(whole | short)
    end = cut[np.minimum(keep + UNIT, last_piece[keep])]
    start = cut[keep]
    return digests(w, start, end, 45), text[keep], start - w.first[text[keep]], end - start


def lines(w: wordhash.Words, data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of the lines of `least` words or more."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    line = np.searchsorted(np.flatnonzero(data == 0x0A), w.start)
    begins = np.ones(len(text), bool)
    begins[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(text))[: len(start)]
    long = end - start >= least
    start, end = start[long], end[long]
    return digests(w, start, end, 46), text[start], start - w.first[text[start]], end - start


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row")).filter("doc_id IS NOT NULL")


def _later(digest: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which occurrences are the first of their digest in a batch, and which come later (those equal to the first are neither)."""
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    several = np.zeros(len(digest), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    firsts, late = ~several, np.zeros(len(digest), bool)
    some = np.flatnonzero(several)
    some = some[np.lexsort((at[some], rows[some], ids[some], digest[some]))]
    if len(some):
        begins = np.append(True, digest[some[1:]] != digest[some[:-1]])
        head = some[np.maximum.accumulate(np.where(begins, np.arange(len(some)), 0))]
        firsts[some[begins]] = True
        late[some] = (ids[some] != ids[head]) | (rows[some] != rows[head]) | (at[some] != at[head])
    return firsts, late


def _merged(text: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping spans of a text as one."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], (start + n)[order]
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + text * far)  # texts apart
    begins = np.append(True, start[1:] + text[1:] * far >= reach[:-1]) if len(text) else np.zeros(0, bool)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(text))[: len(first)] - 1
    return text[first], start[first], reach[last] - text[first] * far - start[first]


def occurrences(docs: DataFrame, doc_id: str, text: str, line_words: int = 1, passages: bool = True) -> DataFrame:
    """key, doc_id, row (a hash of the text), at. The first occurrence of a digest, its key, in a batch of texts; and, with the complement of its
    place and a key of its own text, what is a repeat whatever the other batches hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches, "text"):
            data, offsets = wordhash.text_buffer(batch.column(1))
            w = wordhash.words(data, offsets)
            ids, rows = (np.asarray(batch.column(k)) for k in (0, 2))
            found = [(lines(w, data, line_words), 1)] + [(units(w), 0)] * passages
            out = []
            for (digest, owner, start, n), line in found:
                at = (start << (_WORDS_BITS + 1)) + (n << 1) + line
                firsts, late = _later(digest, ids[owner], rows[owner], at)
                out.append((digest[firsts].view(np.int64), ids[owner[firsts]], rows[owner[firsts]], at[firsts]))
                owner, start, n = (owner[late], start[late], n[late]) if line else _merged(owner[late], start[late], n[late])
                at = (start << (_WORDS_BITS + 1)) + (n << 1) + line
                out.append((mix(rows[owner].view(np.uint64) + (start >> 8).astype(np.uint64), 47).view(np.int64), ids[owner], rows[owner], ~at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "doc_id", "row", "at"])

    return _texts(docs, doc_id, text).mapInArrow(run, "key long, doc_id long, row long, at long")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, doc_id, row and place: the known repeats, and what comes after a key's first and isn't equal to it."""
    key = first = None
    for batch in batches:
        keys, *place = (np.asarray(c) for c in batch.columns)
        known = place[2] < 0
        out = [[place[0][known], place[1][known], ~place[2][known]]]
        keys, place = keys[~known], [c[~known] for c in place]
        if len(keys):
            begins = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
            firsts = [np.where(at >= 0, c[at], 0 if first is None else first[k]) for k, c in enumerate(place)]
            late = np.logical_or.reduce([c != f for c, f in zip(place, firsts, strict=True)])
            out.append([c[late] for c in place])
            key, first = keys[-1], [f[-1] for f in firsts]
        if sum(len(o[0]) for o in out):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "row", "at"])


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", line_words: int = 1, passages: bool = True) -> DataFrame:
    """doc_id, row, first_word, end_word: lines and runs to remove, by words of the text."""
    rows = occurrences(docs, doc_id, text, line_words, passages).repartition("key").sortWithinPartitions("key", "doc_id", "row", "at").mapInArrow(_repeats, "doc_id long, row long, at long")
    begin = F.shiftright("at", _WORDS_BITS + 1)
    rows = rows.select("doc_id", "row", begin.alias("first_word"), (begin + F.shiftright("at", 1).bitwiseAND(_ONES)).alias("end_word"), (F.col("at").bitwiseAND(1) == 1).alias("line"))
    by = Window.partitionBy("doc_id", "row", "line").orderBy("first_word", "end_word")
    # a line is a run of its own; word units go on while they overlap
    reached = F.coalesce(F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("new", (F.col("first_word") >= reached).cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "row", "line", "run").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    return runs.filter(F.col("line") | (F.col("end_word") - F.col("first_word") >= RUN_WORDS)).select("doc_id", "row", "first_word", "end_word")


def removed(docs: DataFrame, work: Work, doc_id: str = "doc_id", text: str = "text", line_words: int = 1, passages: bool = True) -> DataFrame:
    """A row for each row of docs that repeats lines (of `line_words` words or more) or, if `passages`, passages: doc_id, text (what is left),
    spans (start, end: what was removed, in code points of the original, end exclusive). Other rows stay as they are."""
    runs = work.write(repeated_runs(docs, doc_id, text, line_words, passages), "runs")
    listed = runs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("first_word", "end_word"))).alias("runs"))
    slot = F.pmod("row", F.lit(SLOTS)).alias("slot")
    texts = _texts(docs, doc_id, text).withColumn("slot", slot).join(F.broadcast(runs.select(slot).distinct()), "slot", "left_semi")
    joined = texts.join(listed, ["doc_id", "row"]).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches, "text"):
            data, offsets = wordhash.text_buffer(batch.column(1))
            w = wordhash.words(data, offsets)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            lefts, spans = [], []
            for t, found in enumerate(batch.column(2).to_pylist()):
                first, last, base, stop = int(w.first[t]), int(w.first[t + 1]), int(offsets[t]), int(offsets[t + 1])
                at, left, here = base, [], []
                for r in found:
                    a = max(at, int(w.start[first + r["first_word"]]))
                    b = int(w.start[first + r["end_word"]]) if first + r["end_word"] < last else stop
                    if b <= at:
                        continue  # within what is gone already
                    left.append(data[at:a].tobytes())
                    if here and here[-1]["end"] == points[a] - points[base]:
                        here[-1]["end"] = int(points[b] - points[base])
                    else:
                        here.append({"start": int(points[a] - points[base]), "end": int(points[b] - points[base])})
                    at = b
                lefts.append(b"".join([*left, data[at:stop].tobytes()]).decode())
                spans.append(here)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lefts, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return joined.mapInArrow(run, "doc_id long, text string, spans array<struct<start: long, end: long>>")
