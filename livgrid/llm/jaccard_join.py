"""Exact n-gram Jaccard self-join of documents and the components of its links: a size-aware heavy-light join.

A document's set is its distinct k-word shingles (64-bit hashes, see wordhash). Equal sets are one set from the start,
named by a 64-bit digest. Sets a and b link when 100 |a & b| >= PERCENT |a | b|.

Light sets, up to a boundary, enumerate their subsets of every size that a partner's overlap can have: two that
link share the subset that is their overlap. Heavy sets go into inverted lists: classes of sizes (a partner is
in the same class or the next) have a number of parts, one more than the shingles in which two linking sets
of the class can differ, and some to spare; shingles are dealt to parts by hash, and a set is listed under each part's
content. By the pigeonhole principle two linking sets share more parts than there are to spare. Weak parts (of no or
one shingle; of none where sets are small) aren't listed; a set with more of them than there are to spare is listed
again under further seeds, and in the end under each shingle. A list holds sets that agree on a whole part,
several shingles from all over the text: a frequent shingle, line or passage alone makes hardly any list.
The boundary is that with the least rows by the sizes found.

Lists are read as a stream of sorted rows. Each set is first verified against the least member of its lists (one
shuffled set each, hot centres salted). Lists whose members are then in several components, and lists of two not
verified yet, are joined to groups by common members; in each group the sets outside its largest component are
compared with each other and with it, in blocks of BLOCK sets (fewer if they are large), by counting overlaps along inverted lists
of shingles. (Where that would ship more sets than going by the lists' least members, lists with one least member are compared on
their own.) Bitmaps of the sets go first, an exact bound of how much two sets differ; whole sets follow where it leaves a link
possible. So groups of copies cost their rows, never their pairs, and no link between different sets is lost.

Defined cases: a null or empty text, or a null id, links with nothing and is its own component; fewer words than k make
one shingle of the whole sequence; every row gives a row, repeated ones too.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from livgrid.llm import wordhash
from livgrid.llm.components import Forest, components
from livgrid.llm.skew import join_unique
from livgrid.llm.storage import Work
from livgrid.llm.wordhash import mix

#: Sets of a block, and how many shingles count as a set there: larger sets count as several, so that a block's memory is bounded (some 16 MB).
BLOCK, SET_SHINGLES = 512, 4_096
#: Members of one centre that a task verifies (more where there would be over STARS tasks); ids that are broadcast at most (some 20 MB).
STAR, STARS, BROADCAST_IDS = 400, 1_000_000, 250_000
SEEDS = 4
#: Sets whose keys a task has listed already and doesn't list again.
REMEMBERED = 500_000
#: The largest size for which subsets are considered.
MOST_LIGHT = 24


class Measure(NamedTuple):
    """Words of a shingle, and the least similarity in percent."""

    k: int = 4
    percent: int = 85

    def overlap(self, total: int) -> int:
        """The least overlap of two linking sets whose sizes add up to total."""
        return -(-self.percent * total // (100 + self.percent))

    def deletions(self, size: int) -> int:
        """How many shingles of a set can be outside its overlap with a partner."""
        return size - -(-self.percent * size // 100)

    def differ(self, size: int) -> int:
        """In how many shingles two linking sets of at most this size can differ."""
        return max(t - 2 * self.overlap(t) for t in range(max(1, 2 * size - 3), 2 * size + 1))

    def partner(self, size: int) -> int:
        """The largest partner's size."""
        return 100 * size // self.percent


class Instance(NamedTuple):
    number: int
    least: int
    most: int
    parts: int
    spare: int
    strong: int


@lru_cache(64)
def instance(measure: Measure, boundary: int, number: int) -> Instance:
    """The class of sizes of that number above the boundary. Its parts serve its own pairs and those with the class below."""
    least, before = boundary + 1, boundary + 1
    for _ in range(number):
        before, least = least, measure.partner(least) + 1
    most = measure.partner(least)
    differ = measure.differ(most)
    for strong in (2, 1):
        for spare in range(1, 2 * differ + 9):  # enough that most sets of the smallest size that uses it have no more weak parts
            parts = differ + 1 + spare
            mean = before / parts
            weak = parts * math.exp(-mean) * (1 + mean * (strong == 2))
            if spare >= weak + 1.5 * math.sqrt(weak):
                return Instance(number, least, most, parts, spare, strong)
    return Instance(number, least, most, differ + 4, 3, 1)


def class_of(measure: Measure, boundary: int, sizes: np.ndarray) -> np.ndarray:
    """The class of each size; -1 for light ones."""
    edges = [boundary + 1]
    top = int(sizes.max(initial=0))
    while edges[-1] <= top:
        edges.append(measure.partner(edges[-1]) + 1)
    return np.searchsorted(np.array(edges), sizes, "right") - 1


def subsets(measure: Measure, size: int) -> int:
    return sum(math.comb(size, j) for j in range(measure.deletions(size) + 1))


def choose_boundary(measure: Measure, histogram: dict[int, int]) -> int:
    """The boundary with the fewest rows listed, by the number of sets of each size up to MOST_LIGHT."""

    def cost(x: int) -> float:
        rows = sum(n * subsets(measure, s) for s, n in histogram.items() if 0 < s <= measure.partner(x))
        for s, n in histogram.items():
            if s > x:
                i = int(class_of(measure, x, np.array([s]))[0])
                rows += n * sum(min(s, instance(measure, x, j).parts) for j in (i, i + 1))
        return rows

    return min(range(5, MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _sets(batch: pa.RecordBatch, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: all distinct shingles, the first of each text, and each set's digest."""
    data, offsets = wordhash.text_buffer(batch.column(batch.schema.get_field_index(column)))
    value, first = wordhash.distinct(wordhash.shingles(wordhash.words(data, offsets), k))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value, 7), dtype=np.uint64)])
    return value, first, mix(total[first[1:]] - total[first[:-1]], 8) ^ np.diff(first).astype(np.uint64)


def measured(docs: DataFrame, measure: Measure, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, d (the set's digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches, "text"):
            _, first, digest = _sets(batch, "text", measure.k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first).astype(np.int64)), pa.array(digest.view(np.int64))], ["doc_id", "row", "n_shingles", "d"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row")).mapInArrow(run, "doc_id long, row long, n_shingles long, d long")


def _light_keys(measure: Measure, value: np.ndarray) -> np.ndarray:
    """A key for each subset that can be the overlap with a partner: all sums of the set's mixed hashes without some of them."""
    mixed = mix(value, 11)
    total, n = mixed.sum(dtype=np.uint64), len(value)
    out = []
    for j in range(measure.deletions(n) + 1):
        left = np.array([0], np.uint64) if j == 0 else np.array([mixed[list(c)].sum(dtype=np.uint64) for c in itertools.combinations(range(n), j)], np.uint64)
        out.append(mix(total - left, 100 + n - j))
    return np.concatenate(out)


def _part_keys(value: np.ndarray, text: np.ndarray, which: np.ndarray, of: Instance, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the strong parts, their texts, and the number of such parts of each text."""
    part = (mix(value, 20_000 + 16 * of.number + seed) % np.uint64(of.parts)).astype(np.int64)
    place = text * of.parts + part
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    content = np.add.reduceat(mix(value, 12)[order], starts) if len(starts) else np.zeros(0, np.uint64)
    strong = np.diff(np.append(starts, len(place))) >= of.strong
    starts, content = starts[strong], content[strong]
    place = place[starts]
    key = mix(content ^ mix((place % of.parts).astype(np.uint64), 1_000 + 16 * of.number + seed), 13)
    return key, place // of.parts, np.bincount(place // of.parts, minlength=len(which))


def list_keys(measure: Measure, boundary: int, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the text of each, for the sets of a batch."""
    size = np.diff(first)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero((size > 0) & (size <= measure.partner(boundary))):
        keys.append(own := _light_keys(measure, value[first[i] : first[i + 1]]))
        owners.append(np.full(len(own), i))
    of_class = class_of(measure, boundary, size)
    for number in range(int(of_class.max(initial=-1)) + 2):
        of = instance(measure, boundary, number)
        which = np.flatnonzero((of_class >= 0) & ((of_class == number) | (of_class == number - 1)))
        for seed in range(SEEDS):
            if not len(which):
                break
            n = size[which]
            start = np.repeat(first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            values = value[start + np.arange(int(n.sum()))]
            key, owner, full = _part_keys(values, np.repeat(np.arange(len(which)), n), which, of, seed)
            keys.append(key)
            owners.append(which[owner])
            which = which[of.parts - full > of.spare]
        for i in which:  # too many weak parts under every seed: each shingle is a key
            keys.append(own := mix(value[first[i] : first[i + 1]], 50_000 + number))
            owners.append(np.full(len(own), i))
    return np.concatenate(keys), np.concatenate(owners)


def listed(docs: DataFrame, measure: Measure, boundary: int, doc_id: str, text: str) -> DataFrame:
    """key, d: every set under its keys, each set once a task while it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in wordhash.chunks(batches, "text"):
            value, first, digest = _sets(batch, "text", measure.k)
            if len(seen) > REMEMBERED:
                seen.clear()
            new = np.zeros(len(digest), bool)
            for i, d in enumerate(digest.tolist()):
                if d not in seen:
                    seen.add(d)
                    new[i] = True
            size = np.where(new, np.diff(first), 0)
            value = value[np.repeat(new, np.diff(first))]
            key, owner = list_keys(measure, boundary, value, np.concatenate([[0], np.cumsum(size)]))
            for a in range(0, len(key), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 18)].view(np.int64)), pa.array(digest[owner[a : a + (1 << 18)]].view(np.int64))], ["key", "d"])

    return docs.filter(F.col(doc_id).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "key long, d long")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, d) sorted by both: key, d, centre of the lists with several members, as a stream."""
    last_key = last_d = centre = None
    alone = False  # the last row is the first of its list and not given yet
    for batch in batches:
        key, d = (np.asarray(c) for c in batch.columns)
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
        fresh[0] = last_key is None or key[0] != last_key or d[0] != last_d
        key, d = key[fresh], d[fresh]
        if not len(key):
            continue
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        begins[0] = last_key is None or key[0] != last_key
        at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        centres = np.where(at >= 0, d[at], 0 if centre is None else centre)
        followed = np.append(key[1:] == key[:-1], False)
        keep = ~begins | followed
        out_key, out_d, out_c = key[keep], d[keep], centres[keep]
        if alone and not begins[0]:
            out_key, out_d, out_c = np.append(out_key, last_key), np.append(out_d, last_d), np.append(out_c, last_d)
        last_key, last_d, centre, alone = key[-1], d[-1], centres[-1], bool(begins[-1])
        if len(out_key):
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_d), pa.array(out_c)], ["key", "d", "centre"])


def outline(values: np.ndarray) -> np.ndarray:
    """A set's size and a bitmap of its values, of the next power of two of bits. Bits that two bitmaps differ in are values that the sets differ in."""
    bits = max(64, 1 << (len(values) - 1).bit_length())
    there = np.zeros(bits, bool)
    there[(mix(values, 71) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.concatenate([np.array([len(values)], np.uint64), np.packbits(there).view(np.uint64)])


def _with_sets(docs: DataFrame, wanted: DataFrame, measure: Measure, doc_id: str, text: str, outlines: bool = False) -> DataFrame:
    """The rows of wanted (doc_id, d, tag, to: array of long), one for each of `to`, with the sets or their outlines: to, d, tag, shingles."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    few = wanted.count() <= BROADCAST_IDS and wanted.agg(F.coalesce(F.sum(F.size("to")), F.lit(0))).first()[0] <= 2 * BROADCAST_IDS
    joined = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "d", "tag", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches, "text"):
            value, first, digest = _sets(batch, "text", measure.k)
            wanted_d, tag = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            to, rows = batch.column(3), []
            ends = [0]
            parts: list[np.ndarray] = []
            for i in np.flatnonzero(digest.view(np.int64) == wanted_d):
                own = value[first[i] : first[i + 1]]
                own = (outline(own) if outlines else own).view(np.int64)
                for target in to[int(i)].as_py():
                    rows.append((target, int(wanted_d[i]), int(tag[i])))
                    parts.append(own)
                    ends.append(ends[-1] + len(own))
                    if ends[-1] > 1 << 20:
                        yield _rows(rows, parts, ends)
                        rows, parts, ends = [], [], [0]
            if rows:
                yield _rows(rows, parts, ends)

    return joined.mapInArrow(run, "to long, d long, tag long, shingles array<long>")


def _rows(rows: list[tuple[int, int, int]], parts: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
    sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), sets], ["to", "d", "tag", "shingles"])


def _list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values).view(np.uint64), offsets


def _linked(measure: Measure, a: int, b: int, both: int) -> bool:
    return 100 * both >= measure.percent * (a + b - both)


def _stars(measure: Measure):
    """Of rows (to, own, d, shingles) sorted by star, the centre first: the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre, named, last = None, None, None, None
        for batch in batches:
            stars, ds, own = (batch.column(i).to_pylist() for i in range(3))
            value, offsets = _list_rows(batch.column(3))
            pairs = []
            for i, (s, d, is_centre) in enumerate(zip(stars, ds, own, strict=True)):
                x = value[offsets[i] : offsets[i + 1]]
                if is_centre:
                    star, centre, named, last = s, x.copy(), d, None
                elif s == star and d != last:
                    last = d
                    if _linked(measure, len(x), len(centre), int(np.count_nonzero(centre[np.minimum(np.searchsorted(centre, x), len(centre) - 1)] == x))):
                        pairs.append((max(d, named), min(d, named)))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def block_pairs(measure: Measure, sets: list[np.ndarray], comps: list[int], names: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links across components of a block's sets: overlaps are counted along inverted lists."""
    size = np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    begins = np.concatenate([[True], value[1:] != value[:-1]])
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(value))
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(begins) - 1  # the list of each shingle, in the order of the sets
    first = np.concatenate([[0], np.cumsum(size)])
    comps_of, forest, out = np.array(comps), Forest(), []
    for i in range(len(sets)):
        lists = where[first[i] : first[i + 1]]
        lists = lists[ends[lists] - starts[lists] > 1]
        if not len(lists):
            continue
        n = ends[lists] - starts[lists]
        at = np.repeat(starts[lists] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(sets))
        hits = np.flatnonzero((100 * both >= measure.percent * (size[i] + size - both)) & (comps_of != comps_of[i]))
        for j in hits[hits > i].tolist():
            if forest.union(comps[i], comps[j]):
                out.append((max(names[i], names[j]), min(names[i], names[j])))
    return out


def may_link(measure: Measure, outlines: list[np.ndarray], comps: list[int]) -> np.ndarray:
    """Which sets have one of another component that they may link with, by their outlines. No set that links is left out."""
    comp, alive = np.array(comps), np.zeros(len(outlines), bool)
    by_length: dict[int, list[int]] = {}
    for i, o in enumerate(outlines):
        by_length.setdefault(len(o) - 1, []).append(i)
    for length, own in by_length.items():
        rows = np.stack([outlines[i][1:] for i in own])
        sizes = np.array([int(outlines[i][0]) for i in own])
        for other in (length, 2 * length):
            if other not in by_length:
                continue
            theirs = by_length[other]
            bits = rows if other == length else np.stack([outlines[i][1:] for i in theirs])
            n = sizes if other == length else np.array([int(outlines[i][0]) for i in theirs])
            if other != length:  # folded to the shorter length
                bits = bits[:, :length] | bits[:, length:]
            at = np.array(theirs)
            for k, i in enumerate(own):
                start = k + 1 if other == length else 0
                total = n[start:] + sizes[k]
                most = total - 2 * -(-measure.percent * total // (100 + measure.percent))
                apart = np.bitwise_count(bits[start:] ^ rows[k]).sum(1, dtype=np.int64)
                hits = at[start:][(apart <= most) & (comp[at[start:]] != comp[i])]
                if len(hits):
                    alive[i] = True
                    alive[hits] = True
    return alive


def _grouped(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """make(block, names, components, sets) of each block of rows (to, d, component, shingles) sorted by block."""
    held: dict[int, tuple[np.ndarray, int]] = {}
    now = None

    def made() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            names = list(held)
            if rows := make(now, names, [held[n][1] for n in names], [held[n][0] for n in names]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b"])

    for batch in batches:
        to, ds, comps = (batch.column(i).to_pylist() for i in range(3))
        value, offsets = _list_rows(batch.column(3))
        for i, (t, d, c) in enumerate(zip(to, ds, comps, strict=True)):
            if t != now:
                yield from made()
                held.clear()
                now = t
            held[d] = (value[offsets[i] : offsets[i + 1]].copy(), c)
    yield from made()


def _blocks(measure: Measure):
    """The pairs (a, b) that join components."""
    return lambda batches: _grouped(batches, lambda _, names, comps, sets: block_pairs(measure, sets, comps, names))


def _alive(measure: Measure):
    """The rows (block, set) that may link across components."""
    return lambda batches: _grouped(batches, lambda block, names, comps, outlines: [(block, names[i]) for i in np.flatnonzero(may_link(measure, outlines, comps)).tolist()])


def _targets(i: str, j_count: str, name: str, ordered: bool) -> Column:
    """The blocks where block i of one side meets each of the other side's."""

    def one(j: Column) -> Column:
        pair = (F.least(F.col(i), j), F.greatest(F.col(i), j)) if ordered else (F.col(i), j) if i == "minor_block" else (j, F.col(i))
        return F.xxhash64("target", F.lit(name), *pair)

    return F.when(F.col(j_count) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(j_count) - 1), one)).otherwise(F.array().cast("array<bigint>"))


def _sizes(rows: DataFrame) -> DataFrame:
    """Of rows (target, d, component, weight): each target's largest component, the blocks of its members outside and inside it, and what meeting ships."""
    by = rows.groupBy("target", "component").agg(F.sum("weight").alias("n")).groupBy("target").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    by = by.select("target", F.col("most.component").alias("major"), F.col("most.n").alias("inside"), (F.col("n") - F.col("most.n")).alias("outside"))
    by = by.withColumn("minors", F.ceil(F.col("outside") / BLOCK)).withColumn("majors", F.ceil(F.col("inside") / BLOCK))
    return by.withColumn("rows", F.when((F.col("minors") == 1) & (F.col("majors") == 1), F.col("inside") + F.col("outside")).otherwise(F.col("outside") * (F.col("minors") + F.col("majors")) + F.col("inside") * F.col("minors")))


def _meeting(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """d, to: where each row's set goes, so that sets outside the target's largest component meet all others of it."""
    block = lambda n: F.pmod(F.xxhash64("d", F.lit(1)), F.col(n))
    one = (F.col("minors") == 1) & (F.col("majors") == 1)
    rows = rows.join(sizes, "target").withColumn("minor_block", F.when(F.col("minors") > 0, block("minors"))).withColumn("major_block", block("majors"))
    to = F.when(one, F.array(F.xxhash64("target"))).when(F.col("component") == F.col("major"), _targets("major_block", "minors", "x", False))
    to = to.otherwise(F.concat(_targets("minor_block", "minors", "m", True), _targets("minor_block", "majors", "x", False)))
    return rows.select("d", F.explode(to).alias("to"))


def _across(docs: DataFrame, postings: DataFrame, named: DataFrame, chosen: DataFrame, comp: DataFrame, work: Work, measure: Measure, doc_id: str, text: str) -> DataFrame | None:
    """The links across components within lists; None if no list has pairs left to compare."""
    of = chosen.select("d", F.col("centre").alias("chosen")).join(comp.select(F.col("node").alias("d"), "component"), "d", "full")
    rows = postings.join(of, "d", "left").withColumn("component", F.coalesce("component", "d"))
    seen = (F.col("d") == F.col("centre")) | F.coalesce(F.col("centre") == F.col("chosen"), F.lit(False))
    rows = work.write(rows.select("key", "d", "centre", "component", seen.alias("seen")), "members")
    lists = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.min("seen").alias("seen"))
    # lists with one least member are one from here on
    rows = rows.join(lists.filter("lo < hi AND (n > 2 OR NOT seen)").select("key"), "key").select("d", "centre", "component").distinct()
    rows = work.write(rows.join(named.select("d", (F.floor(F.col("n") / SET_SHINGLES) + 1).alias("weight")), "d"), "open")
    work.drop("members")
    if rows.isEmpty():
        return None
    pairs = rows.filter("d <> centre").select(F.greatest("d", "centre").alias("a"), F.least("d", "centre").alias("b"))
    group = components(pairs, work, "groups").select(F.col("node").alias("d"), F.col("component").alias("group"))
    rows = work.write(rows.join(group, "d", "left").withColumn("group", F.coalesce("group", "d")), "grouped")
    by_group, by_centre = rows.select(F.col("group").alias("target"), "d", "component", "weight").distinct(), rows.select(F.col("centre").alias("target"), "d", "component", "weight", "group")
    group_sizes, centre_sizes = work.write(_sizes(by_group), "group-sizes"), work.write(_sizes(by_centre), "centre-sizes")
    centre_group = by_centre.select("target", "group").distinct()
    shipped_by_centre = centre_sizes.join(centre_group, "target").groupBy("group").agg(F.sum("rows").alias("by_centre"))
    dear = work.write(group_sizes.join(shipped_by_centre, F.col("target") == F.col("group")).filter("rows > by_centre").select("group"), "dear")
    target = _meeting(by_group, group_sizes.join(dear.select(F.col("group").alias("target")), "target", "left_anti"))
    target = target.union(_meeting(by_centre.join(dear, "group", "left_semi").select("target", "d", "component", "weight"), centre_sizes))
    tags = named.select("d", "doc_id").join(rows.select("d", F.col("component").alias("tag")).distinct(), "d")

    def shipped(target: DataFrame, name: str, outlines: bool) -> DataFrame:
        wanted = work.write(target.groupBy("d").agg(F.collect_set("to").alias("to")).join(tags, "d").select("doc_id", "d", "tag", "to"), name)
        return _with_sets(docs, wanted, measure, doc_id, text, outlines).repartition("to").sortWithinPartitions("to", "d")

    # outlines go first, and whole sets only where outlines leave a link possible
    alive = work.write(shipped(target, "open-wanted", True).mapInArrow(_alive(measure), "a long, b long"), "alive")
    return shipped(alive.select(F.col("a").alias("to"), F.col("b").alias("d")), "alive-wanted", False).mapInArrow(_blocks(measure), "a long, b long")


def join(docs: DataFrame, work: Work, measure: Measure = Measure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row."""
    return grouped(docs, work, measure, doc_id, text).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, work: Work, measure: Measure = Measure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with row (xxhash64 of the text) and component, which tells groups apart also where rows share a doc_id; null for rows that link
    with nothing for lack of words or id."""
    sets = work.write(measured(docs, measure, doc_id, text), "sets")
    live = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    histogram = {r["n_shingles"]: r["count"] for r in live.filter(F.col("n_shingles") <= 2 * MOST_LIGHT).groupBy("n_shingles").count().collect()}
    boundary = choose_boundary(measure, histogram)
    named = work.write(live.groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "named")
    rows = listed(docs, measure, boundary, doc_id, text).repartition("key").sortWithinPartitions("key", "d")
    postings = work.write(rows.mapInArrow(_lists, "key long, d long, centre long"), "lists")

    chosen = work.write(postings.filter("d <> centre").groupBy("d").agg(F.min("centre").alias("centre")), "chosen")
    most = max(STAR, chosen.count() // STARS)
    salts = work.write(chosen.groupBy("centre").agg(F.ceil(F.count("*") / most).alias("salts")), "stars")
    star = lambda salt: F.xxhash64("centre", salt)
    member = chosen.join(salts, "centre").select("d", star(F.pmod(F.xxhash64("d", F.lit(2)), F.col("salts"))).alias("star"), F.lit(False).alias("own"))
    own = salts.select(F.col("centre").alias("d"), F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1), star)).alias("star"), F.lit(True).alias("own"))
    # the lowest bit tells centres from members, so a target is one number
    target = member.union(own).select("d", (F.shiftleft("star", 1) + F.col("own").cast("int")).alias("to"))
    wanted = work.write(target.groupBy("d").agg(F.collect_set("to").alias("to")).join(named.select("d", "doc_id"), "d").select("doc_id", "d", F.lit(0).cast("bigint").alias("tag"), "to"), "wanted")
    stars = _with_sets(docs, wanted, measure, doc_id, text).select(F.shiftrightunsigned("to", 1).alias("to"), "d", (F.col("to") % 2 != 0).alias("own"), "shingles")
    stars = stars.repartition("to").sortWithinPartitions("to", F.desc("own"), "d")
    links = work.write(stars.mapInArrow(_stars(measure), "a long, b long"), "links")
    comp = components(links, work, "near")

    more = _across(docs, postings, named, chosen, comp, work, measure, doc_id, text)
    if more is not None:
        more = work.write(more, "links-across")
        if not more.isEmpty():
            comp = components(links.union(more), work, "all")
    # by set first, then by row: very large groups and sets with very many copies are no hot keys
    of = named.select("d", "doc_id").join(comp.select(F.col("node").alias("d"), "component"), "d", "left").withColumn("component", F.coalesce("component", "d"))
    of = work.write(of, "components")
    least = work.write(of.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    of = work.write(join_unique(of.drop("doc_id"), least, ["component"], work, "least"), "named-components")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = join_unique(sets.filter(linked), of, ["d"], work, "rows").select("doc_id", "row", "n_shingles", "component_id", "component")
    lone = sets.filter(~linked).select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("component"))
    return rows.union(lone)
