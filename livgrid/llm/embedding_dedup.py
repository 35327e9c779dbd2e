"""Near-duplicate vectors by cosine: a navigable small-world graph per shard, every shard queried, links verified.

Vectors are compared only within a label (and length). Equal vectors are one class with a count, so copies
are never paired. A label's classes are dealt to shards of about SHARD; each shard's graph is built once, in a task, and
written. Every shard is queried by all classes of the label, by a task for about QUERIES of them. A sample of
every block of queries is audited against brute force over the shard: while less than LEAST_RECALL of its links
is found, the beam doubles and the block is asked again, up to the whole shard. Found pairs are verified by cosine
in double precision. A task emits each query's number of links, the recall of its audit, and a spanning forest of the links.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id, link
with nothing and are their own component; every row counts as a vector, repeated ones too; other columns aren't read; vectors whose
squares would overflow or vanish are scaled by a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livgrid.llm.components import Forest, components
from livgrid.llm.hnsw import Hnsw
from livgrid.llm.skew import join_unique
from livgrid.llm.storage import Work
from livgrid.llm.wordhash import mix

SHARD, QUERIES = 8_192, 1_024
BLOCK, AUDIT, BEAM, LEAST_RECALL = 512, 64, 32, 0.999
#: Labels (and lengths) whose sizes are broadcast at most.
BROADCAST_LABELS = 100_000


def scaled(raw: np.ndarray) -> np.ndarray:
    """The vectors in double precision, each times the power of two that brings its largest component near one."""
    raw = raw.astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


class Shard:
    """A shard's graph (built, or of the links of one that was), with its classes' ids and counts."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, counts: np.ndarray, least: float, links: list[list[np.ndarray]] | None = None):
        self.ids, self.counts, self.least = ids, counts, least
        self.raw = scaled(raw)
        self.norm = np.linalg.norm(self.raw, axis=1)
        unit = self.raw / self.norm[:, None]
        self.graph = Hnsw(unit, ids) if links is None else Hnsw.of(unit, links)
        self.beam = BEAM
        self.recalls: list[float] = []

    def ask(self, ids: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """The shard's rows that link with each query, itself left out."""
        raw = scaled(raw)
        norm = np.linalg.norm(raw, axis=1)
        unit = raw / norm[:, None]
        slack = self.least - 1e-9  # the last digits are left to the verification
        sample = np.argsort(mix(ids.astype(np.int64).view(np.uint64), 62))[:AUDIT]
        true = unit[sample] @ self.graph.x.T >= slack
        while True:
            got = {int(i): self.graph.within(unit[i], slack, self.beam) for i in sample}
            hit = sum(int(true[k, got[int(i)]].sum()) for k, i in enumerate(sample))
            recall = hit / true.sum() if true.any() else 1.0
            if recall >= LEAST_RECALL or self.beam >= len(self.ids):
                break
            self.beam *= 2
        self.recalls.append(recall)
        out = []
        for i in range(len(ids)):
            near = got[i] if i in got else self.graph.within(unit[i], slack, self.beam)
            near = near[self.ids[near] != ids[i]]
            out.append(near[self.raw[near] @ raw[i] / (self.norm[near] * norm[i]) >= self.least])
        return out


def _graphs(least: float):
    """Of rows (task, node, copies, vector, parts) sorted by the first two: the same with each node's neighbours by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def built() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            nodes, copies, vectors, parts = (list(c) for c in zip(*held, strict=True))
            links = Shard(np.array(nodes, np.int64), np.stack(vectors), np.array(copies), least).graph.links
            for a in range(0, len(nodes), 1024):
                own = slice(a, a + 1024)
                arrays = [[task] * len(nodes[own]), nodes[own], copies[own], vectors[own], parts[own], [[level.tolist() for level in x] for x in links[own]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int64(), pa.int64(), pa.int64(), kind, pa.int64(), pa.list_(pa.list_(pa.int32()))), strict=True)], ["task", "node", "copies", "v", "parts", "links"])

        for batch in batches:
            kind = batch.column(3).type
            tasks, nodes, copies, parts = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            value, offsets = np.asarray(batch.column(3).values), np.asarray(batch.column(3).offsets)
            for k, t in enumerate(tasks):
                if t != task:
                    yield from built()
                    task, held = t, []
                held.append((nodes[k], copies[k], value[offsets[k] : offsets[k + 1]].copy(), parts[k]))
        yield from built()

    return run


def _search(least: float):
    """Of rows (task, asks, node, copies, vector, links) sorted by the first three, a shard and then its queries: (a, b, n, recall). b null: n links of a;
    else a link of the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asking = None, False
        held: list[tuple] = []  # the shard's rows, then the queries of a block
        shard: Shard | None = None
        forest = Forest()

        def rows(a, b, n, recall) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(recall, pa.float64())], ["a", "b", "n", "recall"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if not held or asking and shard is None:  # hashing left the shard without vectors
                held.clear()
                return
            ids, raw = np.array([h[0] for h in held], np.int64), np.stack([h[2] for h in held])
            if not asking:
                links = [[np.array(level, np.int64) for level in h[3]] for h in held]
                shard = Shard(ids, raw, np.array([h[1] for h in held], np.int64), least, links)
            else:
                found = shard.ask(ids, raw)
                for q, near in zip(ids.tolist(), found, strict=True):
                    for j in shard.ids[near].tolist():
                        forest.union(q, j)
                yield rows(ids, [None] * len(ids), [int(shard.counts[near].sum()) for near in found], [shard.recalls[-1]] * len(ids))
            held.clear()

        def linked() -> Iterator[pa.RecordBatch]:
            if nodes := list(forest.parent):
                yield rows(nodes, [forest.find(x) for x in nodes], [0] * len(nodes), [None] * len(nodes))

        for batch in batches:
            tasks, asks, nodes, copies, links = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            value, offsets = np.asarray(batch.column(4).values), np.asarray(batch.column(4).offsets)
            for k in range(len(tasks)):
                if tasks[k] != task or asks[k] != asking or asking and len(held) >= BLOCK:
                    yield from flush()
                    if tasks[k] != task:
                        yield from linked()
                        task, shard, forest = tasks[k], None, Forest()
                    asking = asks[k]
                held.append((nodes[k], copies[k], value[offsets[k] : offsets[k + 1]].copy(), links[k]))
        yield from flush()
        yield from linked()

    return run


def links(vectors: DataFrame, work: Work, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", audits: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; with `audits` also recall, the least of the audits of the searches for the vector."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    v = v.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False)))
    v = v.select("vec_id", "v", "label", "ok", F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2"))
    classes = v.filter("ok").groupBy("label", F.size("v").alias("size"), "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = work.write(classes, "classes")
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("n")).select("label", "size", F.ceil(F.col("n") / SHARD).alias("shards"), F.ceil(F.col("n") / QUERIES).alias("parts"))
    dealt = classes.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes, ["label", "size"])
    shard, part = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("shards")), F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts"))
    task = lambda s: F.xxhash64("label", "size", s)
    series = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    kind = v.schema["v"].dataType.simpleString()
    indexed = dealt.select(task(shard).alias("task"), "node", "copies", "v", "parts").repartition("task").sortWithinPartitions("task", "node")
    graphs = work.write(indexed.mapInArrow(_graphs(least), f"task long, node long, copies long, v {kind}, parts long, links array<array<int>>"), "graphs")
    meets = lambda t, p: F.xxhash64(t, p)
    rows = graphs.select(F.explode(F.transform(series("parts"), lambda p: meets(F.col("task"), p))).alias("task"), F.lit(False).alias("asks"), "node", "copies", "v", "links")
    asked = dealt.select(F.explode(F.transform(series("shards"), lambda s: meets(task(s), part))).alias("task"), F.lit(True).alias("asks"), "node", "copies", "v", F.lit(None).cast("array<array<int>>").alias("links"))
    rows = rows.union(asked).repartition("task").sortWithinPartitions("task", "asks", "node")
    found = work.write(rows.mapInArrow(_search(least), "a long, b long, n long, recall double"), "found")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"), F.min("recall").alias("recall"))
    comp = components(found.filter("b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), work)
    of = classes.join(counts, "node", "left").join(comp, "node", "left")
    of = work.write(of.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"), F.coalesce("recall", F.lit(1.0)).alias("recall")), "of")
    vectors_ = work.write(v.filter("ok").select("vec_id", "k1", "k2"), "keys")
    linked = join_unique(vectors_, of, ["k1", "k2"], work, "of").select("vec_id", "n_links", "component_id", "recall")
    lone = v.filter("NOT ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1.0).alias("recall"))
    out = linked.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out if audits else out.drop("recall")
