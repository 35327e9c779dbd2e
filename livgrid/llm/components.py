"""Connected components of a graph of pairs, over written tables: alternating large-star and small-star steps.

Each round first contracts the pairs of every partition, of about TASK_PAIRS, to a spanning forest (union-find), then
joins each node to its least neighbour. No pair reaches the driver; it learns counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livgrid.llm.storage import Work

MOST_ROUNDS = 60
#: Pairs that a task contracts at once (some 100 MB of Python).
TASK_PAIRS = 250_000


class Forest:
    """Union-find whose roots are the least nodes."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    nodes = list(forest.parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], ["a", "b"])


def contracted(pairs: DataFrame) -> DataFrame:
    """(a, b), a > b: by partition, each node and the least node that it is joined with there."""
    return pairs.select("a", "b").mapInArrow(_forest, "a long, b long")


def _least(pairs: DataFrame) -> DataFrame:
    """a, b with the least of a's neighbours and itself as m."""
    return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "a")


def components(pairs: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """node, component: the least node of its component, for each node of the pairs (a, b) but the least ones."""
    now = work.write(contracted(pairs), f"{name}-0")
    tasks = -(-now.count() // TASK_PAIRS) or 1
    now = work.write(contracted(now.repartition(tasks)), f"{name}-1")
    work.drop(f"{name}-0")
    for k in range(2, MOST_ROUNDS):
        # done when every node has one parent, and no parent has one
        open_nodes = now.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).filter("b < c").select("a").limit(1).count() or now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not open_nodes:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _least(large)
        stars = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = work.write(contracted(stars.repartition(tasks)), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError("no fixpoint")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
