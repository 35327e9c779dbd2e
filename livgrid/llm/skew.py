"""A join with a table of unique keys that no frequent key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livgrid.llm.storage import Work

#: Keys that are taken apart at most, and the fewest rows that make a key frequent.
FREQUENT_KEYS, LEAST_FREQUENT = 100_000, 1_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], work: Work, name: str, how: str = "inner") -> DataFrame:
    """left (a written table) joined with right, which has a row for a key at most.

    Keys of more than a FREQUENT_KEYSth of left's rows (and of LEAST_FREQUENT) are FREQUENT_KEYS at most, by arithmetic, so their rows of right
    can be broadcast; all other rows are joined by a shuffle, no key of which has more than that many.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > LEAST_FREQUENT)
    frequent = work.write(counts, f"{name}-frequent")
    n = frequent.count()
    if not n:
        return left.join(right, keys, how)
    if n > FREQUENT_KEYS:
        frequent = frequent.filter(F.col("__n") > left.count() // FREQUENT_KEYS)
    frequent = frequent.drop("__n")
    theirs = work.write(right.join(F.broadcast(frequent), keys, "left_semi"), f"{name}-theirs")
    often = left.join(F.broadcast(frequent), keys, "left_semi").join(F.broadcast(theirs), keys, how)
    return often.unionByName(left.join(F.broadcast(frequent), keys, "left_anti").join(right, keys, how))
