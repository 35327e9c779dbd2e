"""Partial and resumable rebuilds: what is to do is a table, and a place leaves it when its partitions are in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.operators import catalog
from livgrid.sources import sinks

PENDING = "code string, groups array<string>"


class Rebuild:
    """build(codes and groups as a frame) gives the layers (code, row, col, layer, value) of those places and groups."""

    def __init__(self, spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.build = spark, folder.rstrip("/"), build

    def pending(self) -> DataFrame:
        """What an earlier run left, empty at first."""
        at = f"{self.folder}/pending"
        return self.spark.read.schema(PENDING).parquet(at) if sinks.settled(self.spark, at) else self.spark.createDataFrame([], PENDING)

    def _leave(self, todo: DataFrame) -> None:
        """Writes what is pending from now on."""
        rows = [(r["code"], r["groups"]) for r in todo.select("code", "groups").collect()]  # places are a dimension: thousands at most
        sinks.swap(self.spark.createDataFrame(rows, PENDING).coalesce(1), f"{self.folder}/pending")

    def plan(self, files: DataFrame, codes: DataFrame, now, days: int = catalog.MOST_AGE_DAYS) -> DataFrame:
        """Stale groups with what is pending, and what those take along; written, so that a run that breaks off can go on."""
        todo = catalog.stale_groups(files, codes, now, self.pending(), days)
        every = F.array(*(F.lit(g) for g in sorted(catalog.FORMATS)))
        full = F.when(F.array_contains("groups", "grille"), every).when(F.array_contains("groups", "transport"), F.array_sort(F.array_union("groups", F.array(F.lit("destinations"))))).otherwise(F.col("groups"))
        self._leave(todo.select("code", full.alias("groups")))
        return self.pending()

    def run(self, at_once: int = 1) -> dict[str, str]:
        """Builds what is pending, `at_once` places a job; they leave the list when their partitions are in. Places whose build fails keep their old partitions
        and stay on the list; the result is their errors by code."""
        codes = [r["code"] for r in self.pending().select("code").orderBy("code").collect()]
        errors: dict[str, str] = {}
        for k in range(0, len(codes), at_once):
            own = codes[k : k + at_once]
            todo = self.pending()
            try:
                sinks.write_layers(self.build(todo.filter(F.col("code").isin(own))), f"{self.folder}/layers")
            except Exception as e:  # a place's sources can be unreachable or damaged; the others go on
                errors |= dict.fromkeys(own, str(e))
                continue
            self._leave(todo.filter(~F.col("code").isin(own)))
        return errors

    def backfill(self, layer_group: str, there: DataFrame) -> DataFrame:
        """Puts places on the list that were built before a layer group existed. there: code, layer_group of what is stored. Doing it again changes nothing."""
        lacking = there.select("code").distinct().join(there.filter(F.col("layer_group") == layer_group).select("code"), "code", "left_anti")
        more = lacking.select("code", F.array(F.lit(layer_group)).alias("groups"))
        every = F.array(*(F.lit(g) for g in sorted(catalog.FORMATS)))
        both = self.pending().select("code", F.coalesce("groups", every).alias("groups")).union(more)
        self._leave(both.groupBy("code").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups")))
        return self.pending()
