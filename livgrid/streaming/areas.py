"""Zone areas over a growing table of cells, as a stream: the engine's one aggregate that is worth keeping up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from livgrid.operators.zones import zone_areas


def area_stream(cells: DataFrame, key: str, area: str, criteria: dict[str, Column]) -> DataFrame:
    """The same sums as the batch query, over a streaming frame (complete or update mode)."""
    return zone_areas(cells, key, area, criteria)


def keep_areas(cells: DataFrame, key: str, area: str, criteria: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Writes the areas so far to a table after each batch of new cells, until there are none."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return area_stream(cells, key, area, criteria).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
