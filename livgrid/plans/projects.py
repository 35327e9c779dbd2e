"""Queries of projected lines and of the streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.operators import sections, timetable, zones
from livgrid.operators.written import shared_folder
from livgrid.plans.zones import ORACLES as ZONE_ORACLES
from livgrid.plans.zones import SPEC, cells
from livgrid.sources.tables import table
from livgrid.streaming.areas import area_stream


def section_merge(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stops, ten a line, of two operations each that share stops; every other line has a track through its first operation."""
    s = table(spark, d, "supplier").select(F.when(F.floor(F.col("s_suppkey") / 10) % 2 == 0, "métro").otherwise("tram").alias("mode"), F.floor(F.col("s_suppkey") / 10).cast("string").alias("line"), F.col("s_suppkey").cast("string").alias("stop"),
        ((F.col("s_suppkey") * 6101) % 1000).cast("double").alias("x"), ((F.col("s_suppkey") * 3571) % 1000).cast("double").alias("y"), (F.col("s_suppkey") % 4 == 0).alias("terminus"), F.col("s_suppkey").alias("k"))
    parts = F.when(F.col("k") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("k") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    stops = s.withColumn("operation", F.explode(parts)).withColumn("phase", F.lit(None).cast("string"))
    path = F.array_sort(F.collect_list(F.struct("x", "y")))
    tracks = stops.filter("operation = 'a' AND mode = 'tram'").groupBy("mode", "line", "operation", "phase").agg(path.alias("points"))
    return sections.routes(stops, tracks)


def estimated_timetable(spark: SparkSession, d: str) -> DataFrame:
    """Nations as lines, their suppliers as stops: departures with a headway of the peak and one of the rest of the day."""
    stops = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("k")).filter(F.size("k") > 1)
    runs = F.transform(F.slice("k", 2, F.size("k") - 1), lambda s: (s * 31 % 300) + F.lit(60.5))
    lines = stops.select(F.col("s_nationkey").cast("string").alias("label"), F.col("k").cast("array<string>").alias("stops"), runs.alias("runs"), (F.col("s_nationkey") * 30 + 120).alias("headway"), (F.col("s_nationkey") * 50 + 240).alias("off_peak"))
    conns = timetable.estimated_timetable(lines, (27000, 40000), (23400, 37800), 1000)
    return conns.groupBy("line", "from_stop", "to_stop").agg(F.count("*").alias("n"), F.min("dep").alias("first_dep"), F.max("arr").alias("last_arr"))


def zone_stats_stream(spark: SparkSession, d: str) -> DataFrame:
    """The zone query over cells that arrive as a stream, run to the end of what is there."""
    frame = cells(spark, d)
    at = shared_folder(spark, "stream")
    frame.write.parquet(f"{at}/cells")
    arriving = spark.readStream.schema(frame.schema).parquet(f"{at}/cells")
    areas = area_stream(arriving, "commune", "area", SPEC.criteria(zones.best_time({"a": F.col("walk_a"), "b": F.col("walk_b")}), frame.columns))
    query = areas.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/areas")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/areas")


QUERIES = {f.__name__: f for f in (section_merge, estimated_timetable, zone_stats_stream)}
_HOPS = """s AS (SELECT s_nationkey AS line, s_suppkey AS stop, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
h AS (SELECT a.line, a.stop AS a, b.stop AS b, a.i, b.stop * 31 % 300 + 60.5::DOUBLE AS run FROM s a JOIN s b ON b.line = a.line AND b.i = a.i + 1),
w AS (SELECT line, 0 AS way, a, b, i, run FROM h UNION ALL SELECT line, 1, b, a, -i, run FROM h),
o AS (SELECT *, sum(run) OVER (PARTITION BY line, way ORDER BY i) - run AS before FROM w),
t AS (SELECT line, way, 27000 - sum(run) AS t FROM w GROUP BY ALL UNION ALL SELECT line, way, t + CASE WHEN t BETWEEN 23400 AND 37800 THEN line * 30 + 120 ELSE line * 50 + 240 END AS u FROM t WHERE u <= 40000)"""
ORACLES = {
    "zone_stats_stream": ZONE_ORACLES["zone_stats"],
    "estimated_timetable": f"""WITH RECURSIVE {_HOPS} SELECT CAST(line AS VARCHAR) AS line, CAST(a AS VARCHAR) AS from_stop, CAST(b AS VARCHAR) AS to_stop, count(*) AS n,
  min(CAST(trunc(t + before) AS BIGINT)) AS first_dep, max(CAST(trunc(t + before + run) AS BIGINT)) AS last_arr FROM t JOIN o USING (line, way) GROUP BY ALL""",
}
