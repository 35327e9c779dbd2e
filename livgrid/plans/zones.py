"""Queries over `lineitem` read as cells: one row a cell, the supplier's nation its municipality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.operators import zones
from livgrid.sources.tables import table

SPEC = zones.ZoneQuery(walk=10, air={"no2": 5.0}, index=2, road=65, price_layer="price", price_max=50000)


def cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice", "l_returnflag")
    su = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("commune"))
    unreachable = F.col("l_linenumber") == 7
    return li.join(su, li.l_suppkey == su.s_suppkey).select(
        "commune",
        F.col("l_quantity").cast("bigint").alias("area"),
        F.when(unreachable, zones.UNREACHABLE_S).otherwise((F.col("l_partkey") * 37) % 2400).alias("walk_a"),
        F.when(unreachable, zones.UNREACHABLE_S).otherwise((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 211) % 2400).alias("walk_b"),
        F.round(F.col("l_tax") * 1000).cast("int").alias("no2"),
        (F.col("l_linenumber") % 4).alias("index"),
        F.when(F.col("l_partkey") % 11 == 0, 0).otherwise(40 + 5 * (F.col("l_partkey") % 8)).alias("road"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(F.floor("l_extendedprice")).cast("int").alias("price"),
    )


CELLS_SQL = """
cells AS (SELECT s_nationkey AS commune, CAST(l_quantity AS BIGINT) AS area,
  CASE WHEN l_linenumber = 7 THEN 65535 ELSE (l_partkey * 37) % 2400 END AS walk_a,
  CASE WHEN l_linenumber = 7 THEN 65535 ELSE (l_suppkey * 53 + l_linenumber * 211) % 2400 END AS walk_b,
  CAST(round(l_tax * 1000) AS INT) AS no2, l_linenumber % 4 AS idx,
  CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE 40 + 5 * (l_partkey % 8) END AS road,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(floor(l_extendedprice) AS INT) END AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
tests AS (SELECT *, least(walk_a, walk_b) <= 629 AS walk, no2 <= 50.5 AS air, idx <= 2 AS bp, road < 65 AS rt, price <= 50000 AS pr FROM cells),
areas AS (SELECT commune, CAST(sum(area) AS BIGINT) AS total,
  CAST(sum(CASE WHEN walk AND air AND bp AND rt AND pr THEN area ELSE 0 END) AS BIGINT) AS ok,
  CAST(sum(CASE WHEN walk THEN area ELSE 0 END) AS BIGINT) AS c_walk, CAST(sum(CASE WHEN air THEN area ELSE 0 END) AS BIGINT) AS c_air,
  CAST(sum(CASE WHEN bp THEN area ELSE 0 END) AS BIGINT) AS c_index, CAST(sum(CASE WHEN rt THEN area ELSE 0 END) AS BIGINT) AS c_road,
  CAST(sum(CASE WHEN pr THEN area ELSE 0 END) AS BIGINT) AS c_price FROM tests GROUP BY commune)"""


def _criteria(frame: DataFrame):
    return SPEC.criteria(zones.best_time({"a": F.col("walk_a"), "b": F.col("walk_b")}), frame.columns)


def zone_stats(spark: SparkSession, d: str) -> DataFrame:
    frame = cells(spark, d)
    return zones.zone_areas(frame, "commune", "area", _criteria(frame))


def zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    return zones.rollup_areas(zone_stats(spark, d), ["walk", "air", "index", "road", "price", "dest"])


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    frame = cells(spark, d)
    return frame.select("commune", F.array_join(zones.exclusion_reasons(_criteria(frame)), ",").alias("reasons")).groupBy("commune", "reasons").agg(F.count("*").alias("n"))


def network_min(spark: SparkSession, d: str) -> DataFrame:
    frame = cells(spark, d)
    best = zones.best_station({"a": (F.col("walk_a"), F.lit("A")), "b": (F.col("walk_b"), F.lit("B"))})
    return frame.select("commune", best.alias("b")).groupBy("commune", F.col("b.station").alias("station")).agg(F.count("*").alias("n"), F.sum("b.time").alias("seconds"))


QUERIES = {"zone_stats": zone_stats, "zone_rollup": zone_rollup, "exclusion_reasons": exclusion_reasons, "network_min": network_min}

_PCT = ", ".join(f"CAST((200 * {c} + total) // (2 * total) AS BIGINT) AS pct_{n}" for c, n in [("ok", "ok"), *((f"c_{k}", k) for k in ("walk", "air", "index", "road", "price", "dest"))])
ORACLES = {
    "zone_stats": f"WITH {CELLS_SQL} SELECT * FROM areas",
    "zone_rollup": f"""WITH {CELLS_SQL}, t AS (SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(c_walk) AS BIGINT) AS c_walk,
  CAST(sum(c_air) AS BIGINT) AS c_air, CAST(sum(c_index) AS BIGINT) AS c_index, CAST(sum(c_road) AS BIGINT) AS c_road, CAST(sum(c_price) AS BIGINT) AS c_price,
  CAST(sum(total) AS BIGINT) AS c_dest FROM areas) SELECT *, {_PCT} FROM t""",
    "exclusion_reasons": f"""WITH {CELLS_SQL} SELECT commune, concat_ws(',', CASE WHEN NOT walk THEN 'walk' END, CASE WHEN NOT air THEN 'air' END, CASE WHEN NOT bp THEN 'index' END,
  CASE WHEN NOT rt THEN 'road' END, CASE WHEN NOT pr THEN 'price' END) AS reasons, count(*) AS n FROM tests GROUP BY ALL""",
    "network_min": f"""WITH {CELLS_SQL} SELECT commune, CASE WHEN least(walk_a, walk_b) = 65535 THEN NULL WHEN walk_a <= walk_b THEN 'A' ELSE 'B' END AS station, count(*) AS n,
  CAST(sum(CASE WHEN least(walk_a, walk_b) < 65535 THEN least(walk_a, walk_b) END) AS BIGINT) AS seconds FROM cells GROUP BY ALL""",
}
