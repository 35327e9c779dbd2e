"""Queries of look-ups, freshness and rebuilds: orders as files (priority the source), nations as places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.operators import catalog
from livgrid.sources.tables import table

NOW = "1998-09-01 00:00:00"
SOURCES = ("osm", "airparif", "quartiers", "dvf", "transit")


def _files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("mtime"), "o_orderpriority")
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), number)
    return o.select(source.alias("source"), F.when(source != "dvf", F.col("o_custkey").cast("string")).alias("code"), "mtime", "o_orderkey")


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return catalog.freshness(_files(spark, d), F.lit(NOW).cast("timestamp"), 500).select("source", "files", "stale", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"))


def stale_places(spark: SparkSession, d: str) -> DataFrame:
    """What to rebuild by place (customers, their orders as files), and why, when an earlier run left some."""
    codes = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("code"))
    pending = codes.filter("code IN ('1', '2')").select("code", F.when(F.col("code") == "1", F.array(F.lit("bruit"))).alias("groups"))
    stale = catalog.stale_groups(_files(spark, d), codes, F.lit(NOW).cast("timestamp"), pending, 500)
    return stale.select("code", F.array_join("groups", ",").alias("groups"), F.array_join("reasons", ",").alias("reasons"))


def outdated(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    version = lambda m, base: (F.lit(base) - F.when(F.col("k") % m == 0, 1).otherwise(0)).cast("int")
    formats = F.create_map(F.lit("grille"), version(11, 9), F.lit("transport"), version(3, 13), F.lit("air"), version(4, 9), F.lit("bruit"), version(5, 9), F.lit("destinations"), version(7, 2))
    meta = n.select(F.col("k").cast("string").alias("code"), (F.col("k") % 15).cast("int").alias("format"), F.when(F.col("k") % 6 != 5, formats).alias("formats"))
    return catalog.outdated_groups(meta).select("code", F.array_join("groups", ",").alias("groups"))


def air_range(spark: SparkSession, d: str) -> DataFrame:
    return catalog.value_range(table(spark, d, "lineitem").select(((F.col("l_partkey") * 13) % 300).alias("v")), "v")


def slider_range(spark: SparkSession, d: str) -> DataFrame:
    return catalog.value_range(table(spark, d, "part").select(F.floor("p_retailprice").alias("v")), "v")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return catalog.coverage(table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(40).alias("v")), ["l_returnflag"], "v")


def year_ticks(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return catalog.previous_of_year(dates, "month")


def reused_layers(spark: SparkSession, d: str) -> DataFrame:
    names = ("walk_rer", "station_bike_gpe20271231", "walk_dest_defense_pointe", "no2", "lden_route", "commune", "bike_tram3a", "bp_air")
    p = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("layer"))
    return catalog.reused_layers(p, catalog.groups_to_build(["transport", "air"])).groupBy("layer").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (freshness, stale_places, outdated, air_range, slider_range, coverage, year_ticks, reused_layers)}

_F = f"""f AS (SELECT {list(SOURCES)!r}[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS source, CASE WHEN substr(o_orderpriority, 1, 1) <> '4' THEN CAST(o_custkey AS VARCHAR) END AS code, CAST(o_orderdate AS TIMESTAMP) AS mtime, o_orderkey FROM orders)"""
_G = ", ".join(f"('{s}', '{g}')" for s, to in catalog.SOURCE_GROUPS.items() for g in (sorted(catalog.FORMATS) if to == "*" else [to] if to else []))
_RANGE = lambda v, source: f"""WITH s AS (SELECT {v} AS v FROM {source}), r AS (SELECT min(v) FILTER (v <> 0) AS lo, max(v) FILTER (v <> 0) AS hi FROM s)
  SELECT lo, hi, CAST(floor(lo / 5.0) * 5 AS BIGINT) AS slider_lo, CAST(CASE WHEN floor(lo / 5.0) = ceil(hi / 5.0) THEN ceil(hi / 5.0) * 5 + 5 ELSE ceil(hi / 5.0) * 5 END AS BIGINT) AS slider_hi FROM r"""  # noqa: E731
ORACLES = {
    "freshness": f"WITH {_F} SELECT source, count(*) AS files, count(*) FILTER (mtime < TIMESTAMP '{NOW}' - INTERVAL 500 DAY) AS stale, strftime(min(mtime), '%Y-%m-%d') AS oldest FROM f GROUP BY source",
    "stale_places": f"""WITH {_F}, g(source, grp) AS (VALUES {_G}), o AS (SELECT DISTINCT source, code FROM f WHERE mtime < TIMESTAMP '{NOW}' - INTERVAL 500 DAY),
  u AS (SELECT code, grp, source AS reason FROM o LEFT JOIN g USING (source) WHERE code IS NOT NULL UNION ALL SELECT CAST(c_custkey AS VARCHAR), grp, 'shared' FROM customer, (SELECT DISTINCT grp FROM o JOIN g USING (source) WHERE code IS NULL)
    UNION ALL SELECT '1', 'bruit', 'pending' UNION ALL SELECT '2', unnest(['air', 'bruit', 'destinations', 'grille', 'transport']), 'pending')
  SELECT code, coalesce(string_agg(DISTINCT grp, ',' ORDER BY grp), '') AS groups, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY code""",
    "outdated": """WITH n AS (SELECT n_nationkey AS k FROM nation), v AS (SELECT k, g, now, CASE WHEN k % 6 = 5 THEN k % 15 ELSE now - (CASE WHEN k % m = 0 THEN 1 ELSE 0 END) END AS stored
  FROM n, (VALUES ('grille', 9, 11), ('transport', 13, 3), ('air', 9, 4), ('bruit', 9, 5), ('destinations', 2, 7)) t(g, now, m)) SELECT CAST(k AS VARCHAR) AS code, string_agg(g, ',' ORDER BY g) AS groups FROM v WHERE stored < now GROUP BY k""",
    "air_range": _RANGE("(l_partkey * 13) % 300", "lineitem"),
    "slider_range": _RANGE("CAST(floor(p_retailprice) AS BIGINT)", "part"),
    "coverage": """SELECT l_returnflag, CAST(round_even(count(*) FILTER (l_partkey % 9 <> 0) * 1000 / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS coverage, count(*) FILTER (l_partkey % 9 <> 0) * 10 < count(*) * 9 AS thin FROM lineitem GROUP BY ALL""",
    "year_ticks": "WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders) SELECT month, row_number() OVER (PARTITION BY substr(month, 1, 4) ORDER BY month) = 1 AS tick FROM m",
    "reused_layers": "WITH s AS (SELECT ['walk_rer', 'station_bike_gpe20271231', 'walk_dest_defense_pointe', 'no2', 'lden_route', 'commune', 'bike_tram3a', 'bp_air'][p_partkey % 8 + 1] AS layer FROM part) SELECT layer, count(*) AS n FROM s WHERE layer IN ('lden_route', 'commune', 'bp_air') GROUP BY ALL",
}
