"""Queries of graphs: orders as ways, parts as their nodes, line numbers as positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livgrid.operators import graph
from livgrid.sources.tables import table


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive parts of an order; of lines with one number the least part counts."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("src"), F.min("l_quantity").alias("q"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return li.withColumn("dst", F.lead("src").over(w)).filter("dst IS NOT NULL AND dst <> src").select("src", "dst", F.col("q").alias("sec"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.fastest(_steps(spark, d), []).select("src", "dst", F.col("sec").cast("bigint").alias("sec"))


def _tags() -> Column:
    kinds = ("residential", "motorway", "footway", "steps", "cycleway", "raceway")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
    return F.create_map(
        F.lit("highway"), pick(kinds, F.col("l_partkey")), F.lit("foot"), pick(("", "yes", "no", "designated"), F.col("l_suppkey")), F.lit("access"), pick(("", "private", ""), F.col("l_linenumber")),
        F.lit("bicycle"), pick(("", "yes", "no", "", ""), F.floor(F.col("l_partkey") / 7)), F.lit("oneway"), pick(("", "yes", "-1", "no"), F.floor(F.col("l_partkey") / 3)),
        F.lit("junction"), pick(("", "", "roundabout"), F.floor(F.col("l_suppkey") / 5)), F.lit("cycleway:left"), pick(("", "", "", "opposite_lane"), F.floor(F.col("l_suppkey") / 3)),
    )


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct().withColumn("tags", _tags())


def way_rules_walk(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select(F.col("tags")["highway"].alias("highway"), graph.walkable(F.col("tags")).alias("ok")).groupBy("highway", "ok").agg(F.count("*").alias("n"))


def way_rules_bike(spark: SparkSession, d: str) -> DataFrame:
    f = _flags(spark, d).select(F.col("tags")["highway"].alias("highway"), graph.cycling(F.col("tags")).alias("r"))
    return f.groupBy("highway", F.col("r.speed").cast("bigint").alias("speed"), F.col("r.direction").cast("bigint").alias("direction")).agg(F.count("*").alias("n"))


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0.0, 1), (2, 0.0, 2)], "node long, cost double, source long")


def shortest_path_hops(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within four steps of two sources."""
    edges = graph_edges(spark, d).select("src", "dst", F.lit(1.0).alias("sec"))
    return graph.shortest_paths(edges, _sources(spark), 4.0).select("node", F.col("dist").cast("bigint").alias("hops"), "source")


def shortest_path_weighted(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d).select("src", "dst", F.col("sec").cast("double").alias("sec"))
    return graph.shortest_paths(edges, _sources(spark), 30.0).select("node", F.col("dist").cast("bigint").alias("dist"), "source")


def shortest_path_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The same by a heap in one task a group. Groups are copies of the graph: from both sources, and from either alone."""
    copies = F.explode(F.array(*(F.lit(g).cast("bigint") for g in range(3)))).alias("g")
    edges = graph_edges(spark, d).select(copies, "src", "dst", F.col("sec").cast("double").alias("sec"))
    sources = _sources(spark).select(copies, "node", "cost", "source").filter("g = 0 OR g = source")
    return graph.grouped_paths(edges, sources, ["g"], 30.0).select("g", "node", F.col("dist").cast("bigint").alias("dist"), "source")


def door_to_door(spark: SparkSession, d: str) -> DataFrame:
    """The least of a start cost and the way, within four steps: sources start with the cost of their transit."""
    edges = graph_edges(spark, d).select("src", "dst", F.lit(1.0).alias("sec"))
    accesses = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "node long, station long")
    transit = spark.createDataFrame([(10, 2.0), (20, 0.0), (30, None)], "station long, cost double")
    start = graph.source_costs(accesses, transit, "station", "cost").select("node", "cost", F.col("station").alias("source"))
    return graph.shortest_paths(edges, start, 4.0).select("node", F.col("dist").cast("bigint").alias("time"), "source")


def strongly_connected(spark: SparkSession, d: str) -> DataFrame:
    return graph.main_component(graph_edges(spark, d).select("src", "dst"))


QUERIES = {f.__name__: f for f in (graph_edges, way_rules_walk, way_rules_bike, shortest_path_hops, shortest_path_weighted, shortest_path_grouped, door_to_door, strongly_connected)}

_E = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS src, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
st AS (SELECT src, lead(src) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS dst, q FROM li),
e AS MATERIALIZED (SELECT src, dst, CAST(min(q) AS BIGINT) AS sec FROM st WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL)"""
_W = """f AS (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem),
t AS (SELECT ['residential', 'motorway', 'footway', 'steps', 'cycleway', 'raceway'][l_partkey % 6 + 1] AS hw, ['', 'yes', 'no', 'designated'][l_suppkey % 4 + 1] AS foot, ['', 'private', ''][l_linenumber % 3 + 1] AS acc,
  ['', 'yes', 'no', '', ''][l_partkey // 7 % 5 + 1] AS bi, ['', 'yes', '-1', 'no'][l_partkey // 3 % 4 + 1] AS ow, ['', '', 'roundabout'][l_suppkey // 5 % 3 + 1] AS ju, ['', '', '', 'opposite_lane'][l_suppkey // 3 % 4 + 1] AS cl FROM f)"""
_HOPS = lambda start: f"""WITH RECURSIVE {_E}, r AS (SELECT node, hops, source FROM (VALUES {start}) v(node, hops, source) UNION SELECT e.dst, r.hops + 1, r.source FROM r JOIN e ON e.src = r.node WHERE r.hops < 4),
  m AS (SELECT node, min(hops * 1000 + source) AS k FROM r GROUP BY ALL)"""  # noqa: E731
_DIST = f"""WITH RECURSIVE {_E}, r AS (SELECT g, node, dist, source FROM (VALUES (0, 1::BIGINT, 0::BIGINT, 1), (0, 2, 0, 2), (1, 1, 0, 1), (2, 2, 0, 2)) v(g, node, dist, source)
  UNION SELECT r.g, e.dst, r.dist + e.sec, r.source FROM r JOIN e ON e.src = r.node WHERE r.dist + e.sec <= 30), m AS (SELECT g, node, min(dist * 1000 + source) AS k FROM r GROUP BY ALL)"""
_REACH = lambda name, a, b: f"{name} AS (SELECT node FROM s UNION SELECT e.{b} FROM {name} JOIN e ON e.{a} = {name}.node)"
ORACLES = {
    "shortest_path_weighted": f"{_DIST} SELECT node, CAST(k // 1000 AS BIGINT) AS dist, CAST(k % 1000 AS BIGINT) AS source FROM m WHERE g = 0",
    "shortest_path_grouped": f"{_DIST} SELECT CAST(g AS BIGINT) AS g, node, CAST(k // 1000 AS BIGINT) AS dist, CAST(k % 1000 AS BIGINT) AS source FROM m",
    "strongly_connected": f"""WITH RECURSIVE {_E}, d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY ALL),
  s AS MATERIALIZED (SELECT node FROM d ORDER BY n DESC, node LIMIT 1), {_REACH('f', 'src', 'dst')}, {_REACH('b', 'dst', 'src')} SELECT node FROM f JOIN b USING (node)""",
    "graph_edges": f"WITH {_E} SELECT * FROM e",
    "way_rules_walk": f"""WITH {_W} SELECT hw AS highway, NOT (hw IN ('motorway', 'raceway') AND foot NOT IN ('yes', 'designated')) AND foot <> 'no' AND NOT (acc = 'private' AND foot NOT IN ('yes', 'designated')) AS ok, count(*) AS n FROM t GROUP BY ALL""",
    "way_rules_bike": f"""WITH {_W}, s AS (SELECT hw, CASE WHEN bi = 'no' OR hw = 'steps' OR acc = 'private' AND bi <> 'yes' THEN NULL WHEN hw IN ('residential', 'cycleway') OR bi = 'yes' THEN 15 WHEN hw = 'footway' THEN 6 END AS speed,
    CASE WHEN cl = 'opposite_lane' THEN 0 WHEN ow = 'yes' OR ju = 'roundabout' AND ow <> 'no' THEN 1 WHEN ow = '-1' THEN -1 ELSE 0 END AS direction FROM t)
  SELECT hw AS highway, CAST(speed AS BIGINT) AS speed, CAST(CASE WHEN speed IS NOT NULL THEN direction END AS BIGINT) AS direction, count(*) AS n FROM s GROUP BY ALL""",
    "shortest_path_hops": f"{_HOPS('(1::BIGINT, 0, 1), (2::BIGINT, 0, 2)')} SELECT node, CAST(k // 1000 AS BIGINT) AS hops, CAST(k % 1000 AS BIGINT) AS source FROM m",
    "door_to_door": f"{_HOPS('(1::BIGINT, 2, 10), (2::BIGINT, 0, 20)')} SELECT node, CAST(k // 1000 AS BIGINT) AS time, CAST(k % 1000 AS BIGINT) AS source FROM m",
}
