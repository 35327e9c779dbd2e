"""Queries of rasters and contours over `lineitem` as a grid of 40 by 40 cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.operators import raster
from livgrid.sources.tables import table

LEGEND = {40: (20, 20, 200), 45: (60, 60, 120), 50: (100, 100, 40), 55: (140, 20, 20), 60: (180, 60, 60), 65: (220, 100, 100), 70: (20, 140, 140), 75: (60, 180, 180)}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("row"), (F.col("l_partkey") % 40).alias("col"), "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linenumber")


def nearest_palette(spark: SparkSession, d: str) -> DataFrame:
    px = _lines(spark, d).select((F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 3 % 256).alias("g"), (F.col("l_partkey") * 5 % 256).alias("b"), (F.col("l_suppkey") * 11 % 256).alias("a"))
    return raster.classified(px, LEGEND).groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("n"))


def majority_cell(spark: SparkSession, d: str) -> DataFrame:
    px = _lines(spark, d).withColumn("class", F.when(F.col("l_returnflag") == "A", 40).when(F.col("l_returnflag") == "N", 45).when(F.col("l_linenumber") % 2 == 0, 50))
    return raster.majority(px, ["row", "col"], "class").select("row", "col", F.col("class").cast("bigint").alias("class"))


def _field(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("row", "col").agg(F.sum("l_quantity").cast("bigint").alias("v"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(40).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("col"))
    return grid.join(_field(spark, d), ["row", "col"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    gap = (F.col("row") * 7 + F.col("col") * 13) % 10 == 0
    f = _dense(spark, d).select("row", "col", F.when(~gap, F.col("v")).alias("v"))
    return raster.filled(f, [], "v")


def gap_levels(spark: SparkSession, d: str) -> DataFrame:
    gap = (F.col("row") * 7 + F.col("col") * 13) % 10 == 0
    f = _dense(spark, d).select("row", "col", F.when(~gap, 40 + 5 * (F.col("v") % 8)).cast("int").alias("v"))
    return raster.filled_levels(f, [], "v")


def block_sums(spark: SparkSession, d: str) -> DataFrame:
    return raster.blocks(_field(spark, d), [], "v", 4)


def box_blur(spark: SparkSession, d: str) -> DataFrame:
    return raster.blurred(_dense(spark, d), [], "v")


def bilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 7 % 156) / 4.0).alias("y"), ((F.col("p_partkey") * 11 % 156) / 4.0).alias("x"))
    return raster.bilinear(_dense(spark, d), p, "v").select("p_partkey", F.floor(F.col("v") * 16 + 0.5).alias("v16"))


def contour_segments(spark: SparkSession, d: str) -> DataFrame:
    s = raster.crossings(_dense(spark, d).withColumn("v", (F.col("v") % 97).cast("double")), [], "v", 48.5)
    return s.select("p.row", "p.col", "p.vertical").union(s.select("q.row", "q.col", "q.vertical")).groupBy("row", "col", "vertical").agg(F.count("*").alias("n"))


def contour_rings(spark: SparkSession, d: str) -> DataFrame:
    f = _dense(spark, d).withColumn("zone", F.lit(1).cast("bigint")).withColumn("v", (F.col("v") % 97).cast("double"))
    return raster.contours(f, ["zone"], "v", 48.5, 0.35, 2)


QUERIES = {f.__name__: f for f in (nearest_palette, majority_cell, gap_fill, gap_levels, block_sums, box_blur, bilinear_samples, contour_segments, contour_rings)}

_DENSE = """f AS (SELECT l_suppkey % 40 AS row, l_partkey % 40 AS col, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT r AS row, c AS col, coalesce(v, 0) AS v FROM range(40) a(r) CROSS JOIN range(40) b(c) LEFT JOIN f ON f.row = r AND f.col = c)"""
_FILL = """o AS (SELECT i, j, CAST(floor(1000000 / sqrt(i * i + j * j)) AS BIGINT) AS w FROM range(-4, 5) a(i), range(-4, 5) b(j) WHERE i * i + j * j BETWEEN 1 AND 16),
s AS (SELECT k.row + i AS row, k.col + j AS col, CAST(sum(k.v * w) AS BIGINT) AS num, CAST(sum(w) AS BIGINT) AS den FROM k, o WHERE (k.row * 7 + k.col * 13) % 10 <> 0 GROUP BY ALL)"""
_LEGEND = ", ".join(f"({i}, {level}, {r}, {g}, {b})" for i, (level, (r, g, b)) in enumerate(LEGEND.items()))
ORACLES = {
    "nearest_palette": f"""WITH px AS (SELECT l_partkey % 256 AS r, l_suppkey * 3 % 256 AS g, l_partkey * 5 % 256 AS b, l_suppkey * 11 % 256 AS a FROM lineitem),
  u AS (SELECT DISTINCT r, g, b, a FROM px), m AS (SELECT u.*, level, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS d2, i FROM u, (VALUES {_LEGEND}) p(i, level, pr, pg, pb) QUALIFY row_number() OVER (PARTITION BY r, g, b, a ORDER BY d2, i) = 1)
  SELECT CAST(CASE WHEN d2 <= 900 AND a > 100 THEN level END AS BIGINT) AS level, count(*) AS n FROM px JOIN m USING (r, g, b, a) GROUP BY ALL""",
    "majority_cell": """WITH px AS (SELECT l_suppkey % 40 AS row, l_partkey % 40 AS col, CASE WHEN l_returnflag = 'A' THEN 40 WHEN l_returnflag = 'N' THEN 45 WHEN l_linenumber % 2 = 0 THEN 50 END AS class FROM lineitem),
  k AS (SELECT row, col, class, count(*) AS n FROM px WHERE class IS NOT NULL GROUP BY ALL) SELECT row, col, CAST(class AS BIGINT) AS class FROM k QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, class) = 1""",
    "gap_fill": f"WITH {_DENSE}, k AS (SELECT * FROM g), {_FILL} SELECT s.row, s.col, num, den FROM s JOIN g ON g.row = s.row AND g.col = s.col WHERE (s.row * 7 + s.col * 13) % 10 = 0",
    "gap_levels": f"""WITH {_DENSE}, k AS (SELECT row, col, 40 + 5 * (v % 8) AS v FROM g), {_FILL}
  SELECT k.row, k.col, CAST(CASE WHEN (k.row * 7 + k.col * 13) % 10 <> 0 THEN k.v ELSE coalesce(greatest(40, least(75, round_even(num / CAST(den AS DOUBLE) / 5, 0) * 5)), 0) END AS INT) AS v FROM k LEFT JOIN s ON s.row = k.row AND s.col = k.col""",
    "block_sums": f"WITH {_DENSE} SELECT row // 4 AS row, col // 4 AS col, CAST(sum(v) AS BIGINT) AS v FROM f GROUP BY ALL",
    "box_blur": f"""WITH {_DENSE}, a AS (SELECT x.row, x.col, sum(y.v) AS v FROM g x JOIN g y ON y.row BETWEEN x.row - 1 AND x.row + 1 AND y.col BETWEEN x.col - 1 AND x.col + 1 GROUP BY ALL)
  SELECT x.row, x.col, CAST(sum(y.v) AS BIGINT) AS v FROM a x JOIN a y ON y.row BETWEEN x.row - 1 AND x.row + 1 AND y.col BETWEEN x.col - 1 AND x.col + 1 GROUP BY ALL""",
    "bilinear_samples": f"""WITH {_DENSE}, p AS (SELECT p_partkey, p_partkey * 7 % 156 AS y4, p_partkey * 11 % 156 AS x4 FROM part)
  SELECT p_partkey, CAST(sum(v * (CASE WHEN row = y4 // 4 THEN 4 - y4 % 4 ELSE y4 % 4 END) * (CASE WHEN col = x4 // 4 THEN 4 - x4 % 4 ELSE x4 % 4 END)) AS BIGINT) AS v16
  FROM p JOIN g ON row BETWEEN y4 // 4 AND y4 // 4 + 1 AND col BETWEEN x4 // 4 AND x4 // 4 + 1 GROUP BY ALL""",
    "contour_segments": f"""WITH {_DENSE}, h AS (SELECT a.row, a.col, false AS vertical FROM g a JOIN g b ON b.row = a.row AND b.col = a.col + 1 WHERE (a.v % 97 > 48.5) <> (b.v % 97 > 48.5)),
  v AS (SELECT a.row, a.col, true AS vertical FROM g a JOIN g b ON b.col = a.col AND b.row = a.row + 1 WHERE (a.v % 97 > 48.5) <> (b.v % 97 > 48.5))
  SELECT row, col, vertical, CAST(CASE WHEN vertical THEN (col > 0)::INT + (col < 39)::INT ELSE (row > 0)::INT + (row < 39)::INT END AS BIGINT) AS n FROM (SELECT * FROM h UNION ALL SELECT * FROM v)""",
}
