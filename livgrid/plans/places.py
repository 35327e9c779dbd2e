"""Queries of points, zones and grids: customers and suppliers as points of a 1000 by 1000 square, nations as zones of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.operators import catalog, spatial, timetable
from livgrid.sources.tables import table


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7919) % 1000).alias("x"), ((F.col("c_custkey") * 104729) % 1000).alias("y"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") * 6101) % 1000).alias("sx"), ((F.col("s_suppkey") * 3571) % 1000).alias("sy"))


def _zones(spark: SparkSession, d: str, width: int = 200, shift: int = 0) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"))
    left, bottom = (F.col("zone") % 5 * 200 + shift).cast("double"), (F.floor(F.col("zone") / 5) * 200 + shift).cast("double")
    out = n.select("zone", left.alias("left"), bottom.alias("bottom"), (left + width).alias("right"), (bottom + width).alias("top"))
    return out.withColumn("polygon", spatial.rectangle(F.col("left"), F.col("bottom"), F.col("right"), F.col("top")))


def point_in_zone(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_in_zones(_customers(spark, d), _zones(spark, d, 250), "x", "y", "polygon").groupBy("zone").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def knn4_within(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.knn_within(_customers(spark, d), _suppliers(spark, d), ("x", "y"), ("sx", "sy"), "c_custkey", "s_suppkey", 4, 100)
    return out.select("c_custkey", "s_suppkey", "d2", F.col("rank").cast("bigint").alias("rank"))


def nearest_supplier(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(_customers(spark, d), _suppliers(spark, d), ("x", "y"), ("sx", "sy"), "c_custkey", "s_suppkey", 60)


def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    other = s.select(F.col("s_suppkey").alias("t"), F.col("sx").alias("tx"), F.col("sy").alias("ty"))
    pairs = spatial.radius_join(s, other, ("sx", "sy"), ("tx", "ty"), 100).filter("s_suppkey < t").select(F.col("s_suppkey").alias("a"), F.col("t").alias("b"), "d2")
    return timetable.both_ways(pairs, "a", "b")


def projected_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Forecast transfers between suppliers' stops; distances in whole metres."""
    pairs = radius_pairs(spark, d).withColumn("distance", F.floor(F.sqrt("d2")))
    secs = timetable.transfer_seconds(F.col("distance"), F.col("a") % 5 == F.col("b") % 5, F.when(F.col("a") % 2 == 0, "métro").otherwise("tram"))
    return pairs.select("a", "b", secs.alias("secs"))


def rasterize_zones(spark: SparkSession, d: str) -> DataFrame:
    return spatial.rasterize(_zones(spark, d, 260), "polygon", "zone", "zone", 25.0).select("row", "col", "zone")


def max_level_burn(spark: SparkSession, d: str) -> DataFrame:
    z = _zones(spark, d, 330).withColumn("level", 40 + 5 * ((F.col("zone") * 7) % 8))
    return spatial.rasterize(z, "polygon", "level", "level", 25.0).select("row", "col", "level")


def bbox_share(spark: SparkSession, d: str) -> DataFrame:
    """Zones of which a view shows three tenths or more, and the share in whole hundredths of a percent; all are counted, the largest twelve shown."""
    shown, total = catalog.in_view(_zones(spark, d).withColumnRenamed("zone", "code"), "polygon", 130, 50, 710, 470)
    return shown.select(F.col("code").alias("zone"), F.floor(F.col("share") * 10000 + 0.5).alias("share")).crossJoin(F.broadcast(total))


def _tiling(spark: SparkSession, d: str, width: int, shift: int, name: str) -> DataFrame:
    return spatial.cells_of(_zones(spark, d, width, shift), "left", "bottom", "right", "top", 20.0).groupBy("row", "col").agg(F.min("zone").alias(name))


def polygon_overlap_owner(spark: SparkSession, d: str) -> DataFrame:
    pairs = spatial.overlap(_tiling(spark, d, 200, 60, "unit"), _tiling(spark, d, 200, 0, "zone"), "unit", "zone")
    return spatial.owners(pairs, "unit", "zone")


def rectangle_iou(spark: SparkSession, d: str) -> DataFrame:
    """Intersection over union of same-numbered zones of two tilings, in whole thousandths."""
    pairs = spatial.overlap(_tiling(spark, d, 180, 20, "a"), _tiling(spark, d, 200, 0, "b"), "a", "b").filter("a = b")
    return pairs.select("a", F.floor(F.col("common") * 1000 / (F.col("of_a") + F.col("of_b") - F.col("common")) + 0.5).alias("iou"))


def neighbourhood_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Zones rebuilt of units of a tiling that is shifted; zones don't overlap, so none is left for a second chance."""
    return spatial.neighbourhoods(_tiling(spark, d, 200, 60, "unit"), _tiling(spark, d, 200, 0, "zone"), "unit", "zone")


def point_to_cell(spark: SparkSession, d: str) -> DataFrame:
    at = spatial.cell_at(F.col("x"), F.col("y"), 0.0, 1000.0, 25.0)
    return _customers(spark, d).select(at.alias("c")).groupBy("c.row", "c.col").agg(F.count("*").alias("n"))


def iso_mask(spark: SparkSession, d: str) -> DataFrame:
    """Cells of customers that a supplier of their own nation is within reach of."""
    near = spatial.radius_join(_customers(spark, d), _suppliers(spark, d), ("x", "y"), ("sx", "sy"), 150).filter("c_nationkey = s_nationkey")
    return near.select("c_nationkey", F.floor(F.col("y") / 25).alias("row"), F.floor(F.col("x") / 25).alias("col")).distinct()


def tile_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """The tiles of 75 by 50 that nations' boxes touch, both ends included."""
    return catalog.tiles_of(_zones(spark, d), "zone", 50, 75)


def label_points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.label_points(_zones(spark, d), "zone", "polygon")


def boundary_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spatial.shared_edges_once(_zones(spark, d), "zone", "polygon")
    return lines.groupBy("zone", "shared").agg(F.count("*").alias("n"))


def nearest_places(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer's reachable suppliers the three nearest places, suppliers close to each other as one."""
    # customers at one spot have the same places, so each spot is searched and its stations listed once; n is 1, unless a key comes several times
    customers = _customers(spark, d).groupBy("c_custkey", "x", "y").agg(F.count("*").alias("n"))
    spots = customers.select(F.struct("x", "y", "n").alias("spot")).distinct()
    stations = _suppliers(spark, d).withColumn("project", F.col("s_suppkey") % 7 == 0)
    places = spatial.places_around(spots.select("spot", "spot.x", "spot.y"), stations, "spot", ("x", "y"), ("sx", "sy"), "s_suppkey", "project", 200, 3, 50, 90)
    listed = F.flatten(F.transform("stations", lambda s: F.array_repeat(s.cast("string"), F.col("spot.n").cast("int"))))
    places = places.select("spot.x", "spot.y", "spot.n", "place", F.array_join(listed, "+").alias("stations"))
    return customers.join(places, ["x", "y", "n"]).select("c_custkey", "place", "stations")


QUERIES = {f.__name__: f for f in (point_in_zone, knn4_within, nearest_supplier, radius_pairs, projected_transfers, rasterize_zones, max_level_burn, bbox_share, polygon_overlap_owner, rectangle_iou, neighbourhood_rebuild, point_to_cell, iso_mask, tile_enumeration, label_points, boundary_lines, nearest_places)}

_P = """c AS (SELECT c_custkey, c_nationkey, (c_custkey * 7919) % 1000 AS x, (c_custkey * 104729) % 1000 AS y FROM customer),
s AS (SELECT s_suppkey, s_nationkey, (s_suppkey * 6101) % 1000 AS sx, (s_suppkey * 3571) % 1000 AS sy FROM supplier),
z AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, n_nationkey % 5 * 200 AS l, n_nationkey // 5 * 200 AS b FROM nation),
dd AS (SELECT *, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM c, s)"""
_R = """r AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, (a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy) AS d2 FROM s a, s b
  WHERE a.s_suppkey <> b.s_suppkey AND (a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy) <= 10000)"""
_GRID = lambda size, n: f"g AS (SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, (c + 0.5) * {size} AS gx, (r + 0.5) * {size} AS gy FROM range({n}) a(r), range({n}) b(c))"
_TILE = lambda name, width, shift: f"(SELECT row, col, min(zone) AS {name} FROM g, z WHERE gx >= l + {shift} AND gx <= l + {shift} + {width} AND gy >= b + {shift} AND gy <= b + {shift} + {width} GROUP BY ALL)"
_OVER = lambda a, b: f"""ta AS {a}, tb AS {b}, o AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM ta a JOIN tb b USING (row, col) GROUP BY ALL),
na AS (SELECT id, count(*) AS n FROM ta GROUP BY ALL), nb AS (SELECT id, count(*) AS n FROM tb GROUP BY ALL)"""  # noqa: E731
_PLACE = lambda n, rest: f"""l{n} AS (SELECT * FROM {rest} QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d2, id) = 1),
p{n} AS (SELECT r.c_custkey, r.id, r.d2, CAST({n} AS BIGINT) AS place FROM {rest} r JOIN l{n} l USING (c_custkey) WHERE (r.sx - l.sx) * (r.sx - l.sx) + (r.sy - l.sy) * (r.sy - l.sy) < CASE WHEN r.project OR l.project THEN 8100 ELSE 2500 END),
r{n} AS (SELECT r.* FROM {rest} r ANTI JOIN p{n} p ON p.c_custkey = r.c_custkey AND p.id = r.id)"""  # noqa: E731
_PLACES = ", ".join((_PLACE(0, "n"), _PLACE(1, "r0"), _PLACE(2, "r1")))
ORACLES = {
    "point_in_zone": f"WITH {_P} SELECT zone, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM c JOIN z ON x > l AND x < l + 250 AND y > b AND y < b + 250 GROUP BY ALL",
    "knn4_within": f"WITH {_P} SELECT c_custkey, s_suppkey, d2, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS rank FROM dd WHERE d2 < 10000 QUALIFY rank <= 4",
    "nearest_supplier": f"WITH {_P} SELECT c_custkey, s_suppkey, d2 FROM dd QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) = 1",
    "radius_pairs": f"WITH {_P}, {_R} SELECT a, b, d2 FROM r",
    "projected_transfers": f"WITH {_P}, {_R} SELECT a, b, CAST(CASE WHEN a % 5 = b % 5 THEN 120 ELSE floor(sqrt(d2)) + CASE WHEN a % 2 = 0 THEN 240 ELSE 60 END END AS BIGINT) AS secs FROM r",
    "rasterize_zones": f"WITH {_P}, {_GRID(25, 60)} SELECT row, col, max(zone) AS zone FROM g, z WHERE gx >= l AND gx < l + 260 AND gy >= b AND gy < b + 260 GROUP BY ALL",
    "max_level_burn": f"WITH {_P}, {_GRID(25, 60)} SELECT row, col, CAST(max(40 + 5 * ((zone * 7) % 8)) AS BIGINT) AS level FROM g, z WHERE gx >= l AND gx < l + 330 AND gy >= b AND gy < b + 330 GROUP BY ALL",
    "bbox_share": f"""WITH {_P}, v AS (SELECT zone, greatest(0, least(l + 200, 710) - greatest(l, 130)) * greatest(0, least(b + 200, 470) - greatest(b, 50)) / 40000.0 AS share FROM z)
  SELECT zone, CAST(floor(share * 10000 + 0.5) AS BIGINT) AS share, (SELECT count(*) FROM v WHERE share >= 0.3) AS total FROM v WHERE share >= 0.3 ORDER BY v.share DESC, zone LIMIT 12""",
    "polygon_overlap_owner": f"""WITH {_P}, {_GRID(20, 60)}, {_OVER(_TILE('id', 200, 60), _TILE('id', 200, 0))}, t AS (SELECT a, CAST(sum(common) AS BIGINT) AS covered FROM o GROUP BY ALL)
  SELECT o.a AS unit, o.b AS owner, t.covered, na.n AS of_a, o.common, na.n + nb.n - o.common AS union_cells FROM o JOIN t USING (a) JOIN na ON na.id = o.a JOIN nb ON nb.id = o.b QUALIFY row_number() OVER (PARTITION BY o.a ORDER BY o.common DESC, o.b) = 1""",
    "rectangle_iou": f"""WITH {_P}, {_GRID(20, 60)}, {_OVER(_TILE('id', 180, 20), _TILE('id', 200, 0))}
  SELECT a, CAST(floor(common * 1000 / CAST(na.n + nb.n - common AS DOUBLE) + 0.5) AS BIGINT) AS iou FROM o JOIN na ON na.id = a JOIN nb ON nb.id = b WHERE a = b""",
    "point_to_cell": f"WITH {_P} SELECT CAST(floor((1000 - y) / 25.0) AS BIGINT) AS row, x // 25 AS col, count(*) AS n FROM c GROUP BY ALL",
    "iso_mask": f"WITH {_P} SELECT DISTINCT c_nationkey, y // 25 AS row, x // 25 AS col FROM dd WHERE d2 <= 22500 AND c_nationkey = s_nationkey",
    "tile_enumeration": f"WITH {_P} SELECT zone, i, j FROM z, range(21) a(i), range(14) b(j) WHERE i BETWEEN z.b // 50 AND (z.b + 200) // 50 AND j BETWEEN l // 75 AND (l + 200) // 75",
    "label_points": f"WITH {_P} SELECT zone, CAST(l + 100 AS DOUBLE) AS x, CAST(b + 100 AS DOUBLE) AS y FROM z",
    "neighbourhood_rebuild": f"""WITH {_P}, {_GRID(20, 60)}, {_OVER(_TILE('id', 200, 60), _TILE('id', 200, 0))}, cv AS (SELECT a, sum(common) AS covered FROM o GROUP BY ALL),
  w AS (SELECT o.a, o.b FROM o JOIN cv USING (a) JOIN na ON na.id = o.a WHERE 2 * covered >= na.n QUALIFY row_number() OVER (PARTITION BY o.a ORDER BY common DESC, o.b) = 1),
  r AS (SELECT w.b, count(*) AS cells, count(*) FILTER (tb.id = w.b) AS common FROM ta JOIN w ON w.a = ta.id LEFT JOIN tb USING (row, col) GROUP BY w.b),
  j AS (SELECT nb.id AS b, coalesce(10 * common >= 6 * (cells + nb.n - common), false) AS fits FROM nb LEFT JOIN r ON r.b = nb.id)
  SELECT w.a AS unit, w.b AS zone, j.fits, (SELECT 2 * count(*) FILTER (NOT fits) > count(*) FROM j) AS abandoned FROM w JOIN j USING (b)""",
    "nearest_places": f"""WITH {_P}, n AS (SELECT c_custkey, s_suppkey AS id, d2, sx, sy, s_suppkey % 7 = 0 AS project FROM dd WHERE d2 <= 40000), {_PLACES}
  SELECT c_custkey, place, string_agg(CAST(id AS VARCHAR), '+' ORDER BY d2, id) AS stations FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY ALL""",
    "boundary_lines": """WITH e AS (SELECT n_nationkey AS zone, n_nationkey % 5 AS c, n_nationkey // 5 AS r FROM nation),
  s AS (SELECT zone, 'h' || c || '_' || r AS k FROM e UNION ALL SELECT zone, 'h' || c || '_' || (r + 1) FROM e UNION ALL SELECT zone, 'v' || c || '_' || r FROM e UNION ALL SELECT zone, 'v' || (c + 1) || '_' || r FROM e),
  u AS (SELECT k, CAST(min(zone) AS BIGINT) AS zone, count(*) > 1 AS shared FROM s GROUP BY k) SELECT zone, shared, count(*) AS n FROM u GROUP BY ALL""",
}
