"""Points, polygons and grids. A polygon is an array of rings, a ring an array of (x, y) structs; holes are rings too (even-odd).

Joins of points go through square buckets no smaller than the radius: each point of one side is dealt to the nine buckets
around it, so the join is an equality, and no pair beyond the neighbouring buckets is made.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livgrid.operators.written import Written

#: Margin around a place and size of a cell, in Mercator metres.
GRID_MARGIN_M, CELL_M = 300.0, 15.0
RING = "array<struct<x:double,y:double>>"


def rectangle(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """A polygon of one ring."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(left, bottom), corner(right, bottom), corner(right, top), corner(left, top)))


def _edges(ring: Column) -> Column:
    """a, b: each vertex and the next, the last one's being the first."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), turned.alias("b"))


def on_boundary(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point is on an edge, by exact comparison."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(polygon, lambda ring: F.exists(_edges(ring), on))


def inside(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings, strictly: a point on a boundary isn't inside."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    crossings = F.aggregate(polygon, F.lit(0), lambda n, ring: n + F.size(F.filter(_edges(ring), lambda e: F.coalesce(crossed(e), F.lit(False)))))
    return (crossings % 2 == 1) & ~on_boundary(polygon, x, y)


def area(polygon: Column) -> Column:
    """Of the first ring less the others."""
    one = lambda ring: F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2
    rest = F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda s, ring: s + one(ring))
    return one(F.element_at(polygon, 1)) - rest


def clipped(ring: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """A ring cut to a rectangle, one side after the other."""

    def cut(ring: Column, axis: str, bound: Column, above: bool) -> Column:
        keeps = lambda p: p[axis] >= bound if above else p[axis] <= bound

        def crossing(a: Column, b: Column) -> Column:
            t = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
            return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

        def step(e: Column) -> Column:
            a, b = e["a"], e["b"]
            none = F.array().cast(RING)
            return F.when(keeps(a) & keeps(b), F.array(b)).when(keeps(a), F.array(crossing(a, b))).when(keeps(b), F.array(crossing(a, b), b)).otherwise(none)

        return F.flatten(F.transform(_edges(ring), step))

    for axis, bound, above in (("x", left, True), ("x", right, False), ("y", bottom, True), ("y", top, False)):
        ring = _once(ring, cut, axis, bound, above)
    return ring


def _once(ring: Column, cut, axis: str, bound: Column, above: bool) -> Column:
    """cut(ring, ...) with ring evaluated once, however often the cut reads it."""
    return F.element_at(F.transform(F.array(ring), lambda r: cut(r, axis, bound, above)), 1)


def share_in_view(polygon: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """The share of a simple polygon (its outer ring) that a view shows."""
    ring = clipped(F.element_at(polygon, 1), *(F.lit(float(v)) for v in (left, bottom, right, top)))
    return F.coalesce(F.try_divide(area(F.array(ring)), area(F.slice(polygon, 1, 1))), F.lit(0.0))


def clipped_to(polygon: Column, convex: Column) -> Column:
    """The rings of a polygon cut to a convex ring that turns left (a municipality's outline in convex pieces): empty ones are dropped."""

    def cut(ring: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def met(p: Column, q: Column) -> Column:
            t = side(p) / F.nullif(side(p) - side(q), F.lit(0.0))
            return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

        def step(e: Column) -> Column:
            p, q = e["a"], e["b"]
            here, there = side(p) >= 0, side(q) >= 0
            return F.when(here & there, F.array(q)).when(here, F.array(met(p, q))).when(there, F.array(met(p, q), q)).otherwise(F.array().cast(RING))

        return F.flatten(F.transform(_edges(ring), step))

    whole = lambda ring: F.aggregate(_edges(convex), ring, cut)
    return F.filter(F.transform(polygon, whole), lambda ring: F.size(ring) >= 3)


def drawn(outline: Column, zones: Column) -> Column:
    """What a map fills by the even-odd rule to shade all but the zones: the rings of an outline and of the zones (an array of polygons) in it."""
    return F.concat(outline, F.flatten(zones))


def _bucket_size(zones: DataFrame, margin: float) -> float:
    """The mean breadth of zones' boxes: most then touch four buckets or fewer."""
    mean = zones.agg(F.avg(F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom")) + 2 * margin)).first()[0]
    return mean if mean and math.isfinite(mean) and mean > 0 else 1.0


def _met(points: DataFrame, zones: DataFrame, x: str, y: str, margin: float) -> DataFrame:
    """Points with the zones (columns left, bottom, right, top) whose box with a margin holds them: zones are dealt to the square buckets that they touch,
    points to their own, so it is a join on equality."""
    size = _bucket_size(zones, margin)
    span = lambda low, high: F.sequence(F.floor((F.col(low) - margin) / size), F.floor((F.col(high) + margin) / size))
    dealt = zones.filter("left <= right AND bottom <= top").withColumn("__bx", F.explode(span("left", "right"))).withColumn("__by", F.explode(span("bottom", "top")))
    own = points.withColumn("__bx", F.floor(F.col(x) / size)).withColumn("__by", F.floor(F.col(y) / size))
    box = F.col(x).between(F.col("left") - margin, F.col("right") + margin) & F.col(y).between(F.col("bottom") - margin, F.col("top") + margin)
    return own.join(dealt, ["__bx", "__by"]).filter(box).drop("__bx", "__by")


def points_in_zones(points: DataFrame, zones: DataFrame, x: str, y: str, polygon: str) -> DataFrame:
    """Every point with every zone (columns left, bottom, right, top) that holds it; null coordinates are in none."""
    return _met(points, zones, x, y, 0.0).filter(inside(F.col(polygon), F.col(x).cast("double"), F.col(y).cast("double")))


def _bucketed(points: DataFrame, x: str, y: str, size: float, spread: bool) -> DataFrame:
    bx, by = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not spread:
        return points.withColumn("__bx", bx).withColumn("__by", by)
    around = F.array(*(F.struct((bx + i).alias("bx"), (by + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return points.withColumn("__b", F.explode(around)).select("*", F.col("__b.bx").alias("__bx"), F.col("__b.by").alias("__by")).drop("__b")


def radius_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], radius: float, strict: bool = False) -> DataFrame:
    """Pairs within the radius, with their squared distance d2."""
    pairs = _bucketed(left, *a, radius, True).join(_bucketed(right, *b, radius, False), ["__bx", "__by"]).drop("__bx", "__by")
    dx, dy = F.col(a[0]) - F.col(b[0]), F.col(a[1]) - F.col(b[1])
    pairs = pairs.withColumn("d2", dx * dx + dy * dy)
    return pairs.filter(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius)


def knn_within(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], left_id: str, right_id: str, k: int, radius: float) -> DataFrame:
    """Each left point's k nearest right points nearer than the radius, with their rank. Left points at one spot are searched as one, and of right points at
    one spot the k least ids alone can be among the nearest."""
    spots = left.select(F.col(a[0]).alias("__x"), F.col(a[1]).alias("__y")).distinct()
    least = right.withColumn("__n", F.row_number().over(Window.partitionBy(*b).orderBy(right_id))).filter(F.col("__n") <= k).drop("__n")
    ranked = F.row_number().over(Window.partitionBy("__x", "__y").orderBy("d2", right_id))
    found = radius_join(spots, least, ("__x", "__y"), b, radius, strict=True).withColumn("__n", ranked).filter(F.col("__n") <= k).drop("__n")
    w = Window.partitionBy(left_id).orderBy("d2", right_id)
    near = left.join(found, (F.col(a[0]) == F.col("__x")) & (F.col(a[1]) == F.col("__y"))).drop("__x", "__y")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], left_id: str, right_id: str, first: float) -> DataFrame:
    """Each left point's nearest right point, however far: buckets grow fourfold until every point has one. left_id, right_id, d2. Points whose id or
    coordinates are null or not finite have none."""
    finite = lambda df, *cs: df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in cs)).filter(~F.greatest(*(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in cs[1:])))
    tables = Written(left.sparkSession, "nearest")
    left, right = finite(left, left_id, *a), tables.cut(finite(right, right_id, *b))
    todo, found, radius = tables.cut(left), None, first
    while True:
        here = tables.cut(radius_join(todo, right, a, b, radius).groupBy(left_id).agg(F.min(F.struct("d2", right_id)).alias("m")).select(left_id, f"m.{right_id}", "m.d2"))
        found = here if found is None else found.union(here)
        todo = tables.cut(todo.join(here, left_id, "left_anti"))
        if todo.isEmpty() or right.isEmpty():
            return found
        radius *= 4


def cells_of(zones: DataFrame, left: str, bottom: str, right: str, top: str, cell: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The zones with every cell (row, col) whose centre their box holds: what rasterising looks at."""
    low = lambda c, o: F.ceil((F.col(c) - o) / cell - 0.5)
    high = lambda c, o: F.floor((F.col(c) - o) / cell - 0.5)
    series = lambda a, b: F.when(b >= a, F.sequence(a, b))
    out = zones.withColumn("col", F.explode(series(low(left, origin[0]), high(right, origin[0]))))
    return out.withColumn("row", F.explode(series(low(bottom, origin[1]), high(top, origin[1]))))


def rasterize(zones: DataFrame, polygon: str, value: str, order: str, cell: float) -> DataFrame:
    """row, col, value of the cells whose centre a zone (columns left, bottom, right, top) holds; the zone that comes last by order wins."""
    cells = cells_of(zones, "left", "bottom", "right", "top", cell)
    cells = cells.filter(inside(F.col(polygon), (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell))
    return cells.groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def cell_at(x: Column, y: Column, left: float | Column, top: float | Column, cell: float) -> Column:
    """Row and column of a point on a grid whose rows go south."""
    return F.struct(F.floor((top - y) / cell).alias("row"), F.floor((x - left) / cell).alias("col"))


def cell_lookup(points: DataFrame, grids: DataFrame, mask: DataFrame, point_id: str, x: str, y: str) -> DataFrame:
    """point_id, code, row, col: the cell of a municipality that each point is in: of the grids (code, grid_left, grid_top, left, bottom, right, top) whose box
    holds it, those whose mask (code, row, col) has the cell; the first code of several."""
    at = cell_at(F.col(x), F.col(y), F.col("grid_left"), F.col("grid_top"), CELL_M)
    found = _met(points, grids, x, y, 0.0).select(point_id, "code", at.alias("c")).select(point_id, "code", F.col("c.row").alias("row"), F.col("c.col").alias("col"))
    found = found.join(mask.select("code", "row", "col"), ["code", "row", "col"])
    return found.groupBy(point_id).agg(F.min(F.struct("code", "row", "col")).alias("m")).select(point_id, "m.code", "m.row", "m.col")


def overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """By pair of pieces of two cell tables (row, col, id): the cells in common, and of either."""
    both = a.join(b, ["row", "col"]).groupBy(a_id, b_id).agg(F.count("*").alias("common"))
    return both.join(a.groupBy(a_id).agg(F.count("*").alias("of_a")), a_id).join(b.groupBy(b_id).agg(F.count("*").alias("of_b")), b_id)


def owners(overlaps: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Each a's b with the largest common part (the least id of equal ones), the part of a that all b cover, and the pair's
    intersection over union; parts as cells."""
    best = F.max_by(F.struct(b_id, "common", "of_b"), F.struct("common", -F.col(b_id)))
    out = overlaps.groupBy(a_id).agg(best.alias("best"), F.sum("common").alias("covered"), F.first("of_a").alias("of_a"))
    union = F.col("of_a") + F.col("best.of_b") - F.col("best.common")
    return out.select(a_id, F.col(f"best.{b_id}").alias("owner"), "covered", "of_a", F.col("best.common").alias("common"), union.alias("union_cells"))


#: Least share of a unit that zones cover, least share of the union that a rebuilt zone keeps, opening of what is left for the others.
LEAST_COVER, LEAST_IOU, OPENING_M = 0.5, 0.6, 8.0


def second_chances(owner: dict, overlaps: list[tuple], sizes: dict) -> dict:
    """Zones left without a unit, in order, take one: of the units that are theirs by half or more, the one that they have most of and whose owner keeps
    others. owner: unit to zone; overlaps: (zone, unit, common)."""
    out, kept = dict(owner), Counter(owner.values())
    theirs: dict = {}
    for zone, unit, common in overlaps:
        if common >= LEAST_COVER * sizes[unit]:
            theirs.setdefault(zone, []).append((-common, unit))
    for zone in sorted({z for z, *_ in overlaps}):
        if kept[zone]:
            continue
        free = [unit for _, unit in sorted(theirs.get(zone, ())) if kept[out.get(unit)] > 1]
        if free:
            kept[out.get(free[0])] -= 1
            out[free[0]] = zone
            kept[zone] += 1
    return out


def neighbourhoods(units: DataFrame, zones: DataFrame, unit: str, zone: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, unit, zone, fits, abandoned. Each unit (cell table) joins the zone that has most of it if zones cover half of it; zones left without a unit have
    a second chance, one municipality (`by`) a task. Zones whose units are under six tenths of the union don't fit; where more than half of the zones
    don't, the rebuild is abandoned."""
    cells = ["row", "col"]
    pairs = units.join(zones, [*by, *cells]).groupBy(*by, unit, zone).agg(F.count("*").alias("common"))
    pairs = pairs.join(units.groupBy(*by, unit).agg(F.count("*").alias("of_a")), [*by, unit])
    best = F.max_by(zone, F.struct("common", -F.col(zone)))
    first = pairs.groupBy(*by, unit).agg(best.alias("owner"), F.sum("common").alias("covered"), F.first("of_a").alias("of_a")).filter(F.col("covered") >= LEAST_COVER * F.col("of_a")).select(*by, unit, "owner")
    listed = pairs.join(first, [*by, unit], "left").withColumn("__one", F.lit(1))
    keys = [*by, "__one"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        owned = rows.dropna(subset=["owner"])
        found = second_chances(dict(zip(owned[unit].tolist(), owned["owner"].astype(rows[zone].dtype).tolist(), strict=True)), list(rows[[zone, unit, "common"]].itertuples(index=False, name=None)), dict(zip(rows[unit].tolist(), rows["of_a"].tolist(), strict=True)))
        return pd.DataFrame([(*(rows[k].iloc[0] for k in by), u, z) for u, z in found.items()], columns=[*by, unit, zone])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.select(*by, unit, zone).schema)
    owner = listed.groupBy(*keys).applyInPandas(run, kinds)
    rebuilt = units.join(owner, [*by, unit]).join(zones.withColumnRenamed(zone, "__z"), [*by, *cells], "left").groupBy(*by, zone).agg(F.count("*").alias("cells"), F.count_if(F.col("__z") == F.col(zone)).alias("common"))
    judged = zones.groupBy(*by, zone).agg(F.count("*").alias("of_zone")).join(rebuilt, [*by, zone], "left")
    judged = judged.withColumn("fits", F.coalesce(10 * F.col("common") >= 10 * LEAST_IOU * (F.col("cells") + F.col("of_zone") - F.col("common")), F.lit(False)))
    bad = judged.withColumn("__one", F.lit(1)).groupBy(*keys).agg((2 * F.count_if(~F.col("fits")) > F.count("*")).alias("abandoned"))
    return owner.join(judged.select(*by, zone, "fits"), [*by, zone]).withColumn("__one", F.lit(1)).join(bad, keys).select(*by, unit, zone, "fits", "abandoned")


def rebuilt_cells(units: DataFrame, zones: DataFrame, owners: DataFrame, unit: str, zone: str, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, row, col, zone of rebuilt neighbourhoods (owners: as `neighbourhoods` gives them): zones that fit are their units; others keep what those leave of their
    own outline, opened by OPENING_M (slivers narrower than twice that go); all keep their outline where the rebuild is abandoned."""
    cells = ["row", "col"]
    good = units.join(owners.filter("fits AND NOT abandoned").select(*by, unit, zone), [*by, unit]).select(*by, *cells, zone)
    state = owners.select(*by, zone, "fits", "abandoned").distinct()
    rest = zones.join(state, [*by, zone], "left").filter(F.coalesce(~F.col("fits") | F.col("abandoned"), F.lit(True))).select(*by, zone, *cells)
    left = rest.join(good.select(*by, *cells), [*by, *cells], "left_anti")
    reach = int(OPENING_M // cell)
    if reach:
        disc = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * i + j * j) * cell * cell <= OPENING_M**2]
        around = lambda df: df.select(*by, zone, F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in disc))).alias("c")).groupBy(*by, zone, "c.row", "c.col").agg(F.count("*").alias("n"))
        core = around(left).filter(F.col("n") == len(disc))  # a cell whose whole disc is there
        left = around(core.drop("n")).select(*by, zone, *cells)
    return good.unionByName(left.select(*by, *cells, zone))


def label_point(rings: list[list[tuple[float, float]]], tolerance: float = 5.0) -> tuple[float, float]:
    """The point inside the largest ring (holes are rings too, even-odd) that is farthest from all edges, to a tolerance: squares of the ring's box are split,
    the most promising first, until none can hold a point farther by more than it."""
    shapes = [np.array(r, float) for r in rings if len(r) >= 3]
    size = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(np.roll(r[:, 0], -1), r[:, 1]))
    largest = max(shapes, key=size)
    begin, end = np.concatenate(shapes), np.concatenate([np.roll(r, -1, axis=0) for r in shapes])
    step = end - begin
    square = np.where((step**2).sum(1) > 0, (step**2).sum(1), 1.0)

    def clearance(p: np.ndarray) -> float:
        """The distance to the nearest edge, negative outside."""
        t = np.clip(((p - begin) * step).sum(1) / square, 0.0, 1.0)
        away = float(np.hypot(*(p - begin - t[:, None] * step).T).min())
        over = (begin[:, 1] > p[1]) != (end[:, 1] > p[1])
        at = begin[over, 0] + step[over, 0] * (p[1] - begin[over, 1]) / step[over, 1]
        return away if np.count_nonzero(p[0] < at) % 2 else -away

    low, high = largest.min(axis=0), largest.max(axis=0)
    half = float((high - low).max()) / 2
    middle = (low + high) / 2
    best = (clearance(middle), tuple(middle))
    queue = [(-(best[0] + half * math.sqrt(2)), tuple(middle), half)]
    while queue:
        promise, at, half = heapq.heappop(queue)
        if -promise - best[0] <= tolerance:
            break
        half /= 2
        for dx in (-half, half):
            for dy in (-half, half):
                p = np.array([at[0] + dx, at[1] + dy])
                d = clearance(p)
                if d > best[0]:
                    best = (d, tuple(p))
                if d + half * math.sqrt(2) - best[0] > tolerance:
                    heapq.heappush(queue, (-(d + half * math.sqrt(2)), tuple(p), half))
    return float(best[1][0]), float(best[1][1])


def label_points(zones: DataFrame, key: str, polygon: str, tolerance: float = 5.0) -> DataFrame:
    """key, x, y: where each zone's name goes."""

    def place(batches):
        for rows in batches:
            points = [label_point([[(p["x"], p["y"]) for p in ring] for ring in rings], tolerance) for rings in rows[polygon]]
            yield pd.DataFrame({key: rows[key], "x": [p[0] for p in points], "y": [p[1] for p in points]})

    kind = zones.schema[key].dataType.simpleString()
    return zones.select(key, polygon).filter(F.exists(polygon, lambda r: F.size(r) >= 3)).mapInPandas(place, f"{key} {kind}, x double, y double")


def shared_edges_once(zones: DataFrame, key: str, polygon: str) -> DataFrame:
    """Boundary lines without doubles: each undirected edge once, with the first zone that has it and whether another shares it."""
    edges = zones.select(key, F.explode(polygon).alias("ring")).select(key, F.explode(_edges(F.col("ring"))).alias("e"))
    point = lambda p: F.struct(F.col(f"e.{p}.x").alias("x"), F.col(f"e.{p}.y").alias("y"))
    ends = edges.select(key, F.least(point("a"), point("b")).alias("p"), F.greatest(point("a"), point("b")).alias("q")).filter("p <> q")
    return ends.groupBy("p", "q").agg(F.min(key).alias(key), (F.countDistinct(key) > 1).alias("shared"))


#: Edges of neighbours so near are one line, and lines shorter than three times that are dropped.
EDGE_M = 2.0


def boundary_pieces(zones: DataFrame, key: str, polygon: str, near: float = EDGE_M) -> DataFrame:
    """key, ring, x, y, x2, y2: pieces (of half `near` at most) of zones' edges that separate two zones, each place once: a piece goes if an earlier zone (by key)
    has an edge within `near` of its middle, and if no other zone has one, as it is an outer edge then. Runs of pieces shorter than three times
    `near` are dropped."""
    edges = zones.select(key, F.posexplode(polygon).alias("r", "ring")).select(key, "r", F.posexplode(_edges(F.col("ring"))).alias("n", "e"))
    ends = [F.col(f"e.{p}.{c}") for p in "ab" for c in "xy"]
    long = F.hypot(ends[2] - ends[0], ends[3] - ends[1])
    count = F.greatest(F.ceil(long / (near / 2)), F.lit(1))
    cut = edges.withColumn("m", count).filter(long > 0).select(key, "r", "n", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("k"), *(e.alias(c) for e, c in zip(ends, ("ax", "ay", "bx", "by"), strict=True)))
    at = lambda c, k: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * k / F.col("m")
    pieces = cut.select(key, "r", "n", "k", at("x", F.col("k")).alias("x"), at("y", F.col("k")).alias("y"), at("x", F.col("k") + 1).alias("x2"), at("y", F.col("k") + 1).alias("y2"), at("x", F.col("k") + 0.5).alias("mx"), at("y", F.col("k") + 0.5).alias("my"))
    others = pieces.select(F.col(key).alias("__o"), F.col("mx").alias("ox"), F.col("my").alias("oy"))
    # middles of pieces of half `near` are within a quarter of it of every point of the piece
    met = radius_join(pieces, others, ("mx", "my"), ("ox", "oy"), near * 1.25).filter(F.col(key) != F.col("__o"))
    state = met.groupBy(key, "r", "n", "k").agg(F.min("__o").alias("__least"))
    kept = pieces.join(state, [key, "r", "n", "k"]).filter(F.col(key) < F.col("__least")).withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    order = Window.partitionBy(key, "r").orderBy("n", "k")
    fresh = F.coalesce((F.lag("x2").over(order) != F.col("x")) | (F.lag("y2").over(order) != F.col("y")), F.lit(True))
    runs = kept.withColumn("__new", fresh.cast("int")).withColumn("__run", F.sum("__new").over(order))
    whole = F.sum("length").over(Window.partitionBy(key, "r", "__run"))
    return runs.withColumn("__whole", whole).filter(F.col("__whole") >= 3 * near).select(key, F.col("r").alias("ring"), F.col("__run").cast("bigint").alias("line"), "x", "y", "x2", "y2")


def nearest_places(near: DataFrame, by: str, limit: int, same: float, same_project: float, preferred: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """by, id, place of stations (by, id, d2, x, y, project and maybe the `preferred` flag): the nearest that is in no place yet leads the next one, and all such ones
    near it (nearer than `same`, or `same_project` where either is projected) are in it too; up to `limit` places. A preferred station goes first. Columns of
    near that are `carried` follow."""
    first = F.when(F.col(preferred), -1.0).otherwise(F.col("d2").cast("double")) if preferred else F.col("d2").cast("double")
    out = near.withColumn("__order", F.struct(first.alias("d"), F.col("id"))).withColumn("place", F.lit(None).cast("bigint"))
    station = F.struct("__order", "x", "y", "project")
    group = Window.partitionBy(by)
    for n in range(limit):
        lead = F.min(F.when(F.col("place").isNull(), station)).over(group)
        out = out.withColumn("__lead", lead)
        apart = F.hypot(F.col("__lead.x") - F.col("x"), F.col("__lead.y") - F.col("y"))
        reach = F.when(F.col("__lead.project") | F.col("project"), float(same_project)).otherwise(float(same))
        out = out.withColumn("place", F.when(F.col("place").isNull() & (apart < reach), n).otherwise(F.col("place")))
    return out.filter("place IS NOT NULL").select(by, "id", "place", F.row_number().over(Window.partitionBy(by, "place").orderBy("__order")).alias("rank"), *carried)


def places_around(points: DataFrame, stations: DataFrame, by: str, a: tuple[str, str], b: tuple[str, str], station: str, project: str, radius: float, limit: int, same: float, same_project: float) -> DataFrame:
    """by, place, stations: the nearest places (as nearest_places has them) of the stations within the radius of each point, as ids from the nearest on.
    Stations at one spot with the same `project` flag are in the same places, so they go through the search as one, led by the least id."""
    spots = stations.groupBy(*b, project).agg(F.min(station).alias("id"), F.collect_list(station).alias("__ids"))
    near = radius_join(points.select(by, *(F.col(c).alias(f"__{i}") for i, c in enumerate(a))), spots, ("__0", "__1"), b, radius)
    near = near.select(by, "id", "d2", F.col(b[0]).alias("x"), F.col(b[1]).alias("y"), F.col(project).alias("project"), "__ids")
    found = nearest_places(near, by, limit, same, same_project, carried=("d2", "__ids"))
    each = found.select(by, "place", "d2", F.explode("__ids").alias("__id"))
    return each.groupBy(by, "place").agg(F.array_sort(F.collect_list(F.struct("d2", "__id")))["__id"].alias("stations"))


def distance2(polygon: Column, x: Column, y: Column) -> Column:
    """The squared distance of a point to a polygon; 0 inside."""

    def to_edge(e: Column) -> Column:
        a, dx, dy = e["a"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        length = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(length == 0, 1.0).otherwise(length)))
        px, py = x - a["x"] - t * dx, y - a["y"] - t * dy
        return px * px + py * py

    nearest_edge = F.array_min(F.transform(F.flatten(F.transform(polygon, _edges)), to_edge))
    return F.when(inside(polygon, x, y), 0.0).otherwise(nearest_edge)


def within_buffer(points: DataFrame, zones: DataFrame, x: str, y: str, polygon: str, radius: float) -> DataFrame:
    """Every point with every zone (columns left, bottom, right, top) that it is within the radius of: buckets and the box first, then the distance."""
    return _met(points, zones, x, y, radius).filter(distance2(F.col(polygon), F.col(x).cast("double"), F.col(y).cast("double")) <= radius * radius)


def grid_of(places: DataFrame) -> DataFrame:
    """places (left, bottom, right, top in Mercator metres) with their grid: grid_left, grid_top, width, height."""
    left, top = F.col("left") - GRID_MARGIN_M, F.col("top") + GRID_MARGIN_M
    size = lambda a, b: F.ceil((F.col(b) - F.col(a) + 2 * GRID_MARGIN_M) / CELL_M)
    return places.withColumn("grid_left", left).withColumn("grid_top", top).withColumn("width", size("left", "right")).withColumn("height", size("bottom", "top"))


def grid_cells(grids: DataFrame, key: str) -> DataFrame:
    """key, row, col, x, y (centres) of every cell of the grids."""
    rows = grids.select(key, "grid_left", "grid_top", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)).alias("row"))
    cells = rows.select(key, "grid_left", "grid_top", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)).alias("col"))
    return cells.select(key, "row", "col", (F.col("grid_left") + (F.col("col") + 0.5) * CELL_M).alias("x"), (F.col("grid_top") - (F.col("row") + 0.5) * CELL_M).alias("y"))
