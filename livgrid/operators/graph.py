"""Road graphs: rules for ways, edges, reachability, shortest paths, and times of cells."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from livgrid.operators.written import Written

#: Layers of results that are kept apart before they are written as one.
LAYERS = 8

#: Edges of a group that one task searches with a heap, and nodes of a front that are sent to every task.
HEAP_EDGES, FRONT = 500_000, 200_000

#: Speeds in km/h, kinds of way, cut-offs.
WALK_KMH, BIKE_KMH, BIKE_SLOW_KMH = 4.5, 15.0, 6.0
NO_WALK = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway", "bus_guideway", "abandoned", "razed")
BIKE = ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "cycleway", "track", "road")
BIKE_SLOW = ("footway", "pedestrian", "path", "bridleway", "corridor")
ALLOWED, BARRED = ("yes", "designated", "permissive"), ("no", "private")
LEAST_EDGE_S, MOST_TIME_S, MOST_DOOR_S, MOST_APPROACH_M, NEAREST_NODES = 0.01, 3600, 7200, 300, 4


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def walkable(tags: Column) -> Column:
    """Whether a way is open on foot."""
    foot, access = _tag(tags, "foot"), _tag(tags, "access")
    allowed = foot.isin(*ALLOWED)
    return ~(_tag(tags, "highway").isin(*NO_WALK) & ~allowed) & ~foot.isin(*BARRED, "use_sidepath") & ~(access.isin(*BARRED) & ~allowed)


def cycling(tags: Column) -> Column:
    """speed (km/h) and direction (0 both ways, 1 along, -1 against the way) for a bike; null if barred."""
    highway, bicycle = _tag(tags, "highway"), _tag(tags, "bicycle")
    allowed = bicycle.isin(*ALLOWED)
    barred = bicycle.isin(*BARRED, "use_sidepath") | (highway == "steps") | _tag(tags, "access").isin(*BARRED) & ~allowed
    speed = F.when(highway.isin(*BIKE) | allowed, BIKE_KMH).when(highway.isin(*BIKE_SLOW), BIKE_SLOW_KMH)
    oneway = _tag(tags, "oneway")
    round_ = _tag(tags, "junction").isin("roundabout", "circular") & (oneway != "no")
    direction = F.when(oneway.isin("yes", "1", "true") | round_, 1).when(oneway == "-1", -1).otherwise(0)
    against = _tag(tags, "oneway:bicycle") == "no"
    for k in ("cycleway", "cycleway:left", "cycleway:right", "cycleway:both"):
        against = against | _tag(tags, k).startswith("opposite")
    return F.when(~barred & speed.isNotNull(), F.struct(speed.alias("speed"), F.when(against, 0).otherwise(direction).alias("direction")))


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, tags, src, dst, metres of each step between known nodes (id, x, y) of ways (id, nodes, tags). A node that isn't there is skipped."""
    from pyspark.sql import Window

    steps = ways.select(F.col("id").alias("way"), "tags", F.posexplode("nodes").alias("pos", "id")).join(nodes, "id")
    w = Window.partitionBy("way").orderBy("pos")
    steps = steps.select("way", "tags", F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return steps.filter(F.col("dst").isNotNull()).select("way", "tags", "src", "dst", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("metres"))


def mode_edges(steps: DataFrame) -> DataFrame:
    """mode, src, dst, sec: both ways on foot, by rule on a bike; of parallel edges the fastest."""
    bike = cycling(F.col("tags"))
    steps = steps.withColumn("__walk", walkable(F.col("tags"))).withColumn("__bike", bike)
    walk = steps.filter("__walk").withColumn("sec", F.col("metres") / (WALK_KMH / 3.6))
    ride = steps.filter("__bike IS NOT NULL").withColumn("sec", F.col("metres") / (F.col("__bike.speed") / 3.6))
    turn = lambda df, mode, a, b: df.select(F.lit(mode).alias("mode"), F.col(a).alias("src"), F.col(b).alias("dst"), "sec")
    every = turn(walk, "walk", "src", "dst").union(turn(walk, "walk", "dst", "src")).union(turn(ride.filter("__bike.direction >= 0"), "bike", "src", "dst")).union(turn(ride.filter("__bike.direction <= 0"), "bike", "dst", "src"))
    return fastest(every, ["mode"])


def fastest(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.groupBy(*by, "src", "dst").agg(F.greatest(F.min("sec"), F.lit(LEAST_EDGE_S)).alias("sec"))


class _Layers:
    """A table (key columns and b) that grows by written layers; the least b of a key counts. Every LAYERS of them become one."""

    def __init__(self, tables: Written, first: DataFrame, keys: list[str]):
        self.tables, self.keys, self.layers, self.oldest = tables, keys, [first], tables.n

    def whole(self) -> DataFrame:
        out = self.layers[0]
        for layer in self.layers[1:]:
            out = out.union(layer)
        return out

    def least(self) -> DataFrame:
        return self.layers[0] if len(self.layers) == 1 else self.whole().groupBy(*self.keys).agg(F.min("b").alias("b"))

    def add(self, layer: DataFrame) -> None:
        self.layers.append(layer)
        if len(self.layers) > LAYERS:
            merged = self.tables.cut(self.least())
            # the newest layer is the next front, so it stays
            self.tables.drop(self.oldest, self.tables.n - 2)
            self.layers, self.oldest = [merged], self.tables.n

    def better(self, offers: DataFrame) -> DataFrame:
        """The keys whose offer (key columns and b) beats what they have, in one aggregation over offers and layers."""
        b = offers.schema["b"].dataType
        both = offers.select(*self.keys, F.col("b").alias("o"), F.lit(None).cast(b).alias("b")).union(self.whole().select(*self.keys, F.lit(None).cast(b).alias("o"), "b"))
        both = both.groupBy(*self.keys).agg(F.min("o").alias("o"), F.min("b").alias("b"))
        return both.filter(F.col("o").isNotNull() & (F.col("b").isNull() | (F.col("o") < F.col("b")))).select(*self.keys, F.col("o").alias("b"))


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """node, dist, source: from the nearest of several sources (node, cost, source) along edges (src, dst, sec of 0 or more), up to the limit. Equal
    distances take the least source. Each round relaxes the edges out of the nodes that got better; it ends when none does, as it must where no
    way gets shorter by going on."""
    tables = Written(edges.sparkSession, "paths")
    edges = tables.cut(edges.filter((F.col("sec") >= 0) & (F.col("sec") <= limit)).select("src", "dst", "sec"))
    return _relaxed(tables, edges, sources, [], limit)


def _relaxed(tables: Written, edges: DataFrame, sources: DataFrame, by: list[str], limit: float) -> DataFrame:
    """The same over written edges, for every group (`by`) at once: by, node, dist, source."""
    keys = [*by, "node"]
    start = sources.filter(F.col("cost") <= limit).groupBy(*keys).agg(F.min(F.struct(F.col("cost").alias("dist"), "source")).alias("b"))
    front = tables.cut(start)
    best = _Layers(tables, front, keys)
    out = edges.select(*(F.col(k).alias(f"__{k}") for k in by), "src", "dst", "sec")
    same = F.col("node") == F.col("src")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    while (n := front.limit(FRONT + 1).count()) > 0:
        # a front that each task can hold spares the edges a shuffle
        met = (F.broadcast(front) if n <= FRONT else front).join(out, same)
        offers = met.select(*by, F.col("dst").alias("node"), F.struct((F.col("b.dist") + F.col("sec")).alias("dist"), F.col("b.source").alias("source")).alias("b"))
        front = tables.cut(best.better(offers.filter(F.col("b.dist") <= limit)))
        best.add(front)
    return best.least().select(*keys, "b.dist", "b.source")


def heap_paths(edges: list[tuple], sources: list[tuple], limit: float) -> dict:
    """The same in one process, with a heap: for a graph that fits a task."""
    out: dict = {}
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    queue = [(c, s, n) for n, c, s in sources if c <= limit]
    heapq.heapify(queue)
    while queue:
        d, s, n = heapq.heappop(queue)
        if n in out:
            continue
        out[n] = (d, s)
        for b, w in near.get(n, ()):
            if b not in out and d + w <= limit:
                heapq.heappush(queue, (d + w, s, b))
    return out


def grouped_paths(edges: DataFrame, sources: DataFrame, by: list[str], limit: float, most: int = HEAP_EDGES) -> DataFrame:
    """by, node, dist, source: one heap search a group (a municipality, mode and network), each in its own task, over edges and costs of 0 or more. Groups of
    more than `most` edges within the limit don't fit a task; they are relaxed by rounds, all of them together."""
    tables = Written(edges.sparkSession, "groups")
    edges = tables.cut(edges.filter((F.col("sec") >= 0) & (F.col("sec") <= limit)).select(*by, "src", "dst", F.col("sec").cast("double").alias("sec")))
    sources = sources.select(*by, "node", F.col("cost").cast("double").alias("cost"), "source")
    large = tables.cut(edges.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(*(F.col(k).alias(f"__{k}") for k in by)))
    if large.isEmpty():
        return _heaped(edges, sources, by, limit)
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    pick = lambda df, how: df.join(large, same, how)
    rounds = _relaxed(tables, edges, pick(sources, "left_semi"), by, limit)
    return rounds.union(_heaped(pick(edges, "left_anti"), pick(sources, "left_anti"), by, limit))


def _heaped(edges: DataFrame, sources: DataFrame, by: list[str], limit: float) -> DataFrame:
    """by, node, dist, source: by a heap search a group."""
    both = edges.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("sec").alias("w"), F.lit(0).alias("kind")).union(sources.select(*by, F.col("node").alias("a"), F.col("source").alias("b"), F.col("cost").alias("w"), F.lit(1).alias("kind")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = lambda k: list(rows.loc[rows["kind"] == k, ["a", "b", "w"]].itertuples(index=False, name=None))
        found = heap_paths(part(0), [(a, w, b) for a, b, w in part(1)], limit)
        key = [rows[k].iloc[0] for k in by]
        return pd.DataFrame([(*key, n, d, s) for n, (d, s) in found.items()], columns=[*by, "node", "dist", "source"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema if f.name in by)
    return both.groupBy(*by).applyInPandas(run, f"{kinds}, node long, dist double, source long")


def reachable(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, node: the nodes that edges (by, src, dst) lead to from the seeds (by, node), themselves included; for every `by` at once."""
    tables = Written(edges.sparkSession, "reach")
    keys = [*by, "node"]
    edges = tables.cut(edges.select(*by, "src", "dst"))
    front = tables.cut(seeds.select(*keys).distinct().withColumn("b", F.lit(0)))
    seen = _Layers(tables, front, keys)
    while not front.isEmpty():
        ends = front.withColumnRenamed("node", "src").join(edges, [*by, "src"]).select(*by, F.col("dst").alias("node"), F.lit(0).alias("b"))
        front = tables.cut(seen.better(ends))
        seen.add(front)
    return seen.least().select(*keys)


def main_component(edges: DataFrame) -> DataFrame:
    """node: the largest strongly connected component. Forward and backward reach, as one search, from the node with the most edges; while that is at most
    half of what is left, it is set aside and the rest searched; of components set aside and found the largest wins (the first of equal ones)."""
    tables = Written(edges.sparkSession, "component")
    left, best, size = tables.cut(edges.select("src", "dst")), None, 0
    while True:
        degree = tables.cut(left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).groupBy("node").count())
        n = degree.count()
        if not n or n <= size:
            return best if best is not None else degree.select("node")
        seed = degree.orderBy(F.desc("count"), "node").limit(1).select("node")
        ways = left.withColumn("back", F.lit(False)).union(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")))
        both = reachable(ways, seed.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True)))), ("back",))
        found = tables.cut(both.groupBy("node").agg(F.count("*").alias("n")).filter("n = 2").select("node"))
        m = found.count()
        if m > size:
            best, size = found, m
        if 2 * m > n:
            return best
        out = found.withColumnRenamed("node", "__n")
        left = tables.cut(left.join(out, F.col("src") == F.col("__n"), "left_anti").join(out, F.col("dst") == F.col("__n"), "left_anti"))


def cell_times(near: DataFrame, node_times: DataFrame, speed_kmh: float, limit: float, cell: str = "cell") -> DataFrame:
    """cell, time, source: the least of the nearest nodes' times and the way to them (near: cell, node, d2); null beyond the limit."""
    both = near.join(node_times, "node").withColumn("t", F.col("dist") + F.sqrt("d2") / (speed_kmh / 3.6))
    best = both.groupBy(cell).agg(F.min(F.struct(F.col("t").alias("time"), "source")).alias("b"))
    return best.filter(F.col("b.time") <= limit).select(cell, "b.time", "b.source")


def source_costs(accesses: DataFrame, transit: DataFrame, station: str, cost: str) -> DataFrame:
    """Accesses with their station's transit time as the cost they start from; stations without one drop out."""
    return accesses.join(transit.filter(F.col(cost).isNotNull()), station)
