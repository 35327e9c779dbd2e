import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from livgrid.operators import catalog, graph, prices, profile, raster, sections, spatial, stations, timetable


def sale(deed, kind="Appartement", surface="50", price="250000", code="94080", nature="Vente", lon="2.4", lat="48.8"):
    return (deed, "2024-01-02", nature, price, code, kind, surface, lon, lat)


def test_sales_cleaning(spark):
    raw = [
        sale("keep"), sale("cellar"), sale("cellar", "Dépendance", "0"), sale("two"), sale("two"), sale("shop"), sale("shop", "Local industriel"), sale("small", surface="8.99"), sale("nine", surface="9", price="45000"),
        sale("low", price="49995"), sale("1000", price="50000"), sale("40000", price="2000000"), sale("high", price="2000005"), sale("zero", surface="0"), sale("paris", code="75117"), sale("gift", nature="Donation"), sale(None), sale("bad", surface="x"), sale("nowhere", lon=None, lat=None), sale("house", "Maison"),
    ]
    out = prices.clean_sales(spark.createDataFrame(raw, prices.SALES_SCHEMA)).collect()
    assert sorted(r["pm2"] for r in out) == sorted([5000, 5000, 5000, 1000, 40000, 5000, 5000, 5000])
    assert {r["code"] for r in out} == {"94080", "75056"} and sum(r["lon"] is None for r in out) == 1 and sum(r["type"] == "maison" for r in out) == 1


def test_price_statistics_need_enough_sales_and_round_half_even(spark):
    rows = [("A", "appartement", 125)] * 10 + [("B", "appartement", 135)] * 10 + [("C", "appartement", 100)] * 9
    out = {(r["code"], r["type"]): r for r in prices.price_statistics(spark.createDataFrame(rows, "code string, type string, pm2 int"), ["code"], ["appartement", "maison"]).collect()}
    assert out["A", "appartement"]["med"] == 120 and out["B", "appartement"]["med"] == 140 and out["C", "appartement"]["med"] is None and out["C", "appartement"]["n"] == 9
    assert out["A", "maison"]["n"] == 0 and len(out) == 6
    text = prices.prices_json(spark.createDataFrame(list(out.values())), ["code"]).filter("code = 'A'").first()["json"]
    assert '"appartement":{"n":10' in text and '"maison":{"n":0}' in text


def test_project_dates_match_null_phases_and_fall_back(spark):
    stops = spark.createDataFrame([(1, "op1", None), (2, "op1", "p2"), (3, "op1", "p9"), (4, "op3", None)], "id int, op string, ph string")
    dates = spark.createDataFrame([("op1", None, "2030-01-01"), ("op1", "p2", "2028-01-01"), ("op1", "p2", "2027-05-05")], "op string, ph string, d string")
    assert {r["id"]: r["date"] for r in stations.project_dates(stops, dates, "op", "ph", "d").collect()} == {1: "2030-01-01", 2: "2027-05-05", 3: "2027-05-05"}


def test_selected_networks(spark):
    rows = [("rer", "base", None, None), ("metro", "base", None, None), ("tram1", "tram", "1", None), ("gpe20271231", "project", None, "2027-12-31"), ("tram1_20281231", "extension", "1", "2028-12-31"), ("tram9_20271231", "extension", "9", "2027-12-31")]
    df = spark.createDataFrame(rows, "network string, kind string, line string, date string")
    got = lambda *a: {r["network"] for r in stations.selected_networks(df, *a).collect()}
    assert got(["rer"], ["1"], None) == {"rer", "tram1"} and got([], ["1"], "2028-12-31") == {"tram1", "gpe20271231", "tram1_20281231"} and got([], [], "2027-12-31") == {"gpe20271231"}


def test_services_and_connections(spark):
    regular, exceptions = spark.createDataFrame([("a",), ("b",)], "service string"), spark.createDataFrame([("b", 2), ("c", 1)], "service string, type int")
    assert {r["service"] for r in timetable.active_services(regular, exceptions).collect()} == {"a", "c"}
    rows = [("t", 9, "x", 10, 9), ("t", 10, "y", 20, 19), ("t", 11, "z", 30, 29), ("u", 1, "x", 5, 4)]
    out = timetable.connections(spark.createDataFrame(rows, "trip string, seq int, stop string, dep int, arr int"))
    assert sorted(tuple(r) for r in out.collect()) == [("t", "x", "y", 10, 19, 9), ("t", "y", "z", 20, 29, 10)]
    assert timetable.within_window(out, 29, 20).count() == 1 and timetable.within_window(out, 29, 19).count() == 0


def test_frontier_and_next_departure(spark):
    deps = spark.createDataFrame([("s", 10, 30), ("s", 20, 25), ("s", 20, 28), ("s", 40, 50), ("s", 35, 50)], "stop string, dep long, arr long")
    best = timetable.frontier(deps, ["stop"])
    assert sorted((r["dep"], r["arr"]) for r in best.collect()) == [(20, 25), (40, 50)]
    samples = spark.createDataFrame([("s", 20), ("s", 21), ("s", 41), ("q", 1)], "stop string, t long")
    got = {(r["stop"], r["t"]): (r["dep"], r["arr"]) for r in timetable.next_departure(samples, best, ["stop"], "t", "dep", ["arr"]).collect()}
    assert got == {("s", 20): (20, 25), ("s", 21): (40, 50), ("s", 41): (None, None), ("q", 1): (None, None)}


def test_durations(spark):
    rows = [("z", 0, 600, "B", False), ("z", 60, 600, "A", True), ("z", 120, 600, "A", False), ("z", 180, 600, "B", False), ("z", 240, None, "", False)]
    r = timetable.durations(spark.createDataFrame(rows, "zdc string, t long, arr long, line string, proj boolean"), ["zdc"]).first()
    assert (r["median"], r["p10"], r["p90"], r["line"], r["proj"]) == (8.5, 7.3, 9.7, "B", 0.25)


NEVER = 10**9


def slow_profiles(conns, walks, targets, stops, times):
    """Earliest arrival by exhaustive search over states, for each stop and time."""
    conns = sorted(conns, key=lambda c: (c[3], c[4]))

    def ride(i, seen):
        """The earliest end after taking connection i."""
        trip, _, b, _, arr, *_ = conns[i]
        best = NEVER
        for t in targets:
            best = min(best, arr if b == t else NEVER, *(arr + s for a, z, s in walks if a == b and z == t), NEVER)
        for j, c in enumerate(conns):
            if j in seen:
                continue
            if c[0] == trip and c[1] == b and c[3] >= arr or c[1] == b and c[3] >= arr + 60:
                best = min(best, ride(j, seen | {j}))
            elif any(a == b and z == c[1] and c[3] >= arr + 60 + s for a, z, s in walks):
                best = min(best, ride(j, seen | {j}))
        return best

    out = {}
    for stop in stops:
        for t in times:
            best = NEVER
            for i, c in enumerate(conns):
                if c[1] == stop and c[3] >= t or any(a == stop and z == c[1] and c[3] - s >= t for a, z, s in walks):
                    best = min(best, ride(i, {i}))
            out[stop, t] = best
    return out


@pytest.mark.parametrize("seed", range(6))
def test_profile_scan_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    stops = "abcde"
    conns = []
    for trip in range(5):
        t = rng.randrange(0, 900)
        here = rng.choice(stops)
        for _ in range(rng.randrange(1, 4)):
            there = rng.choice([s for s in stops if s != here])
            run = rng.randrange(60, 300)
            conns.append((trip, here, there, t, t + run, f"L{trip}", trip == 1))
            here, t = there, t + run + rng.randrange(1, 90)
    walks = [("a", "b", 120), ("b", "a", 120)]
    found = profile.scan(conns, walks, {"to e": ["e"], "to c or d": ["c", "d"], "nowhere": ["z"]})
    for dest, goals in (("to e", ["e"]), ("to c or d", ["c", "d"]), ("nowhere", ["z"])):
        for (stop, t), end in slow_profiles(conns, walks, goals, stops, range(0, 1200, 60)).items():
            assert min((arr for dep, arr, *_ in found.get((dest, stop), []) if dep >= t), default=NEVER) == end
    for own in found.values():  # none is dominated
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(own))


def test_profile_ties_prefer_the_path_without_projects():
    conns = [(1, "a", "t", 100, 200, "P", True), (2, "a", "t", 100, 200, "N", False)]
    assert profile.scan(conns, [], {"t": ["t"]})["t", "a"] == [(100, 200, "P", True)]  # of equal departures the first
    through = [(1, "a", "b", 0, 100, "L", False), (1, "b", "t", 160, 300, "L", False), (2, "b", "t", 160, 300, "P", True)]
    assert profile.scan(through, [], {"t": ["t"]})["t", "a"] == [(0, 300, "L", False)]
    change = [(1, "a", "b", 0, 100, "L", False), (2, "b", "t", 160, 300, "P", True), (3, "b", "t", 159, 200, "N", False)]
    assert profile.scan(change, [], {"t": ["t"]})["t", "a"] == [(0, 300, "L", True)]  # a change takes a minute


def test_profiles_of_many_destinations_and_scenarios(spark, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK", 2)
    rng = random.Random(9)
    rows = [(s, f"t{i}", 0, f"s{rng.randrange(6)}", f"s{rng.randrange(6)}", (t := rng.randrange(2000)), t + rng.randrange(60, 500), f"L{i % 3}", i % 4 == 0) for s in ("now", "then") for i in range(60)]
    conns = spark.createDataFrame(rows, "scenario string, trip string, seq int, from_stop string, to_stop string, dep long, arr long, line string, proj boolean")
    walks = spark.createDataFrame([("s0", "s1", 90), ("s1", "s0", 90)], "from_stop string, to_stop string, secs int")
    goals = spark.createDataFrame([(f"d{k}", f"s{k}") for k in range(6)] + [("d0", "s5")], "dest string, stop string")
    got = {(r["scenario"], r["dest"], r["stop"], r["dep"], r["arr"], r["line"], r["proj"]) for r in profile.profiles(conns, walks, goals, ["scenario"]).collect()}
    want = set()
    for s in ("now", "then"):
        own = sorted(((r[1], *r[3:]) for r in rows if r[0] == s), key=lambda r: r[0])
        for (dest, stop), deps in profile.scan(own, [("s0", "s1", 90), ("s1", "s0", 90)], {f"d{k}": [f"s{k}"] + ["s5"] * (k == 0) for k in range(6)}).items():
            want |= {(s, dest, stop, *x) for x in deps}
    assert got == want and want


def test_way_rules(spark):
    cases = [
        ({"highway": "motorway"}, False, None), ({"highway": "motorway", "foot": "yes"}, True, None), ({"highway": "residential", "access": "private"}, False, None), ({"highway": "residential", "access": "private", "foot": "yes", "bicycle": "yes"}, True, (15.0, 0)),
        ({"highway": "steps"}, True, None), ({"highway": "footway"}, True, (6.0, 0)), ({"highway": "residential", "oneway": "yes"}, True, (15.0, 1)), ({"highway": "residential", "oneway": "-1"}, True, (15.0, -1)),
        ({"highway": "tertiary", "junction": "roundabout"}, True, (15.0, 1)), ({"highway": "tertiary", "junction": "roundabout", "oneway": "no"}, True, (15.0, 0)), ({"highway": "residential", "oneway": "yes", "oneway:bicycle": "no"}, True, (15.0, 0)),
        ({"highway": "residential", "oneway": "yes", "cycleway:left": "opposite_lane"}, True, (15.0, 0)), ({"highway": "path", "foot": "use_sidepath", "bicycle": "use_sidepath"}, False, None), ({}, True, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, tags map<string,string>")
    for r in df.select("i", graph.walkable(F.col("tags")).alias("w"), graph.cycling(F.col("tags")).alias("b")).collect():
        assert (r.w, r.b and tuple(r.b)) == cases[r.i][1:], cases[r.i]


def test_edges_paths_and_cells(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 125.0), (3, 0.0, 125.0), (4, 1000.0, 0.0)], "id long, x double, y double")
    ways = spark.createDataFrame([(10, [1, 2, 9, 3], {"highway": "residential", "oneway": "yes"}), (11, [1, 2], {"highway": "footway"})], "id long, nodes array<long>, tags map<string,string>")
    edges = graph.mode_edges(graph.segments(ways, nodes))
    got = {(r["mode"], r["src"], r["dst"]): round(r["sec"], 2) for r in edges.collect()}
    assert got == {("walk", 1, 2): 100.0, ("walk", 2, 1): 100.0, ("walk", 2, 3): 0.01, ("walk", 3, 2): 0.01, ("bike", 1, 2): 30.0, ("bike", 2, 1): 75.0, ("bike", 2, 3): 0.01}
    walk = edges.filter("mode = 'walk'").drop("mode")
    start = spark.createDataFrame([(1, 0.0, 7), (3, 100.01, 8)], "node long, cost double, source long")
    out = {r["node"]: (round(r["dist"], 2), r["source"]) for r in graph.shortest_paths(walk, start, 150).collect()}
    assert out == {1: (0.0, 7), 2: (100.0, 7), 3: (100.01, 7)}
    near = spark.createDataFrame([("c", 2, 100.0), ("c", 1, 250000.0), ("far", 1, 1e9)], "cell string, node long, d2 double")
    times = graph.cell_times(near, graph.shortest_paths(walk, start, 150), 4.5, 3600).collect()
    assert [(r["cell"], round(r["time"]), r["source"]) for r in times] == [("c", 108, 7)]


def test_paths_and_components_equal_plain_ones(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 20)) for _ in range(150)]
    df = graph.fastest(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, sec double"), [])
    sources = [(0, 0.0, 1), (5, 2.0, 2)]
    got = {r["node"]: (r["dist"], r["source"]) for r in graph.shortest_paths(df, spark.createDataFrame(sources, "node long, cost double, source long"), 40).collect()}
    assert got == graph.heap_paths([tuple(r) for r in df.collect()], sources, 40)
    reach = lambda s, es: graph.heap_paths([(a, b, 0) for a, b, _ in es], [(s, 0, 0)], 1).keys()
    turned = [(b, a, w) for a, b, w in edges]
    comps = {frozenset(reach(s, edges) & reach(s, turned)) for s in {x for a, b, _ in edges for x in (a, b)}}
    assert {r["node"] for r in graph.main_component(df.select("src", "dst")).collect()} == max(comps, key=len)


def test_polygons(spark):
    hole = "array(array(named_struct('x',0D,'y',0D),named_struct('x',10D,'y',0D),named_struct('x',10D,'y',10D),named_struct('x',0D,'y',10D)),array(named_struct('x',4D,'y',4D),named_struct('x',6D,'y',4D),named_struct('x',6D,'y',6D),named_struct('x',4D,'y',6D)))"
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (4.5, 9.9)], "x double, y double").withColumn("p", F.expr(hole))
    assert [r.i for r in df.select(spatial.inside(F.col("p"), F.col("x"), F.col("y")).alias("i")).collect()] == [True, False, False, True]
    r = df.select(spatial.area(F.col("p")).alias("a"), spatial.share_in_view(F.col("p"), 5, 0, 20, 3).alias("s"), spatial.share_in_view(F.col("p"), 20, 20, 30, 30).alias("n")).first()
    assert (r.a, r.s, r.n) == (96.0, 0.15, 0.0)
    shape = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]
    x, y = spatial.label_point([shape], 0.01)
    assert math.dist((x, y), (math.sqrt(2) / (1 + math.sqrt(2)) * 2, math.sqrt(2) / (1 + math.sqrt(2)) * 2)) < 0.1 or (x <= 1.3 and y <= 1.3)
    # a hole with more vertices than its square, and a small part beside it
    hole = [(4 + math.cos(a), 5 + math.sin(a)) for a in (k * math.tau / 12 for k in range(12))]
    x, y = spatial.label_point([[(0, 0), (10, 0), (10, 10), (0, 10)], hole, [(20, 0), (21, 0), (21, 1)]], 0.01)
    assert math.dist((x, y), (4, 5)) > 2.5 and 0 < x < 10 and spatial.label_point([[(0, 0), (200, 0), (200, 200), (0, 200)]]) == (100.0, 100.0)


def test_points_on_a_boundary_are_not_inside(spark):
    square = spark.createDataFrame([("Z", 0.0, 0.0, 10.0, 10.0)], "code string, left double, bottom double, right double, top double").withColumn("polygon", spatial.rectangle(*(F.col(c) for c in ("left", "bottom", "right", "top"))))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 10.0, 5.0), (4, 5.0, 0.0), (5, 5.0, 10.0), (6, 0.0, 0.0), (7, None, 1.0), (8, 1e-9, 5.0)], "i int, x double, y double")
    assert sorted(r["i"] for r in spatial.points_in_zones(points, square, "x", "y", "polygon").collect()) == [1, 8]


def test_points_in_many_zones_equal_a_plain_search(spark):
    rng = random.Random(2)
    zones = [(i, *(lambda x, y, w: (x, y, x + w, y + w))(rng.randrange(-50, 300), rng.randrange(-50, 300), rng.choice((1, 5, 20, 400)))) for i in range(60)]
    points = [(i, float(rng.randrange(-60, 320)), float(rng.randrange(-60, 320))) for i in range(300)]
    z = spark.createDataFrame(zones, "z long, left long, bottom long, right long, top long").withColumn("polygon", spatial.rectangle(*(F.col(c) for c in ("left", "bottom", "right", "top"))))
    p = spark.createDataFrame(points, "i long, x double, y double")
    got = {(r["i"], r["z"]) for r in spatial.points_in_zones(p, z, "x", "y", "polygon").collect()}
    assert got == {(i, k) for i, x, y in points for k, a, b, c, d in zones if a < x < c and b < y < d}
    plan = spatial.points_in_zones(p, z, "x", "y", "polygon")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((" in plan and "__bx" in plan


def test_neighbourhoods_second_chance_fallback_and_abandonment(spark):
    # zone 2 lies within zone 1's units but has most of unit b; zone 3 has nothing of its own
    overlaps = [(1, "a", 10), (1, "b", 6), (2, "b", 5), (1, "c", 9), (3, "c", 2)]
    assert spatial.second_chances({"a": 1, "b": 1, "c": 1}, overlaps, {"a": 10, "b": 10, "c": 10}) == {"a": 1, "b": 2, "c": 1}
    assert spatial.second_chances({"b": 1}, [(1, "b", 6), (2, "b", 5)], {"b": 10}) == {"b": 1}  # its owner keeps none else
    strip = lambda name, a, b: [(0, c, name) for c in range(a, b)]
    units = spark.createDataFrame(strip(1, 0, 10) + strip(2, 10, 20) + strip(3, 20, 26), "row long, col long, unit long")
    zones = spark.createDataFrame(strip(1, 0, 10) + strip(2, 10, 19) + strip(3, 19, 40), "row long, col long, zone long")
    out = spatial.neighbourhoods(units, zones, "unit", "zone")
    assert {(r["unit"], r["zone"], r["fits"], r["abandoned"]) for r in out.collect()} == {(1, 1, True, False), (2, 2, True, False), (3, 3, False, False)}
    cells = {(r["col"], r["zone"]) for r in spatial.rebuilt_cells(units, zones, out, "unit", "zone", 20.0).collect()}
    assert cells == {(c, 1) for c in range(10)} | {(c, 2) for c in range(10, 20)} | {(c, 3) for c in range(20, 40)}
    far = spark.createDataFrame(strip(1, 0, 10) + strip(2, 10, 13) + strip(3, 13, 60), "row long, col long, zone long")
    worse = spatial.neighbourhoods(units, far, "unit", "zone")
    assert {r["abandoned"] for r in worse.collect()} == {True}
    assert spatial.rebuilt_cells(units, far, worse, "unit", "zone", 20.0).count() == 60
    two = spatial.neighbourhoods(units.withColumn("c", F.lit("x")).union(units.withColumn("c", F.lit("y"))), zones.withColumn("c", F.lit("x")), "unit", "zone", ("c",))
    assert {r["c"] for r in two.collect()} == {"x"}


def test_opening_drops_slivers(spark):
    cells = [(r, c, 1) for r in range(10) for c in range(10)] + [(4, c, 1) for c in range(10, 30)]
    zones = spark.createDataFrame(cells, "row long, col long, zone long")
    units = spark.createDataFrame([(50, 50, 7)], "row long, col long, unit long")
    owners = spark.createDataFrame([(7, 1, False, False)], "unit long, zone long, fits boolean, abandoned boolean")
    out = {(r["row"], r["col"]) for r in spatial.rebuilt_cells(units, zones, owners, "unit", "zone", 4.0).collect()}
    assert (5, 5) in out and not any(c > 12 for _, c in out)


def test_boundary_pieces(spark):
    z = spark.createDataFrame([(1, 0.0, 100.0), (2, 101.0, 200.0), (3, 300.0, 400.0)], "z int, left double, right double").withColumn("polygon", spatial.rectangle(F.col("left"), F.lit(0.0), F.col("right"), F.lit(100.0)))
    rows = spatial.boundary_pieces(z, "z", "polygon").collect()
    # only the edge that zones 1 and 2 share but for a metre, once
    assert {r["z"] for r in rows} == {1} and all(r["x"] >= 97 for r in rows) and 95 < sum(math.dist((r["x"], r["y"]), (r["x2"], r["y2"])) for r in rows) < 110


def test_clip_and_drawing(spark):
    df = spark.createDataFrame([(1,)], "i int").select(spatial.rectangle(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("p"), spatial.rectangle(F.lit(20), F.lit(0), F.lit(30), F.lit(10)).alias("q"), F.expr("array(named_struct('x',5D,'y',-5D),named_struct('x',15D,'y',5D),named_struct('x',5D,'y',15D),named_struct('x',-5D,'y',5D))").alias("c"))
    r = df.select(spatial.area(spatial.clipped_to(F.col("p"), F.col("c"))).alias("a"), F.size(spatial.clipped_to(F.col("q"), F.col("c"))).alias("n"), F.size(spatial.drawn(F.col("q"), F.array("p", "p"))).alias("d")).first()
    assert abs(r["a"] - 100.0) < 1e-9 and r["n"] == 0 and r["d"] == 3
    half = df.select(spatial.area(spatial.clipped_to(F.col("p"), F.expr("array(named_struct('x',0D,'y',0D),named_struct('x',10D,'y',0D),named_struct('x',10D,'y',10D))"))).alias("a")).first()
    assert abs(half["a"] - 50.0) < 1e-9


def test_nearest_of_points_without_coordinates(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (None, 1.0, 1.0), (5, 1e6, 0.0)], "i long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (8, None, None)], "j long, u double, v double")
    got = {r.i: (r.j, r.d2) for r in spatial.nearest(left, right, ("x", "y"), ("u", "v"), "i", "j", 2).collect()}
    assert got == {1: (7, 25.0), 5: (7, (1e6 - 3) ** 2 + 16)}
    assert spatial.nearest(left, right.filter("j = 8"), ("x", "y"), ("u", "v"), "i", "j", 2).count() == 0


def test_next_departure_takes_time_in_proportion(spark):
    def seconds(n):
        began = time.perf_counter()
        samples = spark.range(n).select(F.lit("s").alias("stop"), F.col("id").alias("t"))
        deps = spark.range(0, n, 7).select(F.lit("s").alias("stop"), F.col("id").alias("dep"), (F.col("id") + 5).alias("arr"))
        out = timetable.next_departure(samples, deps, ["stop"], "t", "dep", ["arr"])
        assert out.filter("dep < t OR dep - t > 6 OR arr <> dep + 5").count() == 0 and out.filter("dep IS NULL").count() <= 7
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(50_000), seconds(200_000)
    assert large < 6 * small + 3


def test_departures_of_varying_headway(spark):
    cases = [(first, last, peak, h, o) for first in (-100.5, 0.0, 55.0, 130.0, 500.0) for last in (90.0, 400.0) for peak in ((60, 200), (0, 0), (300, 290)) for h, o in ((10, 25), (7, 40))]
    for first, last, peak, h, o in cases:
        want, t = [], first
        while t <= last:
            want.append(t)
            t += h if peak[0] <= t <= peak[1] else o
        got = spark.range(1).select(timetable.departures(F.lit(first), F.lit(last), peak, F.lit(h), F.lit(o)).alias("d")).first()["d"]
        assert got == want, (first, last, peak, h, o)


def test_projected_lines_take_their_own_statistics_first(spark):
    sections_ = spark.createDataFrame([("T1", "tram", ["a", "b"], [500.0]), ("15", "métro", ["a", "b"], [1000.0]), ("T9", "tram", ["a", "b"], [500.0])], "label string, mode string, stops array<string>, metres array<double>")
    own = spark.createDataFrame([("T1", 18.0, 300.0, 600.0)], "line string, speed_kmh double, headway double, off_peak double")
    usual = spark.createDataFrame([("15", 36.0, 120.0, 240.0), ("tram", 9.0, 360.0, 700.0)], "of string, speed_kmh double, headway double, off_peak double")
    got = {r["label"]: (r["runs"], r["headway"], r["off_peak"]) for r in timetable.projected_lines(sections_, own, usual).collect()}
    assert got == {"T1": ([100.0], 300.0, 600.0), "15": ([100.0], 120.0, 240.0), "T9": ([200.0], 360.0, 700.0)}
    conns = timetable.estimated_timetable(timetable.projected_lines(sections_, own, usual), (0, 1000), (0, 500), 7)
    assert conns.count() == conns.select("trip").distinct().count() > 10 and conns.agg(F.min("trip")).first()[0] == 7


def test_long_lines_have_each_hop_once(spark):
    def seconds(n):
        line = spark.createDataFrame([("L", [str(k) for k in range(n + 1)], [10.0 + k % 3 for k in range(n)], 30, 60)], "label string, stops array<string>, runs array<double>, headway int, off_peak int")
        began = time.perf_counter()
        got = timetable.estimated_timetable(line, (0, 6000), (0, 3000), 5).groupBy("trip").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("m"), F.sum(F.col("arr") - F.col("dep")).alias("s"), F.min("dep").alias("first")).orderBy("trip").collect()
        took = time.perf_counter() - began
        total = sum(10 + k % 3 for k in range(n))
        starts, t = [], -total
        while t <= 6000:
            starts.append(t)
            t += 30 if 0 <= t <= 3000 else 60
        assert [tuple(r) for r in got] == [(5 + i, n, n, total, t) for i, t in enumerate(starts * 2)]
        return took

    seconds(20)
    # the same line is ten times longer and has six times the departures: by stops before each hop it would be some six hundred times the work
    assert seconds(2000) < 60

def test_groups_beyond_a_task_are_relaxed_by_rounds(spark):
    rng = random.Random(3)
    edges = [(g, rng.randrange(40), rng.randrange(40), float(rng.randrange(0, 9))) for g, n in (("a", 200), ("b", 12), (None, 150)) for _ in range(n)] + [("a", 1, 2, 99.0), ("b", 0, 3, 40.0)]
    sources = [(g, n, c, s) for g in ("a", "b", None, "c") for n, c, s in ((0, 0.0, 7), (0, 0.0, 4), (5, 2.0, 9), (6, 41.0, 1))]
    df = spark.createDataFrame(edges, "g string, src long, dst long, sec double")
    start = spark.createDataFrame(sources, "g string, node long, cost double, source long")
    want = {(g, n, *v) for g in ("a", "b", None, "c") for n, v in graph.heap_paths([e[1:] for e in edges if e[0] == g], [s[1:] for s in sources if s[0] == g], 20.0).items()}
    # 13 edges of b are few enough for a task, those of the two others aren't; then all are, then only a group without edges is
    for most in (20, 1000, 0):
        got = graph.grouped_paths(df, start, ["g"], 20.0, most)
        assert {(r["g"], r["node"], r["dist"], r["source"]) for r in got.collect()} == want and got.count() == len(want)

def test_points_and_places(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)]
    b = [(i, rng.uniform(-50, 400), rng.uniform(-50, 100)) for i in range(60)]
    left, right = spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, u double, v double")
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    got = {(r.i, r.j) for r in spatial.radius_join(left, right, ("x", "y"), ("u", "v"), 17).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if d2(p, q) <= 289}
    got = {r.i: r.j for r in spatial.nearest(left, right, ("x", "y"), ("u", "v"), "i", "j", 2).collect()}
    assert got == {p[0]: min(b, key=lambda q: d2(p, q))[0] for p in a}
    points = [(1, 4.0, 0, 2, False), (2, 9.0, 0, 3, False), (3, 100.0, 10, 0, True), (4, 400.0, 20, 0, False), (5, 10000.0, 100, 0, False)]
    df = spark.createDataFrame([("k", p[0], float(p[1]), float(p[2]), float(p[3]), p[4], p[0] == 5) for p in points], "k string, id long, d2 double, x double, y double, project boolean, pinned boolean")

    def places(*how):
        out = {}
        for r in spatial.nearest_places(df, "k", *how).orderBy("place", "rank").collect():
            out.setdefault(r["place"], []).append(r["id"])
        return list(out.values())

    assert places(2, 2, 15) == [[1, 2, 3], [4]] and places(2, 2, 5, "pinned") == [[5], [1, 2]]


def test_nearest_of_many_points_at_few_spots(spark):
    rng = random.Random(6)
    few = [(i, rng.randrange(8) * 1.0, rng.randrange(8) * 1.0) for i in range(40)] + [(98, None, 1.0), (99, 50.0, 50.0)]
    right = [(j, rng.randrange(8) * 1.0, rng.randrange(8) * 1.0) for j in range(400)] + [(400, 1.0, None)]
    want = {}
    for i, x, y in few:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in right[:-1]) if x is not None else []
        want |= {(i, n): (j, d) for n, (d, j) in enumerate([p for p in near if p[0] < 9][:5], 1)}
    df = spark.createDataFrame(right, "j long, u double, v double")
    got = spatial.knn_within(spark.createDataFrame(few, "i long, x double, y double"), df, ("x", "y"), ("u", "v"), "i", "j", 5, 3)
    assert got.columns == ["i", "x", "y", "j", "u", "v", "d2", "rank"]
    assert {(r.i, r["rank"]): (r.j, r.d2) for r in got.collect()} == want and len(want) == got.count() == 200
    # 40,000 points and 40,000 others at one spot: pair by pair it would be 1.6 billion
    began = time.perf_counter()
    crowd = lambda i, x, y: spark.range(40_000).select(F.col("id").alias(i), F.lit(1.0).alias(x), F.lit(2.0).alias(y))
    ranks = spatial.knn_within(crowd("i", "x", "y"), crowd("j", "u", "v"), ("x", "y"), ("u", "v"), "i", "j", 3, 1).groupBy("j", "rank", "d2").count().collect()
    assert sorted(map(tuple, ranks)) == [(0, 1, 0.0, 40_000), (1, 2, 0.0, 40_000), (2, 3, 0.0, 40_000)]
    assert time.perf_counter() - began < 30

def test_places_of_stations_at_one_spot(spark):
    rng = random.Random(5)
    stations = [(j, rng.randrange(6) * 10.0, rng.randrange(6) * 10.0, j % 7 == 0) for j in range(300)]
    points = [(f"p{i}", rng.uniform(-20, 80), rng.uniform(-20, 80)) for i in range(12)] + [("far", 900.0, 0.0), ("none", None, 0.0)]
    df, at = spark.createDataFrame(stations, "j long, u double, v double, planned boolean"), spark.createDataFrame(points, "k string, x double, y double")
    got = {(r["k"], r["place"]): r["stations"] for r in spatial.places_around(at, df, "k", ("x", "y"), ("u", "v"), "j", "planned", 35, 3, 12, 16).collect()}
    want = {}
    for k, x, y in points[:-1]:
        left = sorted(((x - u) * (x - u) + (y - v) * (y - v), j, u, v, p) for j, u, v, p in stations if (x - u) * (x - u) + (y - v) * (y - v) <= 35 * 35)
        for n in range(3):
            here = [s for s in left if math.hypot(left[0][2] - s[2], left[0][3] - s[3]) < (16 if left[0][4] or s[4] else 12)]
            if here:
                want[k, n] = [s[1] for s in here]
            left = [s for s in left if s not in here]
    assert got == want and len(want) > 20


def test_places_of_many_customers_at_few_spots(spark, tmp_path):
    from livgrid.plans import places

    few, many = tmp_path / "few", tmp_path / "many"
    for at, customers, suppliers in ((few, 50, 8000), (many, 40_000, 8000)):
        spark.range(customers).select((F.col("id") % 50 + F.floor(F.col("id") / 50) * 1000).alias("c_custkey"), F.lit(1).alias("c_nationkey")).write.parquet(f"{at}/customer.parquet")
        spark.range(suppliers).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{at}/supplier.parquet")
    one = {(r["c_custkey"], r["place"]): r["stations"] for r in places.nearest_places(spark, str(few)).collect()}
    began = time.perf_counter()
    got = {(r["c_custkey"], r["place"]): r["stations"] for r in places.nearest_places(spark, str(many)).collect()}
    # pair by pair it would be some 35 million stations in reach
    assert time.perf_counter() - began < 30
    assert got == {(c % 1000 + 1000 * i, place): s for (c, place), s in one.items() for i in range(800)} and one
    twice = tmp_path / "twice"
    spark.read.parquet(f"{few}/customer.parquet").union(spark.read.parquet(f"{few}/customer.parquet").filter("c_custkey = 7")).write.parquet(f"{twice}/customer.parquet")
    spark.read.parquet(f"{few}/supplier.parquet").write.parquet(f"{twice}/supplier.parquet")
    again = {(r["c_custkey"], r["place"]): r["stations"] for r in places.nearest_places(spark, str(twice)).filter("c_custkey IN (7, 8)").distinct().collect()}
    double = lambda s: "+".join(x for x in s.split("+") for _ in "ab")
    assert again == {(c, place): double(s) if c == 7 else s for (c, place), s in one.items() if c in (7, 8)}

def test_colours_majority_and_fill(spark):
    px = spark.createDataFrame([(75, 199, 30, 255), (75, 199, 31, 255), (75, 199, 0, 100), (75, 199, 0, 101)], "r int, g int, b int, a int")
    assert [r["level"] for r in px.select(raster.nearest_colour(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("level")).collect()] == [40, None, None, 40]
    votes = spark.createDataFrame([(0, 45), (0, 40), (1, None), (2, 50), (2, 50), (2, 40)], "cell int, v int")
    assert {r["cell"]: r["v"] for r in raster.majority(votes, ["cell"], "v").collect()} == {0: 40, 2: 50}
    line = spark.createDataFrame([(0, c, 60 if c == 0 else None) for c in range(7)], "row long, col long, v int")
    assert [r["v"] for r in raster.filled_levels(line, [], "v").orderBy("col").collect()] == [60, 60, 60, 60, 60, 0, 0]


def test_contours():
    square = [(((0, 0, True), (0.0, 0.5)), ((0, 0, False), (0.5, 0.0))), (((0, 0, False), (0.5, 0.0)), ((0, 1, True), (1.0, 0.5))), (((0, 1, True), (1.0, 0.5)), ((1, 0, False), (0.5, 1.0))), (((1, 0, False), (0.5, 1.0)), ((0, 0, True), (0.0, 0.5)))]
    (ring,) = raster.stitch(square)
    assert len(ring) == 4 and len(raster.chaikin(ring, 2)) == 16 and raster.stitch(square[:2]) == []
    wave = [(float(i), 0.01 * (i % 2)) for i in range(10)] + [(9.0, 5.0), (0.0, 5.0)]
    assert len(raster.simplified(wave, 0.1)) < len(wave) and raster.simplified(wave[:7], 0.1) == wave[:7] and raster.simplified(wave, 0) == wave
    assert raster.block_size(16, 15.0) == 1 and raster.block_size(10, 15.0) == 8


def test_contour_of_a_disc(spark):
    rows = [(1, r, c, 1.0 if math.hypot(r - 10, c - 10) < 6 else 0.0) for r in range(21) for c in range(21)]
    out = raster.contours(spark.createDataFrame(rows, "zone long, row long, col long, v double"), ["zone"], "v", 0.5).collect()
    assert len(out) == 1 and all(5 < math.hypot(x - 10, y - 10) < 7 for x, y in zip(out[0]["x"], out[0]["y"], strict=True))
    ring = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)],)], "r array<struct<x:double,y:double>>")
    assert len(ring.select(raster.chaikin_column(F.col("r")).alias("c")).first()["c"]) == 6


def test_sections():
    a = sections.Section((("s1", 0, 0), ("s2", 10, 0)), (10.0,), "op1")
    b = sections.Section((("s3", 30, 0), ("s2", 10, 0)), (20.0,), "op2")
    far, near = sections.Section((("s9", 9000, 0), ("s8", 9100, 0)), (100.0,), "op3"), sections.Section((("s5", 500, 0), ("s6", 600, 0)), (100.0,), "op1")
    (one,) = sections.joined([a, b], True)
    assert [s[0] for s in one.stops] == ["s1", "s2", "s3"] and one.metres == (10.0, 20.0)
    assert len(sections.joined([a, far], True)) == 2 and len(sections.joined([a, near], False)) == 1 and len(sections.joined([a, sections.Section(near.stops, near.metres, "op9")], False)) == 2
    lone, one = sections.joined([far, a, near, b], True)  # shared ends first, then the gaps from the narrowest on
    assert lone == far and [s[0] for s in one.stops] == ["s1", "s2", "s3", "s5", "s6"] and one.metres == (10.0, 20.0, 470 * 1.15, 100.0)
    stops = [("b", 10.0, 5.0, False), ("a", 0.0, 0.0, False), ("c", 30.0, -5.0, True)]
    on = sections.ordered(stops, [(0, 0), (100, 0)])
    assert [s[0] for s in on.stops] == ["a", "b", "c"] and on.metres == (10.0, 20.0)
    assert [s[0] for s in sections.ordered(stops, None).stops] == ["c", "b", "a"]
    assert [s[0] for s in sections.ordered(stops, [(0, 0), (5, 0)] * 2 + [(0, 9000)]).stops][0] in "abc"


def test_stops_go_along_a_track_that_is_drawn(spark):
    rows = [("tram", "9", "op", None, s, x, y, False) for s, x, y in (("a", 0.0, 0.0), ("b", 0.0, 100.0), ("c", 90.0, 100.0), ("d", 90.0, 0.0))]
    stops = spark.createDataFrame(rows, "mode string, line string, operation string, phase string, stop string, x double, y double, terminus boolean")
    tracks = spark.createDataFrame([("tram", "9", "op", None, [(90.0, 0.0), (90.0, 100.0), (0.0, 100.0), (0.0, 0.0)])], "mode string, line string, operation string, phase string, points array<struct<x:double,y:double>>")
    assert [(r["stop"], r["metres"]) for r in sections.routes(stops, tracks).orderBy("pos").collect()] == [("d", 100.0), ("c", 90.0), ("b", 100.0), ("a", None)]
    assert [r["metres"] for r in sections.routes(stops).orderBy("pos").collect()][:1] != [100.0]


def test_rebuild_rules(spark):
    assert catalog.groups_to_build(["transport"]) == ["destinations", "transport"] and catalog.groups_to_build(["grille"]) == sorted(catalog.FORMATS)
    now = F.lit("2024-07-01").cast("timestamp")
    files = spark.createDataFrame([("osm", "A", "2024-01-01"), ("osm", "B", "2023-12-31"), ("dvf", None, "2000-01-01"), ("airparif", "A", "2024-06-01")], "source string, code string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    pending = spark.createDataFrame([("C", None), ("B", ["air"])], "code string, groups array<string>")
    report = catalog.stale_groups(files, codes, now, pending, 182).collect()
    got = {r["code"]: r["groups"] for r in report}
    assert {r["code"]: r["reasons"] for r in report} == {"B": ["osm", "pending"], "C": ["pending"]}
    only = files.filter("code = 'B'").withColumn("source", F.lit("quartiers"))
    assert [tuple(r) for r in catalog.stale_groups(only, codes, now, None, 182).collect()] == [("B", [], ["quartiers"])]
    paths = spark.createDataFrame([("osm", None, (0, 1), "t01"), ("osm", None, (5, 5), "t55"), ("airparif", "A", None, "air"), ("idfm", None, None, "stations")], "source string, code string, tile struct<i:int,j:int>, path string")
    touched = spark.createDataFrame([("A", 0, 1), ("B", 0, 2)], "code string, i int, j int")
    assert sorted(tuple(r)[:3] for r in catalog.dependencies(codes.filter("code < 'C'"), touched, paths).collect()) == [("A", "airparif", "air"), ("A", "idfm", "stations"), ("A", "osm", "t01"), ("B", "idfm", "stations")]
    assert got == {"B": ["air", "transport"], "C": sorted(catalog.FORMATS)}  # a file exactly at the cut-off isn't stale
    shared = files.union(spark.createDataFrame([("communes", None, "2000-01-01")], "source string, code string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp")))
    assert all(r["groups"] == sorted(catalog.FORMATS) for r in catalog.stale_groups(shared, codes, now, None, 182).collect())
    meta = spark.createDataFrame([("A", 15, dict(catalog.FORMATS)), ("B", 15, {**catalog.FORMATS, "air": 8}), ("C", 10, None)], "code string, format int, formats map<string,int>")
    assert {r["code"]: r["groups"] for r in catalog.outdated_groups(meta).collect()} == {"B": ["air"], "C": ["transport"]}


def test_view_and_search(spark):
    rows = [("1", "Saint-Ouen", 50_000, 0.0), ("2", "Ouen", None, 70.0), ("3", "Ouenville", 10, 69.0)]
    df = spark.createDataFrame(rows, "code string, nom string, population int, left double").withColumn("polygon", spatial.rectangle(F.col("left"), F.lit(0), F.col("left") + 100, F.lit(100)))
    assert [r["code"] for r in catalog.search(df, "ouen").collect()] == ["3", "2", "1"]
    shown, total = catalog.in_view(df, "polygon", 0, 0, 100, 100)
    assert [r["code"] for r in shown.collect()] == ["1", "3", "2"] and total.first()["total"] == 3
    assert [r["code"] for r in catalog.at_point(df, "polygon", 150, 50).collect()] == ["2", "3"]
    known, unknown = catalog.known_and_unknown(spark.createDataFrame([("1",), ("9",)], "code string"), df)
    assert known.count() == 1 and unknown.first()["code"] == "9"
    assert catalog.tiles(0.0, 10.0, 149.0, 99.0, 50, 75, spark).count() == 4
