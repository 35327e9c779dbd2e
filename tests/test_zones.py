import pytest
from pyspark.sql import functions as F

from livgrid.operators import zones

COLUMNS = "commune string, area double, walk_rer int, no2 int, index int, road int, rail int, dest_x int, prix int"


@pytest.fixture
def cells(spark):
    rows = [
        ("A", 1.0, 629, 50, 2, 64, 0, 60, 0), ("A", 2.0, 630, 50, 2, 64, 0, 60, 5000), ("A", 4.0, 65535, 0, 0, 0, 0, 255, 0), ("B", 8.0, 10, 51, 3, 65, 75, 61, 5001),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def passes(cells, query, networks=("walk_rer",)):
    time = zones.best_time({n: F.col(n) for n in networks})
    out = zones.zone_areas(cells, "commune", "area", query.criteria(time, cells.columns)).collect()
    return {r["commune"]: r["ok"] for r in out}


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        (zones.ZoneQuery(walk=10), {"A": 1.0, "B": 8.0}),
        (zones.ZoneQuery(), {"A": 7.0, "B": 8.0}),
        (zones.ZoneQuery(air={"no2": 5.0}), {"A": 7.0, "B": 0.0}),
        (zones.ZoneQuery(index=2, road=65, rail=75), {"A": 7.0, "B": 0.0}),
        (zones.ZoneQuery(dest_key="x"), {"A": 3.0, "B": 0.0}),
        (zones.ZoneQuery(dest_key="missing"), {"A": 7.0, "B": 8.0}),
        (zones.ZoneQuery(dest_key="x; drop"), {"A": 7.0, "B": 8.0}),
        (zones.ZoneQuery(price_layer="prix", price_max=5000), {"A": 7.0, "B": 0.0}),
        (zones.ZoneQuery(price_layer="none", price_max=1), {"A": 7.0, "B": 8.0}),
    ],
)
def test_sentinels(cells, query, expected):
    assert passes(cells, query) == expected


def test_no_network_selected(cells):
    assert passes(cells, zones.ZoneQuery(walk=10), ()) == {"A": 0.0, "B": 0.0}
    assert passes(cells, zones.ZoneQuery(), ()) == {"A": 7.0, "B": 8.0}


def test_known_networks():
    assert zones.known_networks(["rer", "gpe20271231", "tram3a", "tram1_20281231", "gpe2027", "bus", "tram"]) == ["rer", "gpe20271231", "tram3a", "tram1_20281231"]
    assert zones.known_networks(["rer", "bus"], ("rer",)) == ["rer"]


def test_best_station_takes_the_first_of_equal_networks(spark):
    df = spark.createDataFrame([(5, 7, 5, 8), (65535, 1, 9, 2), (65535, 1, 65535, 2), (None, 1, 3, 4)], "a int, sa int, b int, sb int")
    got = df.select(zones.best_station({"a": (F.col("a"), F.col("sa")), "b": (F.col("b"), F.col("sb"))}).alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got] == [(5, 7), (9, 2), None, (3, 4)]


def test_reasons(cells):
    query = zones.ZoneQuery(walk=10, air={"no2": 5.0}, road=65)
    got = cells.select(zones.exclusion_reasons(query.criteria(F.col("walk_rer"), cells.columns)).alias("r")).collect()
    assert [r.r for r in got] == [[], ["walk"], ["walk"], ["air", "road"]]
