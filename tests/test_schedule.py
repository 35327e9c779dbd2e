import pytest
from pyspark.sql import functions as F

from livgrid.jobs import Rebuild
from livgrid.operators import raster, schedule, spatial
from livgrid.sources import readers, sinks


def member(spark, name, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in readers.GTFS[name]))


@pytest.fixture
def files(spark):
    week = lambda s, d: (s, "20240101", "20241231", *("1" if i == d else "0" for i in range(7)))
    return {
        "routes": member(spark, "routes", [("R", "14", "1"), ("B", "x", "3"), ("N", None, "2")]),
        "calendar": member(spark, "calendar", [week("tue", 1), week("wed", 2), week("gone", 1)]),
        "calendar_dates": member(spark, "calendar_dates", [("gone", "20240604", "2"), ("added", "20240604", "1"), ("wed", "20240605", "1")]),
        "trips": member(spark, "trips", [("R", "tue", "t1"), ("R", "added", "t2"), ("N", "tue", "t3"), ("B", "tue", "bus"), ("R", "wed", "t4"), ("R", "gone", "t5")]),
        "stop_times": member(spark, "stop_times", [(t, f"{h}:0{m}:00", f"{h}:0{m}:30", s, q) for t, h in (("t1", 8), ("t2", 9), ("t4", 8), ("t5", 8), ("bus", 8)) for m, s, q in ((0, "a", "9"), (5, "b", "10"), (9, "c", "11"))] + [("t3", "24:10:00", "24:10:00", "a", "1"), ("t3", "25:00:00", "25:00:00", "c", "2"), ("t3", "8:00:00", "8:00:00", "d", "0")]),
        "stops": member(spark, "stops", [("a", "A", "IDFM:ZA", "2", "48"), ("b", "B", None, "2", "48"), ("c", "C", "IDFM:ZC", "2", "48"), ("z", "Z", "IDFM:ZZ", "2", "48"), ("d", "D", "IDFM:ZD", "2", "48")]),
        "transfers": member(spark, "transfers", [("a", "a", "0"), ("a", "b", None), ("b", "a", "120"), ("a", "z", "60")]),
    }


def test_rail_timetable(files):
    conns, walks, stops = schedule.rail_timetable(files, "20240604")
    got = sorted((r["trip"], r["from_stop"], r["to_stop"], r["dep"], r["arr"], r["line"]) for r in conns.collect())
    assert got == [("t1", "a", "b", 28830, 29100, "14"), ("t1", "b", "c", 29130, 29340, "14"), ("t2", "a", "b", 32430, 32700, "14"), ("t2", "b", "c", 32730, 32940, "14"), ("t3", "d", "a", 28800, 87000, "")]
    assert sorted(map(tuple, walks.collect())) == [("a", "b", 0), ("b", "a", 120)]
    assert {r["stop"]: r["parent"] for r in stops.collect()} == {"a": "ZA", "b": "", "c": "ZC", "d": "ZD"}


def test_duration_table(spark, files):
    conns, walks, stops = schedule.rail_timetable(files, "20240604")
    goals = spark.createDataFrame([("centre", "ZC")], "dest string, zdc string")
    rows = {(r["period"], r["zdc"]): r for r in schedule.duration_table(conns.withColumn("scenario", F.lit("actuel")), walks, stops, goals).collect()}
    # minutes from 7:30 to 9:05:30: a walk of no time leads to the next platform, which is left at 8:05:30 and 9:05:30
    minutes = sorted((29340 if t <= 29130 else 32940) / 60 - t / 60 for t in range(27000, 32731, 60))
    assert rows["pointe", "ZA"]["median"] == round(minutes[len(minutes) // 2] if len(minutes) % 2 else (minutes[len(minutes) // 2 - 1] + minutes[len(minutes) // 2]) / 2, 1)
    assert rows["pointe", "ZA"]["line"] == "14" and rows["pointe", "ZC"]["median"] == 0.0 and ("journee", "ZA") not in rows


def test_buffer_and_grid(spark):
    zone = spark.createDataFrame([("Z", 0.0, 0.0, 10.0, 10.0)], "code string, left double, bottom double, right double, top double").withColumn("polygon", spatial.rectangle(*(F.col(c) for c in ("left", "bottom", "right", "top"))))
    points = spark.createDataFrame([(1, 13.0, 14.0), (2, 13.0, 14.1), (3, 5.0, 5.0), (4, -5.0, 5.0)], "i int, x double, y double")
    assert sorted(r["i"] for r in spatial.within_buffer(points, zone, "x", "y", "polygon", 5.0).collect()) == [1, 3, 4]
    grid = spatial.grid_of(zone)
    g = grid.first()
    assert (g["grid_left"], g["grid_top"], g["width"], g["height"]) == (-300.0, 310.0, 41, 41)
    cells = spatial.grid_cells(grid, "code")
    assert cells.count() == 41 * 41 and tuple(cells.filter("row = 0 AND col = 0").first())[3:] == (-292.5, 302.5)


def test_context_layers(spark):
    cells = spark.createDataFrame([(1, r, c, 20 if max(abs(r - 4), abs(c - 4)) <= 1 else 30 if max(abs(r - 4), abs(c - 4)) <= 3 else 0) for r in range(9) for c in range(9)], "zone long, row long, col long, v int")
    ranked = cells.withColumn("rank", raster.context_rank(F.col("v"), [30, 20])).select("zone", "row", "col", "rank")
    out = {r["level"]: max(r["x"]) - min(r["x"]) for r in raster.context_contours(ranked, ["zone"], "rank", 2).collect()}
    assert out[1] > out[2] > 2


def test_rebuild_goes_on_where_it_broke_off(spark, tmp_path):
    calls = []

    def build(todo):
        calls.append({r["code"]: r["groups"] for r in todo.collect()})
        if len(calls) == 1:
            raise OSError("no disk")
        return todo.select("code", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("walk_rer").alias("layer"), F.lit(len(calls)).alias("value"))

    job = Rebuild(spark, f"file://{tmp_path}", build)
    files = spark.createDataFrame([("osm", "A", "2020-01-01")], "source string, code string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    now = F.lit("2024-01-01").cast("timestamp")
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    assert [tuple(r) for r in job.plan(files, codes, now).collect()] == [("A", ["destinations", "transport"])]
    assert job.run() == {"A": "no disk"}
    fresh = files.withColumn("mtime", now)
    assert job.plan(fresh, codes, now).count() == 1 and job.run() == {} and job.pending().count() == 0
    assert calls[1] == {"A": ["destinations", "transport"]} and spark.read.parquet(f"file://{tmp_path}/layers").count() == 1


def test_places_leave_the_list_one_by_one(spark, tmp_path):
    def build(todo):
        codes = [r["code"] for r in todo.collect()]
        if "B" in codes:
            raise ValueError("damaged")
        return todo.select("code", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("no2").alias("layer"), F.lit(1).alias("value"))

    job = Rebuild(spark, f"file://{tmp_path}", build)
    files = spark.createDataFrame([("airparif", c, "2020-01-01") for c in "ABC"], "source string, code string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    job.plan(files, spark.createDataFrame([("A",)], "code string"), F.lit("2024-01-01").cast("timestamp"))
    assert job.run() == {"B": "damaged"} and [tuple(r) for r in job.pending().collect()] == [("B", ["air"])]
    assert {r["code"] for r in spark.read.parquet(f"file://{tmp_path}/layers").collect()} == {"A", "C"}
    there = spark.createDataFrame([("A", "air"), ("A", "bruit"), ("C", "air"), ("B", "air")], "code string, layer_group string")
    for _ in range(2):
        assert {r["code"]: r["groups"] for r in job.backfill("bruit", there).collect()} == {"B": ["air", "bruit"], "C": ["bruit"]}


def test_a_swap_that_breaks_off_loses_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1,)], "i int")
    sinks.swap(one, at)
    sinks.swap(one.withColumn("i", F.lit(2)), at)
    assert spark.read.parquet(at).first()[0] == 2 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")  # between the two renames, with a new table that is whole
    one.withColumn("i", F.lit(3)).write.parquet(at + ".new")
    assert sinks.settled(spark, at) and spark.read.parquet(at).first()[0] == 3 and not (tmp_path / "t.old").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")  # and with one that isn't
    (tmp_path / "t.new").mkdir()
    assert sinks.settled(spark, at) and spark.read.parquet(at).first()[0] == 3
    assert not sinks.settled(spark, f"file://{tmp_path}/none")
