import pytest
from pyspark.sql import functions as F

from livgrid.api import Engine
from livgrid.operators import spatial
from livgrid.sources import sinks


@pytest.fixture
def engine(spark, tmp_path):
    at = f"file://{tmp_path}"
    places = spark.createDataFrame([("A1", "Alpha", 10, 0.0), ("B1", "Beta-Alpha", None, 100.0)], "code string, nom string, population int, left double")
    places.withColumn("polygon", spatial.rectangle(F.col("left"), F.lit(0), F.col("left") + 100, F.lit(100))).write.parquet(f"{at}/communes")
    cells = [("A1", 0, 0, 1.0, 600, 50, 1, 50, 0, 3000), ("A1", 0, 1, 2.0, 65535, 60, 1, 70, 0, 0), ("B1", 0, 0, 4.0, 100, 0, 3, 0, 0, 9000)]
    sinks.write_cells(spark.createDataFrame(cells, "code string, row int, col int, area double, walk_rer int, no2 int, bp_noise int, lden_route int, lden_fer int, prix_maison int"), f"{at}/cells")
    layers = [("A1", 0, 0, "walk_tram3a", 900), ("A1", 0, 1, "walk_tram3a", 300), ("A1", 0, 0, "walk_dest_x_pointe", 70), ("A1", 0, 1, "walk_dest_x_pointe", 20)]
    sinks.write_layers(spark.createDataFrame(layers, "code string, row int, col int, layer string, value int"), f"{at}/layers")
    spark.createDataFrame([("osm", "A1", "2020-01-01"), ("dvf", None, "2020-01-01")], "source string, code string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp")).write.parquet(f"{at}/source_files")
    spark.createDataFrame([("A1", 15, {"air": 1})], "code string, format int, formats map<string,int>").write.parquet(f"{at}/meta")
    return Engine(spark, at)


def ok(engine, **request):
    return {r["code"]: r["ok"] for r in engine.stats({"codes": ["A1", "B1", "ZZ", "x'"]} | request).collect()}


def test_statistics(engine):
    assert ok(engine, networks=["rer"], walk=10) == {"A1": 1.0, "B1": 4.0}
    assert ok(engine, networks=["rer", "tram3a", "bus"], walk=10) == {"A1": 3.0, "B1": 4.0}
    assert ok(engine, networks=["rer"], air={"no2": 5.0}, bp=2, route=65) == {"A1": 1.0, "B1": 0.0}
    assert ok(engine, networks=["rer"], dest_key="x_pointe", dest_max=60) == {"A1": 2.0, "B1": 4.0}
    assert ok(engine, networks=["rer"], dest_key="none", prix_type="maison", prix_max=5000) == {"A1": 3.0, "B1": 0.0}
    assert engine.summary({"codes": ["A1", "B1"], "networks": ["rer"], "walk": 10}).first()["pct_ok"] == 71
    with pytest.raises(ValueError):
        engine.stats({"mode": "car"})


def test_hover_names_stations_neighbourhood_and_price(spark, engine):
    cells = engine.table("cells").withColumn("station_walk_rer", F.when(F.col("col") == 0, 1).otherwise(None).cast("int"))
    cells.write.partitionBy("code").parquet(engine.folder + "/more")
    table, engine.table = engine.table, lambda name: spark.read.parquet(f"{engine.folder}/{'more' if name == 'cells' else name}")
    stations = spark.createDataFrame([("A1", 0, "z0", "Zero"), ("A1", 1, "z1", "One"), ("B1", 1, "z9", "Other")], "code string, rank int, zdc string, nom string")
    parts = spark.createDataFrame([("A1", "North"), ("A1", "South")], "code string, nom string").withColumn("polygon", spatial.rectangle(F.lit(0), F.when(F.col("nom") == "North", 50).otherwise(0), F.lit(100), F.when(F.col("nom") == "North", 100).otherwise(50)))
    prices = spark.createDataFrame([("A1", None, "maison", 50, 4000), ("A1", "North", "maison", 3, None), ("A1", "South", "maison", 20, 5000)], "code string, nom string, type string, n int, med int")
    request = {"networks": ["rer"], "walk": 5, "air": {"no2": 4.0}, "prix_type": "maison", "prix_max": 2000}
    for y, name, price, fallback in ((70.0, "North", 4000, True), (20.0, "South", 5000, False)):
        r = engine.hover(request, "A1", 0, 0, (10.0, y), stations, parts, prices).first()
        assert (r["neighbourhood"], r["price"], r["price_fallback"], r["station_walk"]["nom"], r["best_walk"]["time"], r["best_bike"]) == (name, price, fallback, "One", 600, None)
        assert [(d["criterion"], d["value"], d["threshold"]) for d in r["details"]] == [("walk", 10.0, 5.0), ("no2", 5.0, 4.0), ("price", 3000.0, 2000.0)]
    assert engine.hover(request, "A1", 0, 1, stations=stations).first()["station_walk"] is None
    engine.table = table


def test_cells_are_kept_by_build(spark, engine):
    meta = spark.createDataFrame([("A1", 15, None, "2024-01-01")], "code string, format int, formats map<string,int>, built string")
    meta.write.mode("overwrite").parquet(engine.folder + "/meta")
    first = engine.place_cells("A1")
    assert engine.place_cells("A1") is first and first.count() == 2
    meta.withColumn("built", F.lit("2024-02-02")).write.mode("overwrite").parquet(engine.folder + "/meta")
    assert engine.place_cells("A1") is not first
    engine.delete("B1")
    assert {r["code"] for r in engine.table("cells").select("code").distinct().collect()} == {"A1"}


def test_look_ups(engine):
    assert [r["code"] for r in engine.search("alph").collect()] == ["A1", "B1"] and [r["code"] for r in engine.at(150, 50).collect()] == ["B1"]
    shown, total, most = engine.bbox(0, 0, 140, 100)
    assert [r["code"] for r in shown.collect()] == ["A1", "B1"] and total.first()["total"] == 2 and most == 12
    cell = engine.hover({"networks": ["rer"], "walk": 10, "route": 65}, "A1", 0, 1).first()
    assert cell["reasons"] == ["walk", "road"] and cell["noise"] == "70–75 dB" and engine.cell_of(20.0, 95.0, 0.0, 100.0) == (0, 1)
    now = F.lit("2024-01-01").cast("timestamp")
    assert {r["source"]: r["stale"] for r in engine.freshness(now).collect()} == {"osm": 1, "dvf": 1} and [tuple(r) for r in engine.to_refresh(now).collect()] == [("A1", ["transport"], ["osm"])]
    assert engine.to_rebuild().first()["groups"] == ["air", "bruit", "destinations", "grille", "transport"]
    engine.check_codes(["A1"])
    with pytest.raises(ValueError):
        engine.check_codes(["A1", "Q"])
