import json

from pyspark.sql import functions as F

from livgrid.functions import numbers
from livgrid.operators import raster, sections, spatial, stations
from livgrid.sources import readers


def geojson(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": k, "coordinates": c}} for p, k, c in features]}))
    return f"file://{path}"


def test_projected_lines_from_their_files(spark, tmp_path):
    stop = lambda mode, line, name, phase, x, y: ({"mode": mode, "indice": line, "nom_arret": name, "id_operati": "op", "phase": phase, "terminus": "0"}, "Point", [x, y])
    track = lambda line, phase, when, kind, points: ({"mode": "tram", "indice": line, "id_operati": "op", "phase": phase, "mes_estime": when}, kind, points)
    stops = geojson(tmp_path / "stops.json", [stop("tram", "9", n, None, x, y) for n, x, y in (("A b", 0, 0), ("Éc", 0, 100), ("d", 90, 100), ("e", 90, 0))] + [stop("métro", "4", "old", None, 0, 0), stop("métro", "15", "Saint-Denis Pleyel", "1", 1, 2)])
    tracks = geojson(tmp_path / "tracks.json", [track("9", None, "2028-12-31T23:30:00Z", "MultiLineString", [[[5, 5], [6, 6]], [[90, 0], [90, 100], [0, 100], [0, 0]]]), track("10", "x", None, "LineString", [[0, 0], [1, 1]])])
    s, t = readers.project_stops(spark, stops), readers.project_tracks(spark, tracks)
    assert {(r["line"], r["phase"], r["nom"], r["stop"]) for r in s.collect()} >= {("15", "1", "Saint-Denis Pleyel", "gpe-saintdenispleyel"), ("9", None, "Éc", "tram9-ec")} and s.count() == 5
    assert {(r["line"], r["date"], len(r["points"])) for r in t.collect()} == {("9", "2028-12-31", 4), ("10", None, 2)}
    dated = stations.project_dates(s, t.filter("date IS NOT NULL").select("operation", "phase", F.col("date").alias("day")), "operation", "phase", "day")
    assert {r["date"] for r in dated.collect()} == {"2028-12-31"}
    order = sections.routes(s.filter("line = '9'"), t.filter("line = '9'")).orderBy("pos").collect()
    assert [(r["stop"], r["metres"]) for r in order] == [("tram9-e", 100.0), ("tram9-d", 90.0), ("tram9-ec", 100.0), ("tram9-ab", None)]


def test_dates(spark):
    df = spark.createDataFrame([(1_704_063_600, "2023-12-31T23:59:59Z"), (None, None)], "s long, t string")
    rows = df.select(numbers.epoch_date(F.col("s"), "Europe/Paris").alias("e"), numbers.iso_date(F.col("t").cast("timestamp")).alias("i")).collect()
    assert [tuple(r) for r in rows] == [("2024-01-01", "2023-12-31"), (None, None)]


def test_catalogue_of_networks(spark):
    rows = [("1", "tram", None), ("3a", "tram", None), ("1", "extension", "2028-12-31"), ("15", "project", "2026-06-30"), ("16", "project", "2035-01-01"), (None, "base", None)]
    networks = spark.createDataFrame(rows, "line string, kind string, date string")
    scenarios = spark.createDataFrame([("actuel", None), ("2031", "2031-12-31"), ("2027", "2027-12-31")], "scenario string, opens string")
    r = stations.catalogue_of_networks(networks, scenarios).first()
    assert r["tram_lines"] == ["1", "3a"] and r["dates"] == ["2026-06-30", "2028-12-31", "2035-01-01"] and r["dates_of_line"] == {"1": ["2028-12-31"]} and r["scenarios"] == ["2027", "2031"]
    assert [x["date"] for x in stations.offered_dates(networks, "2031-12-31").collect()] == ["2026-06-30", "2028-12-31"]


def test_cells_of_points(spark):
    grids = spatial.grid_of(spark.createDataFrame([("A", 0.0, 0.0, 60.0, 60.0), ("B", 30.0, 0.0, 90.0, 60.0)], "code string, left double, bottom double, right double, top double"))
    mask = spatial.grid_cells(grids, "code").filter((F.col("x") >= 0) & ((F.col("code") == "B") | (F.col("x") < 45))).select("code", "row", "col")
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 40.0, 10.0), (3, 80.0, 10.0), (4, 500.0, 0.0), (5, None, 1.0)], "i int, px double, py double")
    assert {(r["i"], r["code"]) for r in spatial.cell_lookup(points, grids, mask, "i", "px", "py").collect()} == {(1, "A"), (2, "A"), (3, "B")}


def test_isochrone_is_of_the_own_cells(spark):
    rows = [("Z", r, c, 100 if 2 <= r <= 8 and 2 <= c <= 8 else 900, c <= 6) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, "zone string, row long, col long, time int, own boolean")
    (ring,) = raster.isochrone(df, ["zone"], "time", 600, "own").collect()
    assert 6 < max(ring["x"]) < 7 and 8 < max(ring["y"]) < 9
