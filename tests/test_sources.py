import gzip
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from livgrid.operators import zones
from livgrid.sources import readers, sinks
from livgrid.streaming.areas import keep_areas


def geojson(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}} for p, t, c in features]}))
    return f"file://{path}"


SQUARE = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]


def test_contours_and_units(spark, tmp_path):
    p = geojson(tmp_path / "c.json", [({"code": "01001", "nom": "A", "codeDepartement": "01", "population": 5}, "Polygon", SQUARE), ({"code": "75056", "nom": "B", "codeDepartement": "75", "population": None}, "MultiPolygon", [SQUARE, [[[5, 5], [6, 5], [6, 7], [5, 5]]]])])
    rows = {r["code"]: r for r in readers.communes(spark, [p]).collect()}
    assert len(rows["01001"]["polygon"][0]) == 4 and len(rows["75056"]["polygon"]) == 2 and (rows["75056"]["right"], rows["75056"]["top"]) == (6.0, 7.0)
    u = geojson(tmp_path / "u.json", [({"code_iris": "751010101", "code_insee": "75101"}, "Polygon", SQUARE), ({"code_iris": "940800101", "code_insee": "94080"}, "Polygon", SQUARE)])
    assert readers.statistical_units(spark, u, "75056").count() == 1 and readers.statistical_units(spark, u, "94080", 1).count() == 1
    with pytest.raises(ValueError):
        readers.statistical_units(spark, u, "94080", 2)
    q = geojson(tmp_path / "q.json", [({"nom": " Vieux "}, "Polygon", SQUARE)])
    assert readers.neighbourhoods(spark, q, {"Vieux": "Neuf"}).first()["nom"] == "Neuf"


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id_mutation,x,date_mutation,nature_mutation,valeur_fonciere,code_commune,type_local,surface_reelle_bati,longitude,latitude\n1,z,2024-01-01,Vente,1,01001,Maison,1,,\n")
    assert readers.sales(spark, f"file://{tmp_path}/s.csv").first()["code_commune"] == "01001"
    years = spark.createDataFrame([('<a href="2019/"> <a href="2023/"> <a href="2021/"> <a href="2022/"> <a href="2023/">',)], "text string")
    assert readers.published_years(years).first()["years"] == ["2021", "2022", "2023"]
    s = geojson(tmp_path / "st.json", [({"mode": "RER", "res_com": "RER A", "id_ref_zdc": "1", "id_ref_zda": "2", "nom_zdc": "N"}, "Point", [2.0, 48.0]), ({"mode": "BUS", "res_com": "BUS 1", "id_ref_zdc": "1", "id_ref_zda": "2", "nom_zdc": "N"}, "Point", [2.0, 48.0])])
    assert [tuple(r["at"]) for r in readers.stations(spark, s).collect()] == [(2.0, 48.0)]
    (tmp_path / "a.csv").write_text("accid;accname;accisentry;accxespg2154;accyespg2154\n1;x;TRUE;5;6\n2;;false;5;6\n")
    (tmp_path / "r.csv").write_text("zdaid;accid\n9;1\n9;2\n")
    assert [(r["zdaid"], r["x"]) for r in readers.accesses(spark, f"file://{tmp_path}/a.csv", f"file://{tmp_path}/r.csv").collect()] == [("9", 5.0)]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 48.0, "lon": 2.0}, {"type": "way", "id": 5, "nodes": [1, 2], "tags": {"highway": "path"}}]}))
    (tmp_path / "p.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "nodes": [1, 2], "tags": {"highway": "path"}}]}))
    nodes, ways = readers.streets(spark, f"file://{tmp_path}/[op].json")
    assert nodes.count() == 1 and ways.first()["tags"] == {"highway": "path"} and ways.count() == 1


def test_timetable_archive(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("routes.txt", "route_type,route_id,route_short_name\n1,R,14\n")
        z.writestr("other.txt", "x\n")
    names = readers.unpack_timetable(data.getvalue(), lambda n, stream: (tmp_path / n).write_bytes(stream.read()))
    assert names == ["routes.txt"] and tuple(readers.timetable(spark, f"file://{tmp_path}", "routes").first()) == ("R", "14", "1")


def test_rasters(spark, tmp_path):
    values = np.arange(12, dtype="<u2").reshape(3, 4)
    (tmp_path / "l.bin.gz").write_bytes(gzip.compress(values.tobytes()))
    got = {(r["row"], r["col"]): r["value"] for r in readers.legacy_layer(spark, f"file://{tmp_path}/l.bin.gz", "uint16", 4).collect()}
    assert got == {(r, c): int(values[r, c]) for r in range(3) for c in range(4)}
    df = spark.createDataFrame([("62", "LD55")], "db_lo string, code string")
    assert df.select(readers.noise_level(["db_lo", "code"]).alias("x")).first()["x"] == 62 and df.select(readers.noise_level(["code"]).alias("x")).first()["x"] == 55


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}/layers"
    rows = [("A", 0, 0, "walk_rer", 5), ("A", 0, 0, "no2", 7), ("B", 0, 0, "walk_rer", 6), ("A", 0, 0, "walk_tram3a", 1), ("A", 0, 0, "walk_dest_x", 1)]
    df = spark.createDataFrame(rows, "code string, row int, col int, layer string, value int")
    assert sinks.packed(df).count() == 3
    sinks.write_layers(df, at)
    sinks.write_layers(df.filter("code = 'A' AND layer = 'no2'").withColumn("value", F.lit(9)), at)
    assert {(r["code"], r["layer"]): r["value"] for r in readers.layers(spark, at, ["A", "B"], ["no2", "walk_rer"]).collect()} == {("A", "walk_rer"): 5, ("A", "no2"): 9, ("B", "walk_rer"): 6}
    assert sinks.remove_place(spark, at, "B") and spark.read.parquet(at).filter("code = 'B'").count() == 0
    table = f"file://{tmp_path}/t"
    sinks.swap(df, table)
    sinks.swap(df.limit(1), table)
    assert spark.read.parquet(table).count() == 1
    st = spark.createDataFrame([("B", "1", "Z", ["l1", "l2"], ["rer"], 1.0, 2.0), ("A", "1", "Y", ["l1"], ["rer"], 1.0, 2.0)], "code string, zdc string, nom string, lines array<string>, networks array<string>, x double, y double")
    acc = spark.createDataFrame([("B", "1", "gate"), ("A", "1", "gate")], "code string, zdc string, nom_acces string")
    stations, accesses = sinks.index_of(st, acc)
    assert [r["nom"] for r in stations.collect()] == ["Y"] and accesses.count() == 1
    assert json.loads(sinks.station_features(st).first()["text"])["properties"]["lignes"] == "l1 + l2"
    cells = spark.createDataFrame([("A", 0, 1, 50, 40), ("A", 1, 0, 0, 0)], "code string, row int, col int, no2 int, lden_route int")
    meta = sinks.meta_row(cells, {"air": 9}, F.lit("now")).first()["meta"]
    assert (meta["width"], meta["height"], meta["air_min"], meta["coverage"], meta["formats"]) == (2, 2, 5.0, 500.0, {"air": 9})


def test_stream_keeps_areas_up_to_date(spark, tmp_path):
    schema = "commune string, area long, t int"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    cells = spark.readStream.schema(schema)
    for rows, ok in (([("A", 5, 10), ("A", 7, 700)], 5), ([("A", 3, 20)], 8)):
        put(rows)
        keep_areas(cells.parquet(f"file://{tmp_path}/in"), "commune", "area", zones.ZoneQuery(walk=10).criteria(F.col("t"), []), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").first()["ok"] == ok
