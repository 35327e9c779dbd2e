import math

import pytest
from pyspark.sql import functions as F

from livgrid.functions import geo, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "folded", "local"), [("Saint-Maur-des-Fossés", "saintmaurdesfosses", "stmaurdesfosses"), ("L'Haÿ-les-Roses", "lhalesroses", "lhaylesroses"), ("Sainte Geneviève", "saintegenevieve", "stegenevieve"), ("Toussaint", "toussaint", "toussaint"), ("", "", "")])
def test_folding(spark, name, folded, local):
    assert one(spark, text.fold(F.lit(name))) == folded and one(spark, text.fold_local(F.lit(name))) == local


def test_search(spark):
    df = spark.createDataFrame([("Évry", "91228"), ("Paris", "75056")], "nom string, code string")
    hits = lambda q: [r["nom"] for r in df.filter(text.matches_search(F.col("nom"), F.col("code"), q)).collect()]
    assert hits("evr") == ["Évry"] and hits(" 750") == ["Paris"] and hits("--") == [] and hits("") == []


def test_labels_and_keys(spark):
    lit = F.lit
    assert [one(spark, text.timetable_label(lit(x))) for x in ("A", "N", "14", "7bis", "T3a", "TER", "", None)] == ["RER A", "Transilien N", "Métro 14", "Métro 7bis", "Tram T3a", "TER", "", ""]
    assert one(spark, text.line_label(lit("TRAM 3a"))) == "Tram T3a" and one(spark, text.tram_key(lit("3A"), lit(None).cast("string"))) == "tram3a"
    assert one(spark, text.project_station(lit("métro"), lit("15"), lit("Saint-Denis Pleyel"))) == "gpe-saintdenispleyel"
    assert [tuple(one(spark, text.line_order(lit(x))))[:2] for x in ("RER A", "Métro 7bis", "Tram T11", "Transilien P")] == [(0, 0), (2, 7), (3, 11), (1, 0)]
    assert one(spark, text.networks_to_compute(F.array(lit("tram3a"), lit("rer"), lit("gpe20271231")))) == ["rer", "transilien", "metro", "gpe20271231", "tram3a"]
    assert [one(spark, text.layer_group(lit(x))) for x in ("walk_rer", "bike_dest_defense_pointe", "no2", "lden_fer", "commune")] == ["transport", "destinations", "air", "bruit", "grille"]
    assert one(spark, text.with_district(lit("Batignolles"), lit("75117"))) == "Batignolles (75017)" and one(spark, text.with_district(lit("x"), lit(None).cast("string"))) == "x"
    assert one(spark, text.station_colour(lit("metro,gpe20271231"))) == "#e0a100" and one(spark, text.parent_zone(lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("clock", "seconds"), [("24:10:00", 87000), ("7:05:09", 25509), ("x", None), ("1:2", None), (None, None)])
def test_clock(spark, clock, seconds):
    assert one(spark, numbers.seconds_of_day(F.lit(clock).cast("string"))) == seconds


def test_rounding_is_half_even(spark):
    assert [one(spark, numbers.stored_seconds(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2] and one(spark, numbers.stored_seconds(F.lit(None).cast("double"))) == 65535
    assert one(spark, numbers.stored_tenths(F.lit(float("nan")))) == 0 and one(spark, numbers.stored_minutes(F.lit(99999.0))) == 254
    assert one(spark, numbers.shown_minutes(F.lit(629))) == 10 and one(spark, numbers.shown_minutes(F.lit(630))) == 11 and one(spark, numbers.shown_text(F.lit(65535))) == "plus d'1 h"
    assert one(spark, numbers.pollutant_band(F.lit(50), F.lit(5.0), F.lit(5.0))) == 1 and one(spark, numbers.price_colour(F.lit(12000))) == "#081d58"


@pytest.mark.parametrize(("lon", "lat", "x", "y"), [(2.3522, 48.8566, 652469.02, 6862035.26), (3.0, 46.5, 700000.0, 6600000.0)])
def test_national_grid(spark, lon, lat, x, y):
    got = one(spark, geo.to_l93(F.lit(lon), F.lit(lat)))
    assert abs(got.x - x) < 0.5 and abs(got.y - y) < 0.5
    back = one(spark, geo.from_l93(F.lit(got.x), F.lit(got.y)))
    assert math.isclose(back.lon, lon, abs_tol=1e-9) and math.isclose(back.lat, lat, abs_tol=1e-9)


def test_old_grid_and_mercator(spark):
    got = one(spark, geo.to_l2e(F.lit(2.3522), F.lit(48.8566)))
    assert abs(got.x - 601_100) < 500 and abs(got.y - 2_428_500) < 1500
    back = one(spark, geo.from_l2e(F.lit(got.x), F.lit(got.y)))
    assert math.isclose(back.lon, 2.3522, abs_tol=1e-6) and math.isclose(back.lat, 48.8566, abs_tol=1e-6)
    assert math.isclose(one(spark, geo.lat_of(geo.mercator_y(F.lit(48.8)))), 48.8, abs_tol=1e-9) and math.isclose(one(spark, geo.lon_of(geo.mercator_x(F.lit(2.3)))), 2.3)
    assert one(spark, geo.cell_area(F.lit(0), F.lit(7.5), F.lit(15.0))) == 225.0
