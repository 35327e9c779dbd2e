"""Readers of the engine's inputs, with explicit schemas: nothing is inferred, and codes keep their leading zeros."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from livgrid.functions import numbers, text
from livgrid.operators.prices import SALES_SCHEMA
from livgrid.operators.stations import LINE_CODE, entry_accesses, is_project_stop

#: Members of a timetable archive and the columns that are read of each.
GTFS = {
    "routes": ("route_id", "route_short_name", "route_type"),
    "calendar": ("service_id", "start_date", "end_date", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "stops": ("stop_id", "stop_name", "parent_station", "stop_lon", "stop_lat"),
    "transfers": ("from_stop_id", "to_stop_id", "min_transfer_time"),
}
_GEOMETRY = "struct<type:string,coordinates:string>"
YEARS_KEPT = 3


def _strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The features of GeoJSON files: their properties (a DDL string) and geometry type and coordinates (as JSON text)."""
    df = spark.read.schema(f"features array<struct<properties:struct<{properties}>,geometry:{_GEOMETRY}>>").option("multiLine", True).json(path)
    return df.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def rings(geometry: Column) -> Column:
    """All rings of a Polygon or MultiPolygon, as arrays of (x, y); the closing vertex is dropped."""
    polygon = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    multi = F.flatten(F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>"))
    points = F.when(geometry["type"] == "Polygon", polygon).when(geometry["type"] == "MultiPolygon", multi)
    return F.transform(points, lambda ring: F.transform(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def point(geometry: Column) -> Column:
    at = F.from_json(geometry["coordinates"], "array<double>")
    return F.struct(F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"))


def project_stops(spark: SparkSession, path: str) -> DataFrame:
    """mode, line, operation, phase, stop (a projected station's identifier), nom, terminus, x, y of the stops of projected metro and tram lines."""
    df = features(spark, path, "mode:string,indice:string,nom_arret:string,id_operati:string,phase:string,terminus:string")
    df = df.filter(F.coalesce(is_project_stop(F.col("mode"), F.col("indice")), F.lit(False))).withColumn("p", point(F.col("geometry")))
    terminus = F.coalesce(F.lower("terminus").isin("1", "true", "oui"), F.lit(False))
    return df.select("mode", F.col("indice").alias("line"), F.col("id_operati").alias("operation"), "phase", text.project_station(F.col("mode"), F.col("indice"), F.col("nom_arret")).alias("stop"), F.col("nom_arret").alias("nom"), terminus.alias("terminus"), "p.x", "p.y")


def project_tracks(spark: SparkSession, path: str) -> DataFrame:
    """mode, line, operation, phase, date (of the opening expected, null if none), points of the drawn projected lines; of a MultiLineString the longest line."""
    df = features(spark, path, "mode:string,indice:string,id_operati:string,phase:string,mes_estime:string")
    df = df.filter(F.coalesce(is_project_stop(F.col("mode"), F.col("indice")), F.lit(False)))
    one = F.array(F.from_json(F.col("geometry.coordinates"), "array<array<double>>"))
    lines = F.when(F.col("geometry.type") == "LineString", one).when(F.col("geometry.type") == "MultiLineString", F.from_json(F.col("geometry.coordinates"), "array<array<array<double>>>"))
    longest = F.array_max(F.transform(lines, lambda x: F.struct(F.size(x).alias("n"), x.alias("x"))))["x"]
    points = F.transform(longest, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return df.select("mode", F.col("indice").alias("line"), F.col("id_operati").alias("operation"), "phase", numbers.iso_date(F.col("mes_estime").try_cast("timestamp")).alias("date"), points.alias("points"))


def communes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """code, nom, codeDepartement, population, polygon and its box, of contour files by department."""
    df = features(spark, paths, "code:string,nom:string,codeDepartement:string,population:bigint").withColumn("polygon", rings(F.col("geometry"))).drop("geometry")
    flat = F.flatten("polygon")
    bound = lambda agg, axis: agg(F.transform(flat, lambda p: p[axis]))
    return df.select("*", bound(F.array_min, "x").alias("left"), bound(F.array_min, "y").alias("bottom"), bound(F.array_max, "x").alias("right"), bound(F.array_max, "y").alias("top"))


def neighbourhoods(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """nom (stripped and renamed), polygon."""
    nom = F.trim("nom")
    if names:
        nom = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), nom), nom)
    return features(spark, path, "nom:string").select(nom.alias("nom"), rings(F.col("geometry")).alias("polygon"))


def statistical_units(spark: SparkSession, path: str, code: str, expected: int | None = None) -> DataFrame:
    """code_iris, code_insee, polygon of a municipality (all districts of the capital); an incomplete reply is an error."""
    df = features(spark, path, "code_iris:string,code_insee:string")
    df = df.filter(F.col("code_insee").startswith("751") if code == "75056" else F.col("code_insee") == code)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} of {expected} units")
    return df.select("code_iris", "code_insee", rings(F.col("geometry")).alias("polygon"))


def sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales files, all columns text; with folders year=/dep= those columns come along."""
    names = [f.name for f in SALES_SCHEMA]
    raw = spark.read.option("header", True).csv(path, enforceSchema=False, inferSchema=False)
    return raw.select(*names, *(c for c in ("year", "dep") if c in raw.columns))


def published_years(listing: DataFrame, text: str = "text") -> DataFrame:
    """years: the last years that a page of links names, in order."""
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(text, F.lit(r'href="(\d{4})/"'), F.lit(1))))))
    return listing.agg(found.alias("years")).select(F.slice("years", F.greatest(F.size("years") - YEARS_KEPT + 1, F.lit(1)), YEARS_KEPT).alias("years"))


def stations(spark: SparkSession, path: str) -> DataFrame:
    df = features(spark, path, "mode:string,res_com:string,id_ref_zdc:string,id_ref_zda:string,nom_zdc:string")
    return df.filter(F.col("res_com").rlike(LINE_CODE)).withColumn("at", point(F.col("geometry"))).drop("geometry")


def accesses(spark: SparkSession, path: str, relations: str) -> DataFrame:
    """Entries with the zones that they serve."""
    read = lambda p, names: spark.read.schema(_strings(names)).option("header", True).option("sep", ";").csv(p)
    entries = entry_accesses(read(path, ("accid", "accname", "accisentry", "accxespg2154", "accyespg2154")))
    return entries.join(read(relations, ("zdaid", "accid")), "accid").withColumn("x", F.col("accxespg2154").try_cast("double")).withColumn("y", F.col("accyespg2154").try_cast("double"))


def unpack_timetable(archive: bytes, put) -> list[str]:
    """Hands the members of a timetable archive that are read to put(name, stream), once, before Spark reads them in splits."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        names = [n for n in z.namelist() if n.removesuffix(".txt") in GTFS]
        for n in names:
            with z.open(n) as member:
                put(n, member)
    return names


def timetable(spark: SparkSession, folder: str, member: str) -> DataFrame:
    """One member of an unpacked timetable, its columns as text, whatever their order in the file."""
    raw = spark.read.option("header", True).csv(f"{folder}/{member}.txt", inferSchema=False)
    return raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in GTFS[member]))


def streets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, lon, lat) and ways (id, nodes, tags) of tiles of elements; what two tiles hold counts once."""
    df = spark.read.schema("elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>").option("multiLine", True).json(path)
    e = df.select(F.explode("elements").alias("e")).select("e.*")
    # of elements that differ the least counts, whatever the order of the tiles
    nodes = e.filter("type = 'node'").groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("n")).select("id", "n.lon", "n.lat")
    order = F.struct("nodes", F.array_sort(F.map_entries("tags")).alias("tags"))
    ways = e.filter("type = 'way'").groupBy("id").agg(F.min_by(F.struct("nodes", "tags"), order).alias("w")).select("id", "w.nodes", "w.tags")
    return nodes, ways


def noise_level(columns: list[str]) -> Column:
    """The level of a noise polygon, by the first of the known columns that the file has."""
    if "legende" in columns:
        return F.col("legende").try_cast("int")
    if "db_lo" in columns:
        return F.col("db_lo").try_cast("int")
    return F.regexp_extract("code", r"LD(\d\d)", 1).try_cast("int")


def air_noise(spark: SparkSession, path: str, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Air-noise shapes (Parquet with box columns) that meet a box: the box test reaches the scan."""
    return spark.read.parquet(path).filter((F.col("left") <= right) & (F.col("right") >= left) & (F.col("bottom") <= top) & (F.col("top") >= bottom))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, px, py, r, g, b, a of image files that Spark decodes (RGB or RGBA)."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                band = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                for y in range(r.height):  # a row of pixels at a time
                    line = band[y].astype(np.int32)
                    blue, green, red = (line[:, k] if r.nChannels >= 3 else line[:, 0] for k in range(3))
                    yield pd.DataFrame({"path": r.path, "px": np.arange(r.width, dtype=np.int32), "py": np.int32(y), "r": red, "g": green, "b": blue, "a": line[:, 3] if r.nChannels == 4 else np.int32(255)})

    return images.mapInPandas(run, "path string, px int, py int, r int, g int, b int, a int")


def legacy_layer(spark: SparkSession, path: str, dtype: str, width: int) -> DataFrame:
    """path, row, col, value of raw (or gzipped) little-endian arrays, north first."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for rows in batches:
            for r in rows.itertuples(index=False):
                values = np.frombuffer(gzip.decompress(r.content) if r.path.endswith(".gz") else r.content, np.dtype(dtype).newbyteorder("<")).reshape(-1, width)
                for y in range(0, len(values), 256):
                    part = values[y : y + 256]
                    yield pd.DataFrame({"path": r.path, "row": np.repeat(np.arange(y, y + len(part)), width), "col": np.tile(np.arange(width), len(part)), "value": part.ravel().astype(np.int64)})

    return files.mapInPandas(run, "path string, row long, col long, value long")


def layers(spark: SparkSession, path: str, codes: list[str], names: list[str]) -> DataFrame:
    """Long-format layers: only the named ones of the places asked for are read."""
    return spark.read.parquet(path).filter(F.col("code").isin(codes) & F.col("layer").isin(names))
