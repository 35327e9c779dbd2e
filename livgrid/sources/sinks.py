"""Writers of the engine's results: layers by place and group, exports as JSON, and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.functions.text import layer_group
from livgrid.operators.stations import first_of


def write_cells(cells: DataFrame, path: str) -> None:
    """The wide base table, a folder a place; places that come again are replaced whole, others stay."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code").parquet(path)


def write_layers(layers: DataFrame, path: str) -> None:
    """Narrow optional layers (code, row, col, layer, value), a folder a place, group and layer: a partial rebuild replaces its groups alone."""
    layers.withColumn("layer_group", layer_group(F.col("layer"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code", "layer_group", "layer").parquet(path)


def packed(layers: DataFrame, base: tuple[str, ...] = ("rer", "transilien", "metro")) -> DataFrame:
    """The layers that every query may read: neither destinations nor networks beyond the base ones."""
    network = F.regexp_extract("layer", r"^(?:station_)?(?:walk|bike)_(.+)$", 1)
    return layers.filter((network == "") | network.isin(*base))


def point_features(rows: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """text: one GeoJSON feature a row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("text"))


def station_features(stations: DataFrame) -> DataFrame:
    """Stations with their lines joined by " + " and networks by ","."""
    return point_features(stations.withColumn("lignes", F.array_join("lines", " + ")).withColumn("reseaux", F.array_join("networks", ",")), "x", "y", ["zdc", "nom", "lignes", "reseaux"])


def meta_row(cells: DataFrame, formats: dict[str, int], built: Column) -> DataFrame:
    """code and a struct of what describes a build: size, formats, coverage, air range, time."""
    versions = F.create_map(*[F.lit(x) for pair in sorted(formats.items()) for x in pair])
    known = F.when(F.col("no2") > 0, F.col("no2"))
    out = cells.groupBy("code").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), F.count("*").alias("cells"), (F.min(known) / 10).alias("air_min"), (F.max(known) / 10).alias("air_max"), F.rint(F.avg((F.col("lden_route") > 0).cast("int")) * 1000).alias("coverage"))
    return out.select("code", F.struct("width", "height", "cells", "air_min", "air_max", "coverage", versions.alias("formats"), built.alias("built")).alias("meta"))


def index_of(stations: DataFrame, accesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations and accesses over all places without doubles: of a zone, or of a zone's access, the first place by code."""
    return first_of(stations, ["zdc"], ["code"]).orderBy("nom"), first_of(accesses, ["zdc", "nom_acces"], ["code"])


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settled(spark: SparkSession, path: str) -> bool:
    """Ends a swap that broke off: a finished new table goes in, else the old one comes back. Whether there is a table then."""
    (fs, at), (_, new), (_, old) = _fs(spark, path), _fs(spark, path + ".new"), _fs(spark, path + ".old")
    if not fs.exists(at):
        done = _fs(spark, path + ".new/_SUCCESS")[1]
        back = new if fs.exists(done) else old if fs.exists(old) else None
        if back is not None and not fs.rename(back, at):
            raise OSError(f"{back} could not take the place of {path}")
    for rest in (new, old):
        if fs.exists(at) and fs.exists(rest):
            fs.delete(rest, True)
    return fs.exists(at)


def swap(df: DataFrame, path: str) -> None:
    """Writes beside a table, sets the old one aside, and renames: a failed write leaves the old one, and a break between the renames is mended by the next
    `settled`, as one of both is always there."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    (fs, at), (_, new), (_, old) = _fs(spark, path), _fs(spark, path + ".new"), _fs(spark, path + ".old")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, at):
        raise OSError(f"{path}.new could not take the place of {path}")
    fs.delete(old, True)


def remove_and_index(spark: SparkSession, tables: dict[str, str], code: str, stations: str, accesses: str) -> tuple[DataFrame, DataFrame]:
    """Deletes a place's partitions of the tables (name to path) and gives the index of what is left (paths of stations and accesses)."""
    for path in tables.values():
        remove_place(spark, path, code)
    return index_of(spark.read.parquet(stations).filter(F.col("code") != code), spark.read.parquet(accesses).filter(F.col("code") != code))


def remove_place(spark: SparkSession, path: str, code: str) -> bool:
    """Deletes a place's partition."""
    fs, at = _fs(spark, f"{path}/code={code}")
    return fs.delete(at, True)
