"""Look-ups over places, freshness of sources, and which layers to rebuild."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.functions import text
from livgrid.operators import spatial

#: Versions of the layer groups, which group a source feeds (* all, None none), and how old a file may be.
FORMATS = {"grille": 9, "transport": 13, "destinations": 2, "air": 9, "bruit": 9}
SOURCE_GROUPS = {"idfm": "transport", "gpe": "transport", "transit": "destinations", "communes": "*", "airbruit": "bruit", "drieat": "bruit", "osm": "transport", "airparif": "air", "bruit_route": "bruit", "bruit_fer": "bruit", "quartiers": None, "iris": None, "dvf": None}
MOST_SHOWN, LEAST_SHARE, MOST_AGE_DAYS = 12, 0.3, 183


def search(places: DataFrame, query: str, name: str = "nom", code: str = "code", population: str = "population", most: int = 10) -> DataFrame:
    """Places found by name or code: names that start with the query first, then the larger population (unknown last)."""
    starts = F.startswith(text.fold(F.col(name)), text.fold(F.lit(query)))
    return places.filter(text.matches_search(F.col(name), F.col(code), query)).orderBy(F.when(starts, 0).otherwise(1), F.col(population).desc_nulls_last(), code).limit(most)


def in_view(places: DataFrame, polygon: str, left: float, bottom: float, right: float, top: float) -> tuple[DataFrame, DataFrame]:
    """Places of which the view shows enough, largest share first up to the number shown; and how many there are in all."""
    seen = places.withColumn("share", spatial.share_in_view(F.col(polygon), left, bottom, right, top)).filter(F.col("share") >= LEAST_SHARE)
    return seen.orderBy(F.desc("share"), "code").limit(MOST_SHOWN), seen.agg(F.count("*").alias("total"))


def at_point(places: DataFrame, polygon: str, x: float, y: float) -> DataFrame:
    return places.filter(spatial.inside(F.col(polygon), F.lit(float(x)), F.lit(float(y))))


def known_and_unknown(codes: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes asked for that are there (a query skips the others) and those that aren't (a build refuses them)."""
    return codes.join(places.select("code"), "code", "left_semi"), codes.join(places.select("code"), "code", "left_anti")


def freshness(files: DataFrame, now: Column, days: int = MOST_AGE_DAYS, by: str = "source") -> DataFrame:
    """By source: files, those older than the cut-off, and the oldest."""
    old = F.col("mtime") < now - F.make_interval(days=F.lit(days))
    return files.groupBy(by).agg(F.count("*").alias("files"), F.count_if(old).alias("stale"), F.min("mtime").alias("oldest"))


def source_groups(spark: SparkSession) -> DataFrame:
    """source, layer_group: a row for each group that a source feeds."""
    rows = [(s, g) for s, to in SOURCE_GROUPS.items() for g in (sorted(FORMATS) if to == "*" else [to] if to else [])]
    return spark.createDataFrame(rows, "source string, layer_group string")


def stale_groups(files: DataFrame, codes: DataFrame, now: Column, pending: DataFrame | None = None, days: int = MOST_AGE_DAYS) -> DataFrame:
    """code, groups, reasons: what to rebuild because a source is stale, with what an earlier run left (null: all). A shared source, without a code, marks
    every place, unless it feeds no group. A place whose own source feeds none is listed without groups. reasons: the sources of its own, "shared", and
    "pending"."""
    old = files.filter(F.col("mtime") < now - F.make_interval(days=F.lit(days))).select("source", "code").distinct()
    feeds = F.broadcast(source_groups(files.sparkSession))
    shared = codes.select("code").crossJoin(F.broadcast(old.filter("code IS NULL").join(feeds, "source").select("layer_group").distinct())).withColumn("reason", F.lit("shared"))
    own = old.filter("code IS NOT NULL").join(feeds, "source", "left").select("code", "layer_group", F.col("source").alias("reason"))
    out = shared.union(own)
    if pending is not None:
        every = F.array(*(F.lit(g) for g in sorted(FORMATS)))
        out = out.union(pending.select("code", F.explode_outer(F.coalesce("groups", every)).alias("layer_group"), F.lit("pending")))
    return out.groupBy("code").agg(F.array_sort(F.collect_set("layer_group")).alias("groups"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def dependencies(places: DataFrame, tiles_of: DataFrame, files: DataFrame) -> DataFrame:
    """code, source, path of the files that feed each place: its own ones (files with a code), the road tiles that its box touches (tiles_of: code, i, j; files
    named by tile), and the shared ones. places: code; files: source, code, tile (a struct i, j), path; code and tile null where they don't apply."""
    own = files.filter("code IS NOT NULL").join(places.select("code"), "code", "left_semi").select("code", "source", "path")
    tiled = files.filter("code IS NULL AND tile IS NOT NULL").select("source", "path", F.col("tile.i").alias("i"), F.col("tile.j").alias("j")).join(tiles_of, ["i", "j"]).select("code", "source", "path")
    shared = places.select("code").crossJoin(F.broadcast(files.filter("code IS NULL AND tile IS NULL").select("source", "path")))
    return own.union(tiled).union(shared)


def outdated_groups(meta: DataFrame) -> DataFrame:
    """code, groups: groups whose stored version is behind. Metadata without versions by group count as their one version everywhere."""
    current = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    stored = lambda g: F.coalesce(F.try_element_at(F.col("formats"), g), F.when(F.col("formats").isNull(), F.col("format")), F.lit(0))
    behind = F.filter(F.array_sort(F.map_keys(current)), lambda g: stored(g) < F.element_at(current, g))
    return meta.select("code", behind.alias("groups")).filter(F.size("groups") > 0)


def groups_to_build(asked: Iterable[str]) -> list[str]:
    """What a rebuild of some groups takes along: new stations move destinations, a new grid moves everything."""
    out = set(asked)
    if "grille" in out:
        return sorted(FORMATS)
    if "transport" in out:
        out.add("destinations")
    return sorted(out)


def reused_layers(layers: DataFrame, rebuilt: Iterable[str]) -> DataFrame:
    """The layers (column layer) that a partial rebuild keeps."""
    return layers.filter(~text.layer_group(F.col("layer")).isin(*rebuilt)) if rebuilt else layers


def departments_touching(places: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """The departments of places whose box meets a box."""
    return places.filter((F.col("left") <= right) & (F.col("right") >= left) & (F.col("bottom") <= top) & (F.col("top") >= bottom)).select("department").distinct()


def tile_span(low: Column, high: Column, size: float) -> Column:
    """The numbers of the tiles of a size that an interval touches, as an array."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def tiles_of(boxes: DataFrame, key: str, height: float, width: float) -> DataFrame:
    """key, i, j of the tiles that each box (left, bottom, right, top) touches, both ends included."""
    rows = boxes.select(key, "left", "right", F.explode(tile_span(F.col("bottom"), F.col("top"), height)).alias("i"))
    return rows.select(key, "i", F.explode(tile_span(F.col("left"), F.col("right"), width)).alias("j"))


def tiles(left: float, bottom: float, right: float, top: float, height: float, width: float, spark: SparkSession) -> DataFrame:
    """i, j of the tiles that a box touches."""
    box = spark.range(1).select("id", *(F.lit(float(v)).alias(k) for k, v in (("left", left), ("bottom", bottom), ("right", right), ("top", top))))
    return tiles_of(box, "id", height, width).select("i", "j")


def value_range(cells: DataFrame, value: str, unknown: int = 0) -> DataFrame:
    """Least and greatest known tenths as units, and a slider's bounds: widened to halves, at least half apart."""
    known = F.when(F.col(value) != unknown, F.col(value))
    out = cells.agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    low, high = F.floor(F.col("lo") / 5) * 5, F.ceil(F.col("hi") / 5) * 5
    return out.select("lo", "hi", low.cast("bigint").alias("slider_lo"), F.when(low == high, high + 5).otherwise(high).cast("bigint").alias("slider_hi"))


def coverage(cells: DataFrame, by: list[str], layer: str) -> DataFrame:
    """The share of cells with a known value, in whole thousandths (half even), and whether it is under nine tenths."""
    out = cells.groupBy(*by).agg(F.count_if(F.col(layer) > 0).alias("known"), F.count("*").alias("n"))
    return out.select(*by, F.rint(F.col("known") * 1000 / F.col("n")).cast("bigint").alias("coverage"), (F.col("known") * 10 < F.col("n") * 9).alias("thin"))


def previous_of_year(dates: DataFrame, date: str) -> DataFrame:
    """Dates in order with whether a tick is shown: the first of its year."""
    from pyspark.sql import Window

    year = F.substring(date, 1, 4)
    return dates.withColumn("tick", ~F.coalesce(F.lag(year).over(Window.partitionBy(F.substring(date, 1, 3)).orderBy(date)) == year, F.lit(False)))
