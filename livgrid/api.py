"""What a caller asks the engine: searches, look-ups, zone statistics, freshness. One object over a folder of tables.

Tables (Parquet): communes (code, nom, population, polygon, left, bottom, right, top), cells (code, row, col, area and base layers, partitioned
by code), layers (code, row, col, layer, value; partitioned by code, layer_group, layer), source_files (source, code, mtime),
meta (code, format, formats).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid import jobs
from livgrid.functions import numbers
from livgrid.functions.text import BASE_NETWORKS
from livgrid.operators import catalog, spatial, zones
from livgrid.sources import readers, sinks

MODES = ("walk", "bike")
NAMES = {"index": "bp_noise", "road": "lden_route", "rail": "lden_fer"}


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._cached: dict[str, tuple[str | None, DataFrame]] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def search(self, q: str) -> DataFrame:
        return catalog.search(self.table("communes"), q).select("code", "nom")

    def at(self, x: float, y: float) -> DataFrame:
        return catalog.at_point(self.table("communes"), "polygon", x, y).select("code", "nom")

    def bbox(self, left: float, bottom: float, right: float, top: float) -> tuple[DataFrame, DataFrame, int]:
        """Places shown, how many there are, and the most that are shown."""
        shown, total = catalog.in_view(self.table("communes"), "polygon", left, bottom, right, top)
        return shown.select("code", "nom", "share"), total, catalog.MOST_SHOWN

    def _frame(self, request: dict) -> tuple[DataFrame, dict[str, Column], zones.ZoneQuery, str]:
        """The cells of the places asked for with the optional layers asked for, and the query."""
        mode = request.get("mode", "walk")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        codes = [c for c in request.get("codes", []) if str(c).isalnum()]
        base = self.table("cells").filter(F.col("code").isin(codes))
        networks = zones.known_networks(request.get("networks", []), BASE_NETWORKS)
        key = request.get("dest_key")
        dest = f"{mode}_dest_{key}" if key else None
        wanted = [n for n in [*(f"{mode}_{n}" for n in networks), *([dest] if dest else [])] if n not in base.columns]
        frame = base
        if wanted:
            optional = readers.layers(self.spark, f"{self.folder}/layers", codes, wanted)
            frame = base.join(optional.groupBy("code", "row", "col").pivot("layer", wanted).agg(F.first("value")), ["code", "row", "col"], "left")
            if dest in wanted:  # a place without the layer isn't held to it
                has = optional.filter(F.col("layer") == dest).select("code").distinct().withColumn("__has", F.lit(True))
                frame = frame.join(F.broadcast(has), "code", "left").withColumn(dest, F.when(F.col("__has"), F.coalesce(dest, F.lit(numbers.UNREACHABLE_MIN))).otherwise(0)).drop("__has")
        query = zones.ZoneQuery(
            walk=request.get("walk"), air=dict(request.get("air") or {}), index=request.get("bp", 3), road=request.get("route", 999), rail=request.get("fer", 999), dest_key=key, dest_max=request.get("dest_max", 60),
            price_layer=f"prix_{request['prix_type']}" if request.get("prix_type") else None, price_max=request.get("prix_max"),
        )
        return frame, {n: F.col(f"{mode}_{n}") for n in networks if f"{mode}_{n}" in frame.columns}, query, mode

    def _criteria(self, request: dict) -> tuple[DataFrame, dict[str, Column]]:
        frame, networks, query, mode = self._frame(request)
        names = NAMES | ({f"dest_{query.dest_key}": f"{mode}_dest_{query.dest_key}"} if query.dest_key else {})
        return frame, query.criteria(zones.best_time(networks), frame.columns, names)

    def stats(self, request: dict) -> DataFrame:
        """By place: areas in all, that meet all criteria, and that meet each alone. Places that aren't there are skipped."""
        frame, criteria = self._criteria(request)
        return zones.zone_areas(frame, "code", "area", criteria)

    def summary(self, request: dict) -> DataFrame:
        return zones.rollup_areas(self.stats(request), ["walk", "air", "index", "road", "rail", "dest", "price"])

    def hover(self, request: dict, code: str, row: int, col: int, at: tuple[float, float] | None = None, stations: DataFrame | None = None, neighbourhoods: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
        """One cell: its layers, the criteria that it fails with value and threshold (details), for each mode the best station over the networks asked for
        (best_walk, best_bike: seconds, and the station by its rank in stations: code, rank, zdc, nom), the neighbourhood at a point (neighbourhoods: code, nom,
        polygon), and the price statistics of it, else of the whole place (prices: code, nom or null, type, n, med)."""
        request = request | {"codes": [code]}
        frame, networks, query, mode = self._frame(request)
        names = NAMES | ({f"dest_{query.dest_key}": f"{mode}_dest_{query.dest_key}"} if query.dest_key else {})
        time = zones.best_time(networks)
        here = frame.filter((F.col("row") == row) & (F.col("col") == col))
        failed = zones.details(query, time, frame.columns, names)
        here = here.withColumn("reasons", zones.exclusion_reasons(query.criteria(time, frame.columns, names))).withColumn("details", zones.exclusion_details(failed)).withColumn("noise", numbers.noise_label(F.col("lden_route")))
        if stations is not None:
            for m in MODES:
                both = {n: (F.col(f"{m}_{n}"), F.col(f"station_{m}_{n}")) for n in networks if {f"{m}_{n}", f"station_{m}_{n}"} <= set(frame.columns)}
                here = here.withColumn(f"best_{m}", zones.best_station(both)).withColumn("__rank", F.col(f"best_{m}.station") if both else F.lit(None).cast("int"))
                here = zones.with_station(here, stations, "__rank", f"station_{m}").drop("__rank")
        if neighbourhoods is not None and at is not None:
            here = here.join(catalog.at_point(neighbourhoods.filter(F.col("code") == code), "polygon", *at).agg(F.min("nom").alias("neighbourhood")))
            if prices is not None:
                own = prices.filter((F.col("code") == code) & (F.col("type") == request.get("prix_type", "appartement")))
                whole = own.filter("nom IS NULL").agg(F.first("med").alias("__whole"))
                named = own.filter("nom IS NOT NULL").select(F.col("nom").alias("neighbourhood"), F.col("med").alias("__own"), F.col("n").alias("sales"))
                here = here.join(named, "neighbourhood", "left").join(whole).withColumn("price", F.coalesce("__own", "__whole")).withColumn("price_fallback", F.col("__own").isNull() & F.col("__whole").isNotNull()).drop("__own", "__whole")
        return here

    def cell_of(self, x: float, y: float, left: float, top: float, cell: float = 15.0) -> tuple[int, int]:
        at = self.spark.range(1).select(spatial.cell_at(F.lit(x), F.lit(y), left, top, cell).alias("c")).first()["c"]
        return at["row"], at["col"]

    def freshness(self, now: Column | None = None, days: int = catalog.MOST_AGE_DAYS) -> DataFrame:
        return catalog.freshness(self.table("source_files"), F.current_timestamp() if now is None else now, days)

    def to_refresh(self, now: Column | None = None, pending: DataFrame | None = None, days: int = catalog.MOST_AGE_DAYS) -> DataFrame:
        return catalog.stale_groups(self.table("source_files"), self.table("communes"), F.current_timestamp() if now is None else now, pending, days)

    def refresh(self, build, now: Column | None = None, days: int = catalog.MOST_AGE_DAYS) -> dict[str, str]:
        """Rebuilds what is stale or was left by an earlier run, a place at a time; errors by code."""
        job = jobs.Rebuild(self.spark, self.folder, build)
        job.plan(self.table("source_files"), self.table("communes"), F.current_timestamp() if now is None else now, days)
        return job.run()

    def status(self, now: Column | None = None, days: int = catalog.MOST_AGE_DAYS) -> dict[str, DataFrame]:
        """Freshness by source, and what is to refresh, why."""
        return {"sources": self.freshness(now, days), "places": self.to_refresh(now, None, days)}

    def delete(self, code: str) -> None:
        """Removes a place from the tables by place; an index of what is left is `sinks.index_of`."""
        for name in ("cells", "layers"):
            sinks.remove_place(self.spark, f"{self.folder}/{name}", code)
        self._cached.clear()

    def place_cells(self, code: str) -> DataFrame:
        """A place's cells, kept while its build (meta.built) stays the same; a new build drops what was kept."""
        built = self.table("meta").filter(F.col("code") == code).select(F.col("built").cast("string")).first()
        version = built[0] if built else None
        kept = self._cached.get(code)
        if kept is None or kept[0] != version:
            if kept is not None:
                kept[1].unpersist()
            self._cached[code] = kept = (version, self.table("cells").filter(F.col("code") == code).persist())
        return kept[1]

    def to_rebuild(self) -> DataFrame:
        return catalog.outdated_groups(self.table("meta"))

    def check_codes(self, codes: list[str]) -> None:
        """A build refuses codes that aren't there."""
        asked = self.spark.createDataFrame([(c,) for c in codes], "code string")
        if unknown := [r["code"] for r in catalog.known_and_unknown(asked, self.table("communes"))[1].collect()]:
            raise ValueError(f"unknown codes: {', '.join(sorted(unknown))}")
