"""Multi-criteria zone query: which cells meet all thresholds, and how much area meets each one alone.

Unknown values follow one table. Travel time 65535 (unreachable) fails any limit and passes without one;
pollutant 0, noise 0 and price 0 are unknown and pass; a destination time of 255 fails; a criterion whose
layer isn't there is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from livgrid.functions.text import BASE_NETWORKS

#: Fixed values of the data model.
UNREACHABLE_S = 65535
UNREACHABLE_MIN = 255
OPTIONAL_NETWORK = r"gpe\d{8}|tram[0-9a-z]+(_\d{8})?"
LAYER_KEY = r"[a-z0-9_]+"


def known_networks(names: Sequence[str], base: Sequence[str] = BASE_NETWORKS) -> list[str]:
    """The names that are base networks or well-formed optional ones, in order."""
    return [n for n in names if n in base or re.fullmatch(OPTIONAL_NETWORK, n)]


@dataclass
class ZoneQuery:
    """Thresholds of one query. None: no limit. Neutral noise thresholds: index 3, levels 999."""

    walk: int | None = None
    air: dict[str, float] = field(default_factory=dict)
    index: int = 3
    road: int = 999
    rail: int = 999
    dest_key: str | None = None
    dest_max: int = 60
    price_layer: str | None = None
    price_max: int | None = None

    def criteria(self, time: Column | None, columns: Sequence[str], names: dict[str, str] | None = None) -> dict[str, Column]:
        """A predicate for each criterion whose layer is there. names: criterion to column, where they differ."""
        named = lambda k: (names or {}).get(k, k)
        out: dict[str, Column] = {}
        if time is None:
            time = F.lit(UNREACHABLE_S)
        out["walk"] = time <= (UNREACHABLE_S if self.walk is None else self.walk * 60 + 29)
        if air := [F.col(named(p)) <= v * 10 + 0.5 for p, v in self.air.items() if named(p) in columns]:
            out["air"] = _all(air)
        if named("index") in columns:
            out["index"] = F.col(named("index")) <= self.index
        for k, limit in (("road", self.road), ("rail", self.rail)):
            if named(k) in columns:
                out[k] = F.col(named(k)) < limit
        if self.dest_key and re.fullmatch(LAYER_KEY, self.dest_key) and named(f"dest_{self.dest_key}") in columns:
            out["dest"] = F.col(named(f"dest_{self.dest_key}")) <= self.dest_max
        if self.price_max is not None and self.price_layer and named(self.price_layer) in columns:
            out["price"] = F.col(named(self.price_layer)) <= self.price_max
        return out


def details(query: ZoneQuery, time: Column | None, columns: Sequence[str], names: dict[str, str] | None = None) -> dict[str, tuple[Column, Column, Column]]:
    """The criteria of a query with the value that a cell has and the threshold, in units; pollutants each for itself."""
    tests = query.criteria(time, columns, names)
    named = lambda k: (names or {}).get(k, k)
    limits = {"walk": query.walk, "index": query.index, "road": query.road, "rail": query.rail, "dest": query.dest_max, "price": query.price_max}
    values = {"walk": (F.lit(UNREACHABLE_S) if time is None else time) / 60, "index": named("index"), "road": named("road"), "rail": named("rail"), "dest": named(f"dest_{query.dest_key}"), "price": named(query.price_layer) if query.price_layer else None}
    out: dict[str, tuple[Column, Column, Column]] = {}
    for k, test in tests.items():
        if k == "air":
            out |= {p: (F.col(named(p)) <= v * 10 + 0.5, F.col(named(p)) / 10, F.lit(v)) for p, v in query.air.items() if named(p) in columns}
        else:
            value = F.col(values[k]) if isinstance(values[k], str) else values[k]
            out[k] = (test, value, F.lit(limits[k]))
    return out


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def best_time(networks: dict[str, Column]) -> Column:
    """The least time over the selected networks' layers; unreachable if none is selected."""
    times = [F.coalesce(c, F.lit(UNREACHABLE_S)) for c in networks.values()]
    return F.least(F.lit(UNREACHABLE_S), *times) if times else F.lit(UNREACHABLE_S)


def best_station(networks: dict[str, tuple[Column, Column]]) -> Column:
    """A struct of the least time and its station; the first network wins ties; null if nothing is reachable."""
    best = None
    for i, (time, station) in enumerate(networks.values()):
        here = F.struct(F.coalesce(time, F.lit(UNREACHABLE_S)).alias("time"), F.lit(i).alias("ord"), station.alias("station"))
        best = here if best is None else F.least(best, here)
    if best is None:
        return F.lit(None)
    return F.when(best["time"] < UNREACHABLE_S, F.struct(best["time"].alias("time"), best["station"].alias("station")))


def zone_areas(cells: DataFrame, key: str, area: str, criteria: dict[str, Column]) -> DataFrame:
    """By key: the total area, the area that meets all criteria (ok), and that meets each alone (c_<name>)."""
    sums = [F.sum(area).alias("total"), F.sum(F.when(_all(list(criteria.values())), F.col(area)).otherwise(0)).alias("ok")]
    sums += [F.sum(F.when(c, F.col(area)).otherwise(0)).alias(f"c_{k}") for k, c in criteria.items()]
    return cells.groupBy(key).agg(*sums)


def rollup_areas(areas: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """One row over all zones, with whole percentages rounded half up; a criterion that a zone lacks counts in full."""
    there = [c for c in criteria if f"c_{c}" in areas.columns]
    total = areas.agg(F.sum("total").alias("total"), F.sum("ok").alias("ok"), *(F.sum(F.coalesce(f"c_{c}", "total") if c in there else F.col("total")).alias(f"c_{c}") for c in criteria))
    percent = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) * 200 + F.col("total"), F.col("total") * 2)), F.lit(0)).cast("bigint")
    return total.select("*", percent("ok").alias("pct_ok"), *(percent(f"c_{c}").alias(f"pct_{c}") for c in criteria))


def exclusion_reasons(criteria: dict[str, Column]) -> Column:
    """The names of the criteria that a cell fails, in order; a null test counts as failed."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in criteria.items())))


def exclusion_details(criteria: dict[str, tuple[Column, Column, Column]]) -> Column:
    """The criteria (test, value, threshold) that a cell fails, in order, as structs (criterion, value, threshold)."""
    one = lambda k, test, value, threshold: F.when(~F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("criterion"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold")))
    return F.array_compact(F.array(*(one(k, *c) for k, c in criteria.items())))


def with_station(cells: DataFrame, stations: DataFrame, rank: str, out: str, columns: Sequence[str] = ("zdc", "nom")) -> DataFrame:
    """cells (code, a station's rank in its municipality) with a struct of that station's columns; null where no station has the rank. stations: code, rank."""
    named = stations.select("code", F.col("rank").alias(rank), F.struct(*columns).alias(out))
    return cells.join(named, ["code", rank], "left")
