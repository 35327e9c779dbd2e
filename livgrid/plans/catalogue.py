"""Every query of the engine over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from livgrid.plans import graphs, lookups, places, projects, rasters, sales, scalars, timetables, zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (zones, scalars, sales, timetables, places, rasters, graphs, lookups, projects):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
