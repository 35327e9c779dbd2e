"""From a timetable's files to door-to-door tables: rail connections, then durations by scenario, destination and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livgrid.functions import numbers, text
from livgrid.operators import profile, timetable

#: Rail modes, periods studied (seconds of the day), hours read after the last, and the scenarios' last openings.
RAIL = ("0", "1", "2")
PERIODS = {"pointe": (27000, 34200), "journee": (39600, 54000)}
HORIZON_S = 3 * 3600
WINDOW = (27000, 54000 + HORIZON_S)
SCENARIOS = {"actuel": None, "2027": "2027-12-31", "2031": "2031-12-31"}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def services_on(calendar: DataFrame, calendar_dates: DataFrame, day: str) -> DataFrame:
    """The services that run on a day (YYYYMMDD)."""
    weekday = F.weekday(F.to_date(F.lit(day), "yyyyMMdd"))
    flag = F.element_at(F.array(*map(F.col, WEEKDAYS)), weekday + 1)
    regular = calendar.filter((F.col("start_date") <= day) & (F.col("end_date") >= day) & (flag == "1")).select(F.col("service_id").alias("service"))
    exceptions = calendar_dates.filter(F.col("date") == day).select(F.col("service_id").alias("service"), F.col("exception_type").try_cast("int").alias("type"))
    return timetable.active_services(regular, exceptions)


def rail_timetable(files: dict[str, DataFrame], day: str, window: tuple[int, int] = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """connections (trip, seq, from_stop, to_stop, dep, arr, line, proj), transfers (from_stop, to_stop, secs) and stops (stop, name, parent) of the rail
    lines of a day. files: the members by name, as text."""
    routes = files["routes"].filter(F.col("route_type").isin(*RAIL)).select("route_id", F.coalesce("route_short_name", F.lit("")).alias("line"))
    services = services_on(files["calendar"], files["calendar_dates"], day)
    trips = files["trips"].join(services, files["trips"]["service_id"] == services["service"], "left_semi").join(routes, "route_id").select("trip_id", "line")
    # trips of a day's rail services are few next to all stop times: the semi join cuts them before the window
    times = files["stop_times"].join(trips.select("trip_id"), "trip_id", "left_semi")
    times = times.select(F.col("trip_id").alias("trip"), F.col("stop_id").alias("stop"), F.col("stop_sequence").try_cast("int").alias("seq"), numbers.seconds_of_day(F.col("departure_time")).alias("dep"), numbers.seconds_of_day(F.col("arrival_time")).alias("arr"))
    conns = timetable.within_window(timetable.connections(times, order=("seq",)), *window)
    conns = conns.join(trips.withColumnRenamed("trip_id", "trip"), "trip").withColumn("proj", F.lit(False))
    used = conns.select(F.col("from_stop").alias("stop")).union(conns.select(F.col("to_stop").alias("stop"))).distinct()
    walks = files["transfers"].filter(F.col("from_stop_id") != F.col("to_stop_id")).select(F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"), F.coalesce(F.col("min_transfer_time").try_cast("int"), F.lit(0)).cast("bigint").alias("secs"))
    for side in ("from_stop", "to_stop"):
        walks = walks.join(used.withColumnRenamed("stop", side), side, "left_semi")
    stops = files["stops"].select(F.col("stop_id").alias("stop"), F.col("stop_name").alias("name"), text.parent_zone(F.col("parent_station")).alias("parent")).join(used, "stop", "left_semi")
    return conns, walks.select("from_stop", "to_stop", "secs"), stops


def zone_durations(profiles: DataFrame, stops: DataFrame, start: int, end: int, by: list[str]) -> DataFrame:
    """by, zdc and the statistics of departures at every minute of a period: of a zone's quays (stops with a parent and a profile) the best by
    arrival, then line, then without projects."""
    quays = profiles.join(stops.filter("parent <> ''").select("stop", F.col("parent").alias("zdc")), "stop")
    samples = timetable.sampled(quays.select(*by, "stop", "zdc").distinct(), start, end).withColumn("t", F.col("t").cast("bigint"))
    found = timetable.next_departure(samples, quays, [*by, "stop"], "t", "dep", ["arr", "line", "proj"])
    best = found.groupBy(*by, "zdc", "t").agg(F.min(F.when(F.col("arr").isNotNull(), F.struct("arr", "line", "proj"))).alias("b"))
    return timetable.durations(best.select(*by, "zdc", "t", "b.arr", "b.line", "b.proj"), [*by, "zdc"])


def scenario_timetables(conns: DataFrame, projected: dict[str, DataFrame]) -> DataFrame:
    """Connections by scenario: today's for each of SCENARIOS, with those of the projected lines (connections by scenario) that are open by its last opening."""
    out = None
    for scenario, until in SCENARIOS.items():
        extra = projected.get(scenario) if until else None
        here = (timetable.merged(conns, extra) if extra is not None else conns).withColumn("scenario", F.lit(scenario))
        out = here if out is None else out.unionByName(here, allowMissingColumns=True)
    return out


def duration_table(conns: DataFrame, walks: DataFrame, stops: DataFrame, destinations: DataFrame) -> DataFrame:
    """scenario, dest, period, zdc, median, p10, p90, line, proj. conns carry their scenario; destinations: dest, zdc. A destination's own zones are at 0."""
    targets = destinations.join(stops.withColumnRenamed("parent", "zdc"), "zdc").select("dest", "stop").distinct()
    scenarios = conns.select("scenario").distinct()
    found = profile.profiles(conns, walks, targets, ["scenario"])
    out = None
    for period, (start, end) in PERIODS.items():
        here = zone_durations(found, stops, start, end, ["scenario", "dest"]).withColumn("period", F.lit(period))
        out = here if out is None else out.unionByName(here)
    own = scenarios.crossJoin(destinations.select("dest", "zdc")).crossJoin(F.broadcast(out.select("period").distinct()))
    own = own.select("scenario", "dest", "zdc", *(F.lit(0.0).alias(c) for c in ("median", "p10", "p90")), F.lit("").alias("line"), F.lit(None).cast("double").alias("proj"), "period")
    return out.join(destinations.select("dest", "zdc"), ["dest", "zdc"], "left_anti").unionByName(own)
