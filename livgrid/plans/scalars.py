"""Queries of the scalar functions over names, types, prices and times of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.functions import geo, numbers, text
from livgrid.operators import catalog, prices
from livgrid.sources.tables import table


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Search ranking over customers: names that start with the query first, then the larger balance, ten at most."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("code"), "c_name", "c_acctbal")
    return catalog.search(c, "10", "c_name", "code", "c_acctbal").select("c_custkey", "c_name")


def client_fold_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("Sainte-"), F.col("p_name"), F.lit(" l'Été saint")).alias("place"))
    key = text.fold_local(F.col("place"))
    return p.filter(F.contains(key, F.lit("ste"))).orderBy(F.when(key.startswith("ste"), 0).otherwise(1), key, "p_partkey").limit(10).select("p_partkey", key.alias("key"))


def code_prefix_recode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand")
    return p.groupBy(prices.recoded(F.col("p_brand"), "Brand#1", "Brand#10").alias("code")).agg(F.count("*").alias("n"))


def clock_to_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Clock texts whose hours pass 23, from the days since the month began."""
    e = table(spark, d, "events").select("event_id", "ts")
    since = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    clock = F.concat_ws(":", F.floor(since / 3600).cast("string"), F.lpad(F.floor(since % 3600 / 60).cast("string"), 2, "0"), F.lpad((since % 60).cast("string"), 2, "0"))
    return e.select("event_id", clock.alias("clock"), numbers.seconds_of_day(clock).cast("bigint").alias("seconds"))


def next_service_day(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    return o.groupBy(F.date_format(numbers.service_day(F.col("day")), "yyyy-MM-dd").alias("service_day")).agg(F.count("*").alias("n"))


_KINDS = ("A", "N", "14", "7bis", "T3a", "TER", "")


def label_from_code(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size")
    short = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    station = F.concat(F.element_at(F.array(F.lit("TRAIN "), F.lit("METRO "), F.lit("TRAM "), F.lit("RER ")), (F.col("p_size") % 4 + 1).cast("int")), F.col("p_size").cast("string"))
    label = text.line_label(station)
    return p.select("p_partkey", text.timetable_label(short).alias("label"), label.alias("station_label"), text.line_order(label)["kind"].cast("bigint").alias("kind"), text.line_order(label)["number"].cast("bigint").alias("number"))


_LAYERS = ("walk_rer", "station_bike_gpe20271231", "walk_dest_defense_pointe", "no2", "lden_route", "commune", "bike_tram3a", "walk_")


def layer_group_of(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    name = F.element_at(F.array(*map(F.lit, _LAYERS)), (F.col("p_partkey") % len(_LAYERS) + 1).cast("int"))
    return p.select("p_partkey", text.layer_network(name).alias("network"), text.layer_group(name).alias("layer_group"))


def key_forms(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    line = F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("A"))
    opening = F.when(F.col("o_orderkey") % 2 == 0, F.col("day"))
    mode = F.when(F.col("o_orderkey") % 3 == 0, "métro").otherwise("tram")
    return o.select("o_orderkey", text.project_key(F.col("day")).alias("project"), text.tram_key(line, opening).alias("tram"), text.project_station(mode, line, F.col("o_orderpriority")).alias("station"))


def context_bins(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    seconds, minutes, tenths = (F.col("l_partkey") * 37) % 2400, (F.col("l_partkey") * 7) % 256, (F.col("l_suppkey") * 13) % 300
    out = li.select(
        numbers.walk_bin(seconds).alias("walk_bin"), numbers.destination_bin(minutes).alias("dest_bin"), numbers.pollutant_band(tenths, F.lit(2.0), F.lit(16.0)).alias("band"),
        numbers.noise_label((40 + 5 * (F.col("l_partkey") % 8)).cast("int")).alias("noise"), numbers.split_air_noise((F.col("l_quantity")).cast("int")).alias("s"),
    )
    return out.groupBy(F.col("walk_bin").cast("bigint").alias("walk_bin"), F.col("dest_bin").cast("bigint").alias("dest_bin"), F.col("band").cast("bigint").alias("band"), "noise", F.col("s.noise").cast("bigint").alias("noise_class"), F.col("s.air").cast("bigint").alias("air_class")).agg(F.count("*").alias("n"))


def air_light(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(((F.col("l_partkey") * 13) % 300).alias("v"))
    return li.groupBy(*(numbers.air_light(F.col("v"), p).alias(p) for p in ("no2", "pm25", "pm10"))).agg(F.count("*").alias("n"))


def price_colour(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    colour = numbers.price_colour((F.col("p_partkey") * 7) % 14000)
    return p.select("p_partkey", colour.alias("colour"), numbers.is_dark(colour).alias("dark"))


def colour_keys(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    key = numbers.packed_colour(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, (F.col("l_partkey") * 3) % 256, F.col("l_suppkey") * 7 % 256)
    return li.select(key.alias("k")).distinct().select("k", *(numbers.unpacked_colour(F.col("k"))[x].cast("bigint").alias(x) for x in "rgba"))


def rounding(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("v"))
    return p.select(
        "p_partkey", numbers.stored_seconds(F.col("v") / 2).cast("bigint").alias("seconds"), numbers.stored_minutes(F.col("v") * 30).cast("bigint").alias("minutes"),
        numbers.stored_tenths(F.col("v") / 4).cast("bigint").alias("tenths"), numbers.shown_minutes((F.col("p_partkey") * 30).cast("int")).cast("bigint").alias("shown"),
    )


def grid_and_cell_area(spark: SparkSession, d: str) -> DataFrame:
    """Grids over nations as Mercator extents (their key gives the place), and the area of rows in whole cm² times 1e-2."""
    n = table(spark, d, "nation").select("n_nationkey").withColumn("left", F.col("n_nationkey") * 1000.0).withColumn("top", 6_200_000.0 + F.col("n_nationkey") * 5000.0)
    rows = n.select("n_nationkey", "top", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("row"))
    return rows.select("n_nationkey", F.col("row").cast("bigint").alias("row"), F.floor(geo.cell_area(F.col("row"), F.col("top"), F.lit(15.0)) * 100).alias("area_cm"))


QUERIES = {f.__name__: f for f in (name_search, client_fold_search, code_prefix_recode, clock_to_seconds, next_service_day, label_from_code, layer_group_of, key_forms, context_bins, air_light, price_colour, colour_keys, rounding, grid_and_cell_area)}

_FOLD = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_CH = [[int(c[2 * k : 2 * k + 2], 16) for k in range(3)] for _, c in numbers.PRICE_STOPS]
_V = [v for v, _ in numbers.PRICE_STOPS]
_MIX = " ".join(
    f"WHEN v < {_V[i + 1]} THEN '#' || " + " || ".join(f"lower(lpad(to_hex(CAST(floor({_CH[i][k]} + ({_CH[i + 1][k] - _CH[i][k]}) * ((v - {_V[i]}) / CAST({_V[i + 1] - _V[i]} AS DOUBLE)) + 0.5) AS BIGINT)), 2, '0'))" for k in range(3)) for i in range(len(_V) - 1)
)
_HEX = "(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END)"
_LIN = lambda k: _HEX.replace("x", f"(CAST(('0x' || substr(colour, {2 + 2 * k}, 2)) AS INT) / 255.0)")
ORACLES = {
    "name_search": f"""SELECT c_custkey, c_name FROM customer WHERE {_FOLD.format('c_name')} LIKE '%10%' OR CAST(c_custkey AS VARCHAR) LIKE '10%'
  ORDER BY CASE WHEN {_FOLD.format('c_name')} LIKE '10%' THEN 0 ELSE 1 END, c_acctbal DESC NULLS LAST, CAST(c_custkey AS VARCHAR) LIMIT 10""",
    "client_fold_search": """WITH k AS (SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower('Sainte-' || p_name || ' l''Été saint')), '\\bsaint(e?)\\b', 'st\\1', 'g'), '[^a-z0-9]', '', 'g') AS key FROM part)
  SELECT p_partkey, key FROM k WHERE key LIKE '%ste%' ORDER BY CASE WHEN key LIKE 'ste%' THEN 0 ELSE 1 END, key, p_partkey LIMIT 10""",
    "code_prefix_recode": "SELECT CASE WHEN p_brand LIKE 'Brand#1%' THEN 'Brand#10' ELSE p_brand END AS code, count(*) AS n FROM part GROUP BY ALL",
    "clock_to_seconds": """WITH s AS (SELECT event_id, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS since FROM events)
  SELECT event_id, (since // 3600) || ':' || lpad(CAST(since % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(since % 60 AS VARCHAR), 2, '0') AS clock, since AS seconds FROM s""",
    "next_service_day": """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT strftime(day + CAST(((2 - isodow(day) + 6) % 7) + 1 AS INT), '%Y-%m-%d') AS service_day, count(*) AS n FROM s GROUP BY ALL""",
    "label_from_code": """WITH s AS (SELECT p_partkey, ['A', 'N', '14', '7bis', 'T3a', 'TER', ''][p_partkey % 7 + 1] AS short, ['TRAIN ', 'METRO ', 'TRAM ', 'RER '][p_size % 4 + 1] || p_size AS st, p_size FROM part)
  SELECT p_partkey, CASE WHEN short = '' THEN '' WHEN regexp_full_match(short, '[A-E]') THEN 'RER ' || short WHEN regexp_full_match(short, '[A-Z]') THEN 'Transilien ' || short
    WHEN regexp_full_match(short, '[0-9]+(bis)?') THEN 'Métro ' || short WHEN regexp_matches(short, '^T[0-9]') THEN 'Tram ' || short ELSE short END AS label,
    replace(replace(replace(st, 'TRAIN ', 'Transilien '), 'METRO ', 'Métro '), 'TRAM ', 'Tram T') AS station_label,
    CAST(CASE p_size % 4 WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS kind, CAST(CASE WHEN p_size % 4 IN (1, 2) THEN p_size ELSE 0 END AS BIGINT) AS number FROM s""",
    "layer_group_of": """WITH s AS (SELECT p_partkey, p_partkey % 8 AS k FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN 'rer' WHEN 1 THEN 'gpe20271231' WHEN 2 THEN 'dest_defense_pointe' WHEN 6 THEN 'tram3a' END AS network,
    CASE k WHEN 0 THEN 'transport' WHEN 1 THEN 'transport' WHEN 2 THEN 'destinations' WHEN 3 THEN 'air' WHEN 4 THEN 'bruit' WHEN 6 THEN 'transport' ELSE 'grille' END AS layer_group FROM s""",
    "key_forms": f"""WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, 'tram' || (o_orderkey % 9) || 'a' AS line, o_orderpriority FROM orders)
  SELECT o_orderkey, 'gpe' || day AS project, CASE WHEN o_orderkey % 2 = 0 THEN line || '_' || day ELSE line END AS tram,
    CASE WHEN o_orderkey % 3 = 0 THEN 'gpe' ELSE line END || '-' || {_FOLD.format('o_orderpriority')} AS station FROM s""",
    "context_bins": """WITH s AS (SELECT CAST(floor(((l_partkey * 37) % 2400) / 60.0 + 0.5) AS BIGINT) AS m, (l_partkey * 7) % 256 AS dm, (l_suppkey * 13) % 300 AS t, 40 + 5 * (l_partkey % 8) AS lv, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
  SELECT CAST(CASE WHEN m > 20 THEN 0 ELSE greatest(5, 5 * ((m + 4) // 5)) END AS BIGINT) AS walk_bin,
    CAST(CASE WHEN dm = 255 THEN 0 WHEN dm <= 20 THEN 20 WHEN dm <= 30 THEN 30 WHEN dm <= 45 THEN 45 WHEN dm <= 60 THEN 60 WHEN dm <= 90 THEN 90 ELSE 120 END AS BIGINT) AS dest_bin,
    CAST(CASE WHEN t = 0 THEN 0 ELSE 1 + least(6, greatest(0, floor((CAST(t AS DOUBLE) / 10 - 2.0) / 14.0 * 7))) END AS BIGINT) AS band,
    CASE lv WHEN 40 THEN '< 45 dB' WHEN 75 THEN '≥ 75 dB' ELSE lv || '–' || (lv + 5) || ' dB' END AS noise, q // 10 AS noise_class, q % 10 AS air_class, count(*) AS n FROM s GROUP BY ALL""",
    "air_light": "WITH s AS (SELECT (l_partkey * 13) % 300 AS v FROM lineitem) SELECT " + ", ".join(f"CASE WHEN v <= {a * 10} THEN 'green' WHEN v <= {b * 10} THEN 'orange' ELSE 'red' END AS {p}" for p, (a, b) in numbers.REFERENCE_VALUES.items()) + ", count(*) AS n FROM s GROUP BY ALL",
    "price_colour": f"""WITH s AS (SELECT p_partkey, (p_partkey * 7) % 14000 AS v FROM part), c AS (SELECT p_partkey, CASE WHEN v < 2000 THEN '#ffffd9' {_MIX} ELSE '#081d58' END AS colour FROM s)
  SELECT p_partkey, colour, 0.2126 * {_LIN(0)} + 0.7152 * {_LIN(1)} + 0.0722 * {_LIN(2)} < 0.25 AS dark FROM c""",
    "colour_keys": """SELECT DISTINCT ((l_partkey % 256) << 24) + ((l_suppkey % 256) << 16) + (((l_partkey * 3) % 256) << 8) + (l_suppkey * 7) % 256 AS k, l_partkey % 256 AS r, l_suppkey % 256 AS g, (l_partkey * 3) % 256 AS b, (l_suppkey * 7) % 256 AS a FROM lineitem""",
    "rounding": """SELECT p_partkey, CAST(round_even(p_partkey / 2.0, 0) AS BIGINT) AS seconds, CAST(least(254, round_even(p_partkey * 30 / 60.0, 0)) AS BIGINT) AS minutes,
  CAST(round_even(p_partkey / 4.0 * 10, 0) AS BIGINT) AS tenths, CASE WHEN p_partkey * 30 <> 65535 THEN CAST(greatest(1, floor(p_partkey * 30 / 60.0 + 0.5)) AS BIGINT) END AS shown FROM part""",
    "grid_and_cell_area": """WITH s AS (SELECT CAST(n_nationkey AS INT) AS n_nationkey, r AS row, 6200000.0::DOUBLE + n_nationkey * 5000.0::DOUBLE - (r + 0.5) * 15.0::DOUBLE AS y FROM nation, range(200) t(r)),
  a AS (SELECT n_nationkey, row, pow(15.0::DOUBLE * cos(radians(degrees(2 * atan(exp(y / 6378137.0::DOUBLE)) - pi() / 2))), 2.0::DOUBLE) AS area FROM s)
  SELECT n_nationkey, row, CAST(floor(round(area, 3) * 100) AS BIGINT) AS area_cm FROM a""",
}
