"""Housing sales: cleaning by deed, exact quantiles with a least number of sales, and prices with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least surface, range of plausible prices a m², least sales for statistics, dwelling types.
LEAST_SURFACE, LEAST_PRICE, MOST_PRICE, LEAST_SALES = 9, 1000, 40000, 10
TYPES = {"Appartement": "appartement", "Maison": "maison"}
SALES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id_mutation", "date_mutation", "nature_mutation", "valeur_fonciere", "code_commune", "type_local", "surface_reelle_bati", "longitude", "latitude")])


def single_item_deeds(rows: DataFrame, deed: str, is_item: Column, is_barred: Column) -> DataFrame:
    """The deeds with exactly one item and nothing barred; a null deed drops out."""
    return rows.filter(F.col(deed).isNotNull()).groupBy(deed).agg(F.count_if(is_item).alias("items"), F.count_if(is_barred).alias("barred")).filter("items = 1 AND barred = 0").select(deed)


def recoded(code: Column, prefix: str = "751", whole: str = "75056") -> Column:
    """The code of the whole municipality instead of those of its districts."""
    return F.when(code.startswith(prefix), whole).otherwise(code)


def clean_sales(raw: DataFrame) -> DataFrame:
    """code, date, type, pm2, lon, lat of the plain sales of one dwelling each. pm2 is tested before it is rounded."""
    sold = raw.filter(F.col("nature_mutation") == "Vente")
    dwelling = F.coalesce(F.col("type_local").isin(*TYPES), F.lit(False))
    deeds = single_item_deeds(sold, "id_mutation", dwelling, F.coalesce(F.col("type_local").startswith("Local"), F.lit(False)))
    number = lambda c: F.col(c).try_cast("double")
    out = sold.filter(dwelling).join(deeds, "id_mutation", "left_semi").withColumn("surface", number("surface_reelle_bati"))
    out = out.filter(F.col("surface") >= LEAST_SURFACE).withColumn("pm2", number("valeur_fonciere") / F.col("surface")).filter(F.col("pm2").between(LEAST_PRICE, MOST_PRICE))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("type_local"))
    return out.select(recoded(F.col("code_commune")).alias("code"), F.col("date_mutation").alias("date"), kind.alias("type"), F.rint("pm2").cast("int").alias("pm2"), number("longitude").alias("lon"), number("latitude").alias("lat"))


def price_statistics(sales: DataFrame, keys: list[str], types: list[str], value: str = "pm2", type_column: str = "type", least: int = LEAST_SALES) -> DataFrame:
    """By key and type: n, and from `least` sales on p10, q1, med, q3, p90 (exact, linear between ranks, rounded to tens half even).
    A key that has any sale has a row for every type."""
    quantiles = F.percentile(value, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    found = sales.groupBy(*keys, type_column).agg(F.count("*").alias("n"), quantiles.alias("q"))
    every = found.select(*keys).distinct().withColumn(type_column, F.explode(F.array(*map(F.lit, types))))
    out = every.join(found, [*keys, type_column], "left")
    rounded = lambda i: F.when(F.col("n") >= least, F.bround(F.get("q", F.lit(i)), -1).cast("bigint"))
    return out.select(*keys, type_column, F.coalesce("n", F.lit(0)).alias("n"), *(rounded(i).alias(k) for i, k in enumerate(("p10", "q1", "med", "q3", "p90"))))


def price_with_fallback(places: DataFrame, own: DataFrame, wider: DataFrame, own_keys: list[str], wider_keys: list[str]) -> DataFrame:
    """places with the median of their own statistics, else that of the wider ones (flagged), else 0."""
    own, wider = own.select(*own_keys, F.col("med").alias("own_med"), F.col("n").alias("n")), wider.select(*wider_keys, F.col("med").alias("wider_med"))
    out = places.join(own, own_keys, "left").join(wider, wider_keys, "left")
    return out.withColumn("price", F.coalesce("own_med", "wider_med", F.lit(0))).withColumn("fallback", F.col("own_med").isNull() & F.col("wider_med").isNotNull()).withColumn("n", F.coalesce("n", F.lit(0))).drop("own_med", "wider_med")


def price_display(shown: DataFrame, most: int) -> DataFrame:
    """What a look-up shows: a median, one that is the wider place's, or the number of sales alone; and whether it is above the limit."""
    return shown.withColumn("shows", F.when(F.col("price") == 0, "count").when(F.col("fallback"), "fallback").otherwise("own")).withColumn("above", F.col("price") > most)


def prices_json(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: the statistics of a place by type; missing quantiles are left out."""
    entry = F.struct("n", "p10", "q1", "med", "q3", "p90")
    return statistics.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("type"), entry.alias("s")))))).alias("json"))
