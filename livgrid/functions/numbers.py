"""Times, classes, colours and roundings as Column expressions. Half-even rounding unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
UNREACHABLE_S, UNREACHABLE_MIN = 65535, 255
REFERENCE_VALUES = {"no2": (10, 20), "pm25": (5, 10), "pm10": (15, 20)}
PRICE_STOPS = ((2000, "ffffd9"), (3000, "edf8b1"), (4000, "c7e9b4"), (5000, "7fcdbb"), (6000, "41b6c4"), (7000, "1d91c0"), (8000, "225ea8"), (10000, "253494"), (12000, "081d58"))


def seconds_of_day(clock: Column) -> Column:
    """H:M:S to seconds; hours may pass 23, and anything else is null."""
    part = lambda i: F.try_to_number(F.get(F.split(F.trim(clock), ":"), F.lit(i)), F.lit("999999")).cast("int")
    return part(0) * 3600 + part(1) * 60 + part(2)


def iso_date(moment: Column) -> Column:
    """The day (YYYY-MM-DD) of a timestamp in UTC, null-safe."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd")


def epoch_date(seconds: Column, zone: str) -> Column:
    """The local day of seconds since 1970, null-safe."""
    at = F.timestamp_seconds(seconds)
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")), "yyyy-MM-dd")


def service_day(downloaded: Column, day: str = "TU") -> Column:
    """The first such weekday strictly after a date."""
    return F.next_day(downloaded, day)


def minute_limit(minutes: int) -> int:
    """The most seconds that are shown as so many minutes."""
    return minutes * 60 + 29


def shown_minutes(seconds: Column) -> Column:
    """Minutes as shown: rounded half up, one at least; null if unreachable."""
    return F.when(seconds != UNREACHABLE_S, F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5))).cast("int")


def shown_text(seconds: Column) -> Column:
    return F.coalesce(F.concat(shown_minutes(seconds).cast("string"), F.lit(" min")), F.lit("plus d'1 h"))


def stored_seconds(t: Column) -> Column:
    return F.coalesce(F.rint(t).cast("int"), F.lit(UNREACHABLE_S))


def stored_minutes(t: Column) -> Column:
    """Door-to-door seconds to minutes, 254 at most; 255 if unreachable."""
    return F.coalesce(F.least(F.rint(t / 60), F.lit(UNREACHABLE_MIN - 1)).cast("int"), F.lit(UNREACHABLE_MIN))


def stored_tenths(v: Column) -> Column:
    """A concentration to tenths; unknown is 0."""
    return F.rint(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) * 10).cast("int")


def edge_seconds(length: Column, speed_kmh: Column | float) -> Column:
    return length / (speed_kmh / 3.6)


def split_air_noise(code: Column) -> Column:
    """Noise class from the tens, air class from the units."""
    return F.struct(F.floor(code / 10).cast("int").alias("noise"), (code % 10).cast("int").alias("air"))


def walk_bin(seconds: Column) -> Column:
    """5, 10, 15 or 20 minutes; 0 beyond."""
    m = F.floor(seconds / 60 + 0.5)
    return F.when(m > 20, 0).otherwise(F.greatest(F.lit(5), 5 * F.ceil(m / 5))).cast("int")


def destination_bin(minutes: Column) -> Column:
    """20, 30, 45, 60 or 90 minutes, 120 beyond, 0 if unreachable."""
    out = F.when(minutes == UNREACHABLE_MIN, 0)
    for b in (20, 30, 45, 60, 90):
        out = out.when(minutes <= b, b)
    return out.otherwise(120)


def pollutant_band(tenths: Column, least: Column, most: Column, bands: int = 7) -> Column:
    """1 to `bands`, of equal width over the range; 0 if unknown; a range of no width counts as 1 wide."""
    width = F.when(most - least == 0, 1.0).otherwise(most - least)
    band = F.floor((tenths / 10 - least) / width * bands)
    return F.when(tenths == 0, 0).otherwise(1 + F.least(F.lit(bands - 1), F.greatest(F.lit(0), band))).cast("int")


def noise_label(level: Column) -> Column:
    return F.when(level == 0, "n.d.").when(level == 40, "< 45 dB").when(level == 75, "≥ 75 dB").otherwise(F.concat(level.cast("string"), F.lit("–"), (level + 5).cast("string"), F.lit(" dB")))


def air_light(tenths: Column, pollutant: str) -> Column:
    """Green up to the lower reference value, orange up to the upper one, red beyond."""
    low, high = REFERENCE_VALUES[pollutant]
    return F.when(tenths <= low * 10, "green").when(tenths <= high * 10, "orange").otherwise("red")


def price_colour(median: Column) -> Column:
    """The colour between the neighbouring stops, rounded half up by channel; the ends' colours beyond."""
    channel = lambda h, k: int(h[2 * k : 2 * k + 2], 16)
    out = F.when(median < PRICE_STOPS[0][0], F.lit("#" + PRICE_STOPS[0][1]))
    for (v0, c0), (v1, c1) in zip(PRICE_STOPS, PRICE_STOPS[1:], strict=False):
        share = (median - v0) / (v1 - v0)
        mixed = [F.lower(F.lpad(F.hex(F.floor(channel(c0, k) + (channel(c1, k) - channel(c0, k)) * share + 0.5)), 2, "0")) for k in range(3)]
        out = out.when(median < v1, F.concat(F.lit("#"), *mixed))
    return out.otherwise(F.lit("#" + PRICE_STOPS[-1][1]))


def is_dark(colour: Column) -> Column:
    """Whether a #rrggbb colour's relative luminance is below a quarter."""
    value = lambda k: F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int") / 255
    linear = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(value(0)) + 0.7152 * linear(value(1)) + 0.0722 * linear(value(2)) < 0.25


def packed_colour(r: Column, g: Column, b: Column, a: Column) -> Column:
    wide = [c.cast("bigint") for c in (r, g, b, a)]
    return F.shiftleft(wide[0], 24) + F.shiftleft(wide[1], 16) + F.shiftleft(wide[2], 8) + wide[3]


def unpacked_colour(key: Column) -> Column:
    part = lambda n: F.shiftright(key, n).bitwiseAND(255).cast("int")
    return F.struct(part(24).alias("r"), part(16).alias("g"), part(8).alias("b"), part(0).alias("a"))
