"""Names, codes and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED, PLAIN = "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"
ACCENTED_MORE, PLAIN_MORE = "áãåìíòóõúñýÿ", "aaaiiooounyy"
BASE_NETWORKS = ("rer", "transilien", "metro")
POLLUTANTS = ("no2", "pm25", "pm10")
NOISE_LAYERS = ("bp_noise", "bp_air", "lden_route", "lden_fer")
NETWORK_COLOURS = (("rer", "#c2185b"), ("transilien", "#1565c0"), ("metro", "#e0a100"), ("gpe", "#00897b"), ("tram", "#5e35b1"))


def fold(name: Column) -> Column:
    """A name as search compares it: lower case, the known accents dropped, letters a-z and digits alone."""
    return F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^a-z0-9]", "")


def fold_local(name: Column) -> Column:
    """The local look-up's form: all accents dropped, saint(e) as a word shortened to st(e), letters and digits alone."""
    plain = F.translate(F.lower(name), ACCENTED + ACCENTED_MORE, PLAIN + PLAIN_MORE)
    return F.regexp_replace(F.regexp_replace(plain, r"\bsaint(e?)\b", "st$1"), "[^a-z0-9]", "")


def matches_search(name: Column, code: Column, query: str) -> Column:
    """Whether a place is found: its folded name holds the folded query, or its code starts with the trimmed query."""
    q = fold(F.lit(query))
    return (q != "") & (F.contains(fold(name), q) | code.startswith(query.strip()))


def compact_date(date: Column) -> Column:
    return F.regexp_replace(date, "-", "")


def project_key(date: Column) -> Column:
    return F.concat(F.lit("gpe"), compact_date(date))


def tram_key(line: Column, date: Column | None = None) -> Column:
    """tram3a, or tram1_20281231 for stops that open on a date; a null date is no date."""
    base = F.concat(F.lit("tram"), F.lower(line))
    return base if date is None else F.when(date.isNull(), base).otherwise(F.concat(base, F.lit("_"), compact_date(date)))


def project_station(mode: Column, line: Column, name: Column) -> Column:
    """The identifier of a station of a projected line."""
    return F.concat(F.when(mode == "métro", "gpe").otherwise(tram_key(line)), F.lit("-"), fold(name))


def line_label(short: Column) -> Column:
    """TRAIN P, METRO 7bis and TRAM 3a as shown."""
    out = F.replace(short, F.lit("TRAIN "), F.lit("Transilien "))
    return F.replace(F.replace(out, F.lit("METRO "), F.lit("Métro ")), F.lit("TRAM "), F.lit("Tram T"))


def timetable_label(short: Column) -> Column:
    """A timetable's short line name as shown; the first rule that fits wins."""
    return (
        F.when(F.coalesce(short, F.lit("")) == "", F.lit(""))
        .when(short.rlike("^[A-E]$"), F.concat(F.lit("RER "), short))
        .when(short.rlike("^[A-Z]$"), F.concat(F.lit("Transilien "), short))
        .when(short.rlike(r"^\d+(bis)?$"), F.concat(F.lit("Métro "), short))
        .when(short.rlike(r"^T\d"), F.concat(F.lit("Tram "), short))
        .otherwise(short)
    )


def line_order(label: Column) -> Column:
    """A struct to sort line labels by: kind, number, label."""
    kind = F.when(label.startswith("RER"), 0).when(label.startswith("Transilien"), 1).when(label.startswith("Métro"), 2).otherwise(3)
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(label, r"^(?:Métro |Tram T)(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(kind.alias("kind"), number.alias("number"), label.alias("label"))


def tram_order(line: Column) -> Column:
    """A struct to sort tram lines by: the number they start with, then the text."""
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(line, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("number"), line.alias("line"))


def layer_network(layer: Column) -> Column:
    """The network of a time or station layer's name; null for any other layer."""
    return F.nullif(F.regexp_extract(layer, r"^(?:station_)?(?:walk|bike)_(.+)$", 1), F.lit(""))


def layer_group(layer: Column) -> Column:
    """The group that a layer is rebuilt with."""
    network = layer_network(layer)
    return F.when(network.startswith("dest_"), "destinations").when(network.isNotNull(), "transport").when(layer.isin(*POLLUTANTS), "air").when(layer.isin(*NOISE_LAYERS), "bruit").otherwise("grille")


def networks_to_compute(found: Column) -> Column:
    """The base networks always, then the others found, sorted."""
    base = F.array(*map(F.lit, BASE_NETWORKS))
    return F.concat(base, F.array_sort(F.array_except(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), base)))


def parent_zone(parent: Column, prefix: str = "IDFM:") -> Column:
    return F.replace(F.coalesce(parent, F.lit("")), F.lit(prefix), F.lit(""))


def with_district(name: Column, owner: Column) -> Column:
    """A neighbourhood's name with the postal code of the district that owns it, if one does."""
    return F.when(owner.isNotNull(), F.concat(name, F.lit(" (750"), F.right(owner, F.lit(2)), F.lit(")"))).otherwise(name)


def renamed(name: Column, names: Column) -> Column:
    return F.coalesce(F.try_element_at(names, name), name)


def station_colour(networks: Column) -> Column:
    """The colour of the first network of the priority list that the joined networks hold; the first one's otherwise."""
    out = F.when(F.contains(networks, F.lit(NETWORK_COLOURS[0][0])), NETWORK_COLOURS[0][1])
    for name, colour in NETWORK_COLOURS[1:]:
        out = out.when(F.contains(networks, F.lit(name)), colour)
    return out.otherwise(NETWORK_COLOURS[0][1])


def any_selected(networks: Column, selected: Column) -> Column:
    return F.arrays_overlap(F.split(F.coalesce(networks, F.lit("rer")), ","), selected)
