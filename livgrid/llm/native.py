"""Column expressions that several operators without Python on the executors share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gone through at a time. Appending to an array copies it, so going through n elements in one go would cost n * n.
BLOCK = 128


def _slices(array: Column) -> Column:
    """The array (not empty) in pieces of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(numbers: Column, step=_plus, start: int = 0) -> Column:
    """What step makes of start and the first one, two, three ... of an array of ints: an array as long. step is associative, and start is its neutral value."""

    def walked(piece: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(piece, zero, lambda acc, n: F.struct(step(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], n))).alias("out")))["out"]

    def joined(pieces: Column) -> Column:
        before = walked(F.transform(pieces, lambda p: F.aggregate(p, F.lit(start), step)), F.lit(start))
        starts = F.concat(F.array(F.lit(start)), F.slice(before, 1, F.size(before) - 1))
        return F.flatten(F.zip_with(pieces, starts, walked))

    # lambdas keep what they read computed once
    once = F.transform(F.array(numbers), lambda x: F.when(F.size(x) > 0, F.transform(F.array(_slices(x)), joined)[0]).otherwise(x))
    return once[0]


def apart(spans: Column, others: Column) -> Column:
    """The spans (structs that begin with start, kind, end) that overlap none of the others: by the farthest end of others that begin before one or
    with it, and the next beginning behind."""
    far = 1 << 30
    tagged = lambda side, own: F.transform(side, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("s")))

    def kept(every: Column) -> Column:
        reached = running(F.transform(every, lambda x: F.when(x["own"], -1).otherwise(x["end"])), _most, -1)
        ahead = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["own"], far).otherwise(x["start"]))), _least, far))
        both = F.arrays_zip(every.alias("x"), reached.alias("reached"), ahead.alias("ahead"))
        return F.transform(F.filter(both, lambda z: z["x"]["own"] & (z["reached"] <= z["x"]["start"]) & (z["ahead"] >= z["x"]["end"])), lambda z: z["x"]["s"])

    return F.transform(F.array(F.array_sort(F.concat(tagged(others, False), tagged(spans, True)))), kept)[0]


def spans(text: Column, pattern: str | Column, groups: tuple[int, ...] = (0,)) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches empty text: an array of structs with start and end in
    code points (end exclusive) and g<i> for each group. The pieces between the matches give the offsets."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.arrays_zip(pieces.alias("gap"), *(F.regexp_extract_all(text, pattern, F.lit(i)).alias(f"g{i}") for i in groups))
    kind = "array<struct<start:int,end:int," + ",".join(f"g{i}:string" for i in groups) + ">>"

    def placed(found: Column) -> Column:
        at = running(F.transform(found, lambda x: x["gap"] + F.length(x["g0"])))
        return F.zip_with(found, at, lambda x, end: F.struct((end - F.length(x["g0"])).alias("start"), end.alias("end"), *(x[f"g{i}"].alias(f"g{i}") for i in groups)))

    # the last piece follows the last match and has no match of its own
    matched = F.transform(F.array(found), lambda f: F.slice(f, 1, F.size(f) - 1))
    walked = F.transform(matched, placed)[0]
    return F.when(F.regexp(text, pattern), walked).otherwise(F.array().cast(kind))
