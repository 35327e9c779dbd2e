"""Projected lines: stops in order along their track, and sections of a line joined end to end.

A line has tens of stops and a handful of sections, and lines are independent: one group each.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from livgrid.operators.timetable import DETOUR

#: How far from its track a stop may be, and how far apart sections may end to be joined (metro; tram of one operation).
TRACK_M, METRO_GAP_M, TRAM_GAP_M = 300, 8000, 1000


def along(track: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point its nearest point of a track (rows x, y): how far along the track it is, and how far away. Every point meets every segment at once."""
    begin, step = track[:-1], np.diff(track, axis=0)
    length = np.hypot(*step.T)
    done = np.concatenate([[0.0], np.cumsum(length)[:-1]])
    t = np.clip(((points[:, None] - begin) * step).sum(2) / np.where(length > 0, length**2, 1.0), 0.0, 1.0)
    away = np.hypot(*np.moveaxis(points[:, None] - begin - t[..., None] * step, 2, 0))
    best = np.lexsort((done + t * length, away), axis=1)[:, 0]
    at = np.arange(len(points))
    return (done + t * length)[at, best], away[at, best]


@dataclass(frozen=True)
class Section:
    """Stops (id, x, y) in order, the metres between them, and the operation that builds it."""

    stops: tuple
    metres: tuple
    operation: str

    @property
    def ends(self) -> tuple:
        return self.stops[0][0], self.stops[-1][0]

    def turned(self) -> Section:
        return Section(self.stops[::-1], self.metres[::-1], self.operation)

    def apart(self, other: Section, but: int = 0) -> bool:
        """Whether no more than `but` stops are common."""
        return len({s[0] for s in self.stops} & {s[0] for s in other.stops}) <= but


def ordered(stops: list[tuple], track: list[tuple] | None, operation: str = "") -> Section:
    """A section of stops (id, x, y, terminus): along the track if all are near it, else a chain from a terminus (or the stop farthest from the middle),
    always to the nearest one left, with the usual detour."""
    at = np.array([s[1:3] for s in stops], float)
    if track is not None and len(track) > 1:
        place, away = along(np.array(track, float), at)
        if away.max() < TRACK_M:
            order = np.argsort(place, kind="stable")
            return Section(tuple(tuple(stops[k][:3]) for k in order), tuple(np.diff(place[order]).tolist()), operation)
    termini = [k for k, s in enumerate(stops) if s[3]]
    order = [termini[0] if termini else int(np.argmax(np.hypot(*(at - at.mean(0)).T)))]
    apart = np.hypot(*np.moveaxis(at[:, None] - at, 2, 0))
    metres = []
    left = np.ones(len(stops), bool)
    while len(order) < len(stops):
        left[order[-1]] = False
        distance = np.where(left, apart[order[-1]], np.inf)
        order.append(int(distance.argmin()))
        metres.append(float(distance.min()) * DETOUR)
    return Section(tuple(tuple(stops[k][:3]) for k in order), tuple(metres), operation)


def _glued(a: Section, b: Section) -> Section | None:
    """a and b as one where they share an end and nothing else; b keeps its direction if it can, then a."""
    shared = set(a.ends) & set(b.ends)
    if not shared or not a.apart(b, 1):
        return None
    for second in (b, b.turned()):
        if second.ends[0] in shared:
            first = a if a.ends[1] == second.ends[0] else a.turned()
            return Section(first.stops + second.stops[1:], first.metres + second.metres, a.operation)
    return None


def _bridge(a: Section, b: Section, metro: bool) -> tuple[float, Section] | None:
    """The metres between the nearest ends of sections without a common stop, and both as one over that gap; None if it is too wide."""
    if not a.apart(b):
        return None
    ways = [(math.dist(first.stops[-1][1:], second.stops[0][1:]), n, first, second) for n, (second, first) in enumerate((s, f) for s in (b, b.turned()) for f in (a, a.turned()))]
    gap, _, first, second = min(ways, key=lambda w: w[:2])
    if gap >= (METRO_GAP_M if metro else TRAM_GAP_M if a.operation == b.operation else 0):
        return None
    return gap, Section(first.stops + second.stops, (*first.metres, gap * DETOUR, *second.metres), a.operation)


def joined(sections: list[Section], metro: bool) -> list[Section]:
    """Sections joined at shared ends, then over the narrowest gaps.

    Shared ends go by an index from end stops to sections. A section takes in the first later one that fits until none does; no earlier one can
    fit it then, as it only gets more stops. Gaps wait in a queue, the narrowest first; a joined section's gaps are measured anew.
    """
    parts: dict[int, Section] = dict(enumerate(sections))
    at_end: dict[object, set[int]] = {}
    for k, s in parts.items():
        for e in s.ends:
            at_end.setdefault(e, set()).add(k)
    for k in range(len(sections)):
        while k in parts:
            later = sorted(j for e in parts[k].ends for j in at_end[e] if j > k)
            one, j = next(((g, j) for j in later if (g := _glued(parts[k], parts[j])) is not None), (None, None))
            if one is None:
                break
            for n in (k, j):
                for e in parts[n].ends:
                    at_end[e].discard(n)
            parts[k] = one
            del parts[j]
            for e in one.ends:
                at_end[e].add(k)
    age = dict.fromkeys(parts, 0)
    queue: list[tuple] = []

    def measured(i: int, j: int) -> None:
        if (b := _bridge(parts[i], parts[j], metro)) is not None:
            heapq.heappush(queue, (b[0], i, j, age[i], age[j], b[1].stops, b[1]))

    for i in parts:
        for j in parts:
            if i < j:
                measured(i, j)
    while queue:
        _, i, j, old, other, _, one = heapq.heappop(queue)
        if i in parts and j in parts and (age[i], age[j]) == (old, other):
            parts[i] = one
            age[i] += 1
            del parts[j]
            for k in parts:
                if k != i:
                    measured(min(i, k), max(i, k))
    return [parts[k] for k in sorted(parts)]


def routes(stops: DataFrame, tracks: DataFrame | None = None, by: tuple[str, str] = ("mode", "line")) -> DataFrame:
    """mode, line, section, pos, stop, metres (to the next one) of stops (mode, line, operation, phase, stop, x, y, terminus). tracks (mode, line, operation,
    phase, points: array of structs x, y): the drawn lines, where there are any; a null phase is that of stops with a null one."""

    def run(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        named = lambda part: {(o, None if pd.isna(p) else p): own for (o, p), own in part.groupby(["operation", "phase"], dropna=False, sort=True)}
        lines = {k: [(p["x"], p["y"]) for p in own["points"].iloc[0]] for k, own in named(drawn).items()} if len(drawn) else {}
        sections = []
        for key, part in named(rows).items() if len(rows) else ():
            each = part.drop_duplicates("stop").sort_values("stop", kind="stable")
            made = ordered(list(each[["stop", "x", "y", "terminus"]].itertuples(index=False, name=None)), lines.get(key), key[0])
            if len(made.stops) >= 2:
                sections.append(made)
        if not sections:
            return pd.DataFrame(columns=["mode", "line", "section", "pos", "stop", "metres"])
        mode, line = rows[by[0]].iloc[0], rows[by[1]].iloc[0]
        out = [(mode, line, n, k, s[0], m) for n, one in enumerate(joined(sections, mode == "métro")) for k, (s, m) in enumerate(zip(one.stops, [*one.metres, None], strict=True))]
        return pd.DataFrame(out, columns=["mode", "line", "section", "pos", "stop", "metres"])

    schema = "mode string, line string, section long, pos long, stop string, metres double"
    if tracks is None:
        return stops.groupBy(*by).applyInPandas(lambda rows: run(rows, rows.iloc[:0]), schema)
    return stops.groupBy(*by).cogroup(tracks.groupBy(*by)).applyInPandas(run, schema)
