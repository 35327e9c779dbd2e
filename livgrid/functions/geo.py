"""Coordinate systems as Column expressions: 4326 and 3857 in closed form, 2154 and 27572 by the conformal conic's."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the coordinate systems.
R = 6378137.0


class Ellipsoid(NamedTuple):
    a: float
    e2: float


GRS80 = Ellipsoid(6378137.0, 0.0066943800229034)
CLARKE = Ellipsoid(6378249.2, 0.00680348764629948)


class Conic(NamedTuple):
    """A conformal conic: exponent, constant, false origin, central meridian in degrees east of Greenwich."""

    shape: Ellipsoid
    n: float
    c: float
    x0: float
    y0: float
    meridian: float


def _isometric(e: float, lat: float) -> float:
    s = math.sin(lat)
    return math.atanh(s) - e * math.atanh(e * s)


def _secant(shape: Ellipsoid, lat1: float, lat2: float, lat0: float, x0: float, y0: float, meridian: float) -> Conic:
    e = math.sqrt(shape.e2)
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    m = lambda p: math.cos(p) / math.sqrt(1 - shape.e2 * math.sin(p) ** 2)
    n = math.log(m(p1) / m(p2)) / (_isometric(e, p2) - _isometric(e, p1))
    c = shape.a * m(p1) / n * math.exp(n * _isometric(e, p1))
    return Conic(shape, n, c, x0, y0 + c * math.exp(-n * _isometric(e, p0)), meridian)


def _tangent(shape: Ellipsoid, lat0: float, scale: float, x0: float, y0: float, meridian: float) -> Conic:
    e, p = math.sqrt(shape.e2), math.radians(lat0)
    n = math.sin(p)
    r0 = scale * shape.a / math.sqrt(1 - shape.e2 * math.sin(p) ** 2) / math.tan(p)
    c = r0 * math.exp(n * _isometric(e, p))
    return Conic(shape, n, c, x0, y0 + r0, meridian)


L93 = _secant(GRS80, 44.0, 49.0, 46.5, 700000.0, 6600000.0, 3.0)
L2E = _tangent(CLARKE, 46.8, 0.99987742, 600000.0, 2200000.0, 2.33722917)
#: From the old datum's geocentric coordinates to the new one's, in metres.
SHIFT = (-168.0, -60.0, 320.0)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * R


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * R


def lon_of(x: Column) -> Column:
    return F.degrees(x / R)


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / R)) - math.pi / 2)


def cell_area(row: Column, top: Column, cell: Column) -> Column:
    """The true area of a cell of a Mercator grid's row, in m² with three decimals."""
    y = top - (row + 0.5) * cell
    return F.round(F.pow(cell * F.cos(F.radians(lat_of(y))), F.lit(2.0)), 3)


def _project(cone: Conic, lon: Column, lat: Column) -> Column:
    e = math.sqrt(cone.shape.e2)
    s = F.sin(F.radians(lat))
    iso = F.atanh(s) - e * F.atanh(e * s)
    r = cone.c * F.exp(-cone.n * iso)
    angle = cone.n * F.radians(lon - cone.meridian)
    return F.struct((cone.x0 + r * F.sin(angle)).alias("x"), (cone.y0 - r * F.cos(angle)).alias("y"))


def _unproject(cone: Conic, x: Column, y: Column) -> Column:
    e = math.sqrt(cone.shape.e2)
    dx, dy = x - cone.x0, cone.y0 - y
    iso = F.ln(cone.c / F.hypot(dx, dy)) / cone.n
    lat = F.asin(F.tanh(iso))
    for _ in range(6):  # each step gains more than two digits
        lat = F.asin(F.tanh(iso + e * F.atanh(e * F.sin(lat))))
    return F.struct((F.degrees(F.atan2(dx, dy) / cone.n) + cone.meridian).alias("lon"), F.degrees(lat).alias("lat"))


def to_l93(lon: Column, lat: Column) -> Column:
    """x, y in the national grid (2154)."""
    return _project(L93, lon, lat)


def from_l93(x: Column, y: Column) -> Column:
    return _unproject(L93, x, y)


def _shifted(lon: Column, lat: Column, old: Ellipsoid, new: Ellipsoid, sign: int) -> Column:
    """Through geocentric coordinates, at height 0."""
    p, q = F.radians(lat), F.radians(lon)
    normal = old.a / F.sqrt(1 - old.e2 * F.sin(p) * F.sin(p))
    x, y, z = normal * F.cos(p) * F.cos(q) + sign * SHIFT[0], normal * F.cos(p) * F.sin(q) + sign * SHIFT[1], normal * (1 - old.e2) * F.sin(p) + sign * SHIFT[2]
    flat = F.hypot(x, y)
    out = F.atan2(z, flat * (1 - new.e2))
    for _ in range(4):
        out = F.atan2(z + new.e2 * new.a / F.sqrt(1 - new.e2 * F.sin(out) * F.sin(out)) * F.sin(out), flat)
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(out).alias("lat"))


def to_l2e(lon: Column, lat: Column) -> Column:
    """x, y in the extended old grid (27572)."""
    old = _shifted(lon, lat, GRS80, CLARKE, -1)
    return _project(L2E, old["lon"], old["lat"])


def from_l2e(x: Column, y: Column) -> Column:
    old = _unproject(L2E, x, y)
    return _shifted(old["lon"], old["lat"], CLARKE, GRS80, 1)
