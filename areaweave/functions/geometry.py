"""Plane geometry as Columns, and the equal-area projection of geodetic coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid GRS80 and the parameters of the Australian Albers projection.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ORIGIN_LON = -18.0, -36.0, 0.0, 132.0

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(sin: float) -> float:
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_P1, _P2, _P0 = (math.radians(x) for x in (PARALLEL_1, PARALLEL_2, ORIGIN_LAT))
_N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(math.sin(_P2)) - _q(math.sin(_P1)))
_C = _m(_P1) ** 2 + _N * _q(math.sin(_P1))
_RHO0 = SEMI_MAJOR * math.sqrt(_C - _N * _q(math.sin(_P0))) / _N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; areas in this plane are areas on the ellipsoid."""
    s = F.sin(F.radians(lat))
    q = F.lit(1 - _E2) * (s / (F.lit(1.0) - F.lit(_E2) * s * s) - F.ln((F.lit(1.0) - F.lit(_E) * s) / (F.lit(1.0) + F.lit(_E) * s)) / F.lit(2 * _E))
    rho = F.lit(SEMI_MAJOR) * F.sqrt(F.lit(_C) - F.lit(_N) * q) / F.lit(_N)
    theta = F.lit(_N) * F.radians(lon - F.lit(ORIGIN_LON))
    return rho * F.sin(theta), F.lit(_RHO0) - rho * F.cos(theta)


def crosses(px: Column, py: Column, e: Column) -> Column:
    """1 if an edge crosses the ray from a point to the right, else 0; the division is behind its guard."""
    apart = (e["y1"] > py) != (e["y2"] > py)
    at = (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
    return F.when(apart & (px < at), 1).otherwise(0)


def on_edge(px: Column, py: Column, e: Column) -> Column:
    """Whether a point lies on an edge."""
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    within = px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return (cross == 0) & within


def inside(px: Column, py: Column, edges: Column) -> Column:
    """Whether a point lies within (not on) a polygon, by the even-odd rule over all its rings."""
    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(px, py, e)) % 2 == 1
    return odd & ~F.exists(edges, lambda e: on_edge(px, py, e))


def signed_area(edges: Column) -> Column:
    """The shoelace sum over edges."""
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2
