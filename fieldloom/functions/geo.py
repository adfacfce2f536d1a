"""Map projections, grids and distances as closed-form column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# WGS 84, and the standard parallel of the global equal-area cylinder (EPSG:6933)
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
LAT_TS = math.radians(30.0)
K0 = math.cos(LAT_TS) / math.sqrt(1 - E2 * math.sin(LAT_TS) ** 2)
QP = (1 - E2) * (1 / (1 - E2) - math.log((1 - E) / (1 + E)) / (2 * E))
EARTH_RADIUS = 6371000.0


def _q(sin_lat: Column) -> Column:
    es = E * sin_lat
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat * sin_lat) - F.log((1 - es) / (1 + es)) / (2 * E))


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to EPSG:6933 metres."""
    return F.radians(lon) * (A * K0), _q(F.sin(F.radians(lat))) * (A / (2 * K0))


def from_equal_area(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:6933 metres to degrees, by the authalic latitude series."""
    b = F.asin(2 * K0 * y / (A * QP))
    lat = b + (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040) * F.sin(2 * b) + (23 * E2**2 / 360 + 251 * E2**3 / 3780) * F.sin(4 * b) + (761 * E2**3 / 45360) * F.sin(6 * b)
    return F.degrees(x / (A * K0)), F.degrees(lat)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to Web Mercator metres."""
    return F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone number and latitude band letter."""
    number = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    band = F.substring(F.lit("CDEFGHJKLMNPQRSTUVWX"), F.least(F.floor((lat + 80) / 8) + 1, F.lit(20)).cast("int"), F.lit(1))
    return F.concat(number.cast("string"), band)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone, by Krueger's series to third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    central = (F.least(F.floor((lon + 180) / 6), F.lit(59)) * 6 - 177).cast("double")
    phi, lam = F.radians(lat), F.radians(lon - central)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - 2 * math.sqrt(n) / (1 + n) * F.atanh(2 * math.sqrt(n) / (1 + n) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(a, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + 0.9996 * radius * north


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cell_index(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """(row, col) in a north-up grid whose corner is (x0, y0): truncated toward zero, not floored."""
    return ((y0 - y) / dy).cast("int"), ((x - x0) / dx).cast("int")


def degree_bin(c: Column, origin: float, size: float) -> Column:
    """Centre of the bin of ``size`` degrees, floored."""
    return F.floor((c + origin) / size) * size - origin + size / 2


def _cube(x: Column, y: Column, edge: float) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Rounded cube coordinates of a planar point, and how far each was rounded."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / edge, (2 / 3 * y) / edge
    exact = (q, r, -q - r)
    whole = tuple(F.rint(c) for c in exact)
    return whole, tuple(F.abs(w - c) for w, c in zip(whole, exact))


def hex_cell(x: Column, y: Column, edge: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon of edge ``edge`` that holds a planar point (cube rounding)."""
    (rq, rr, rs), (dq, dr, ds) = _cube(x, y, edge)
    worst_q, worst_r = (dq > dr) & (dq > ds), dr > ds
    return F.when(worst_q, -rr - rs).otherwise(rq).cast("long"), F.when(~worst_q & worst_r, -rq - rs).otherwise(rr).cast("long")


@F.pandas_udf(DoubleType())
def _northing(lat: pd.Series) -> pd.Series:
    """The y of :func:`to_equal_area` by the C library; nulls stay."""
    lats, out = lat.to_numpy(float), np.full(len(lat), np.nan)
    for i in np.flatnonzero(np.isfinite(lats)):
        s = math.sin(math.radians(lats[i]))
        out[i] = (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E * s) / (1 + E * s)) / (2 * E)) * (A / (2 * K0))
    return pd.Series(out)


def hex_cell_at(lon: Column, lat: Column, edge: float) -> tuple[Column, Column]:
    """:func:`hex_cell` of a place in degrees, the same as in SQL on the edges too.

    Edges of every other row of hexagons lie on the meridian of 0, where the last bit of y decides. The JVM's sine and logarithm differ from the C library's
    in that bit now and then, so the few places within 1e-9 of an edge take y from the C library."""
    x, y = to_equal_area(lon, lat)
    _, (dq, dr, ds) = _cube(x, y, edge)
    near = (F.least(F.abs(dq - dr), F.abs(dq - ds), F.abs(dr - ds)) < 1e-9) | (F.greatest(dq, dr, ds) > 0.5 - 1e-9)
    return hex_cell(x, F.coalesce(_northing(F.when(near, lat)), y), edge)


def hex_polygon(q: Column, r: Column, edge: float) -> Column:
    """Corners (x, y) of a hexagon of :func:`hex_cell`, anticlockwise from the right one of the upper edge's two."""
    cx, cy = edge * math.sqrt(3) * (q + r / 2), edge * 1.5 * r
    corner = lambda k: F.struct((cx + edge * math.cos(math.radians(30 + 60 * k))).alias("x"), (cy + edge * math.sin(math.radians(30 + 60 * k))).alias("y"))
    return F.array(*[corner(k) for k in range(6)])


def hex_outline(q: Column, r: Column, edge: float) -> Column:
    """The same in degrees, from the equal-area plane."""
    degrees = lambda p: from_equal_area(p["x"], p["y"])
    return F.transform(hex_polygon(q, r, edge), lambda p: F.struct(degrees(p)[0].alias("lon"), degrees(p)[1].alias("lat")))


def rect_zone(c: Column, low: Column, high: Column, n: int) -> Column:
    """Bin 1 to n of n equal steps from low to high; the highest value belongs to bin n."""
    return F.least(F.floor((c - low) / ((high - low) / (n - 1))) + 1, F.lit(n)).cast("int")


def crosses_antimeridian(lons: Column) -> Column:
    return F.exists(lons, lambda x: x > 150) & F.exists(lons, lambda x: x < -150)


def zone_area(lat: Column, size: float) -> Column:
    """Area, up to a factor common to all, of a cell of ``size`` degrees centred at ``lat``, on the ellipsoid."""
    return _q(F.sin(F.radians(lat + size / 2))) - _q(F.sin(F.radians(lat - size / 2)))


def hex_edge_for_range(metres: float) -> float:
    """Edge of hexagons whose inscribed circle spans a range: the blocking size for a correlation length."""
    return metres / math.sqrt(3)


def hex_resolution(edge_km: float) -> float:
    """Unrounded resolution of the common aperture-7 hierarchy with that edge, by its log-linear law (fixed values: slope -1.0274, intercept 7.3504)."""
    return (math.log(edge_km) - 7.3504) / -1.0274 if edge_km > 0 else math.inf


def resolution_for_density(n: int, area_km2: float) -> int:
    """Coarser hexagons where samples are sparse."""
    density = n / max(area_km2, 1e-9)
    return next((r for bound, r in ((1e-4, 1), (1e-3, 2), (1e-2, 3), (1e-1, 4)) if density < bound), 5)
