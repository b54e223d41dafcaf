"""Positions on the sphere and cells of regular grids, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon)))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees clockwise from north, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def centroid(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a summed vector."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def cell_row(lat: Column, per_degree: int = 24) -> Column:
    """Row of a north-origin grid."""
    return F.least(F.greatest(F.floor((90 - lat) * per_degree), F.lit(0)), F.lit(180 * per_degree - 1)).cast("int")


def cell_col(lon: Column, per_degree: int = 24) -> Column:
    """Column of a grid from 180 W; 180 E is 180 W."""
    return F.pmod(F.floor((lon + 180) * per_degree), F.lit(360 * per_degree)).cast("int")


def south_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Cell number of a south-origin grid, row by row."""
    wide = round(360 / degrees)
    row = F.least(F.floor((lat + 90) / degrees), F.lit(round(180 / degrees) - 1))
    return row * wide + F.least(F.floor((lon + 180) / degrees), F.lit(wide - 1))


def cell_lat(row: Column, per_degree: int = 24) -> Column:
    return 90 - (row + 0.5) / per_degree


def cell_lon(col: Column, per_degree: int = 24) -> Column:
    return -180 + (col + 0.5) / per_degree


def row_area_km2(row: Column, per_degree: int = 24) -> Column:
    """Exact area of a cell of that row: a spherical band's part."""
    top, bottom = F.radians(90 - row / per_degree), F.radians(90 - (row + 1) / per_degree)
    return EARTH_KM**2 * math.radians(1 / per_degree) * (F.sin(top) - F.sin(bottom))


def nearest_index(value: Column, first: float, step: float, wrap: int | None = None) -> Column:
    """The nearest grid index, half to even; wrapped if asked."""
    at = F.rint((value - first) / step).cast("int")
    return F.pmod(at, F.lit(wrap)) if wrap else at


def equal_area_xy(lat: Column, lon: Column, lat0: float = 45.0, lon0: float = -100.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area projection, in km."""
    a, d = F.radians(lat), F.radians(lon - lon0)
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    k = EARTH_KM * F.sqrt(2 / (1 + s0 * F.sin(a) + c0 * F.cos(a) * F.cos(d)))
    return k * F.cos(a) * F.sin(d), k * (c0 * F.sin(a) - s0 * F.cos(a) * F.cos(d))


def equal_area_latlon(x: Column, y: Column, lat0: float = 45.0, lon0: float = -100.0) -> tuple[Column, Column]:
    """The inverse of equal_area_xy."""
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * EARTH_KM)))
    lat = F.when(rho == 0, F.lit(lat0)).otherwise(F.degrees(F.asin(F.cos(c) * s0 + y * F.sin(c) * c0 / rho)))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c)))
    return lat, lon


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of two integers, x in the lower ones."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for c, at in ((x, 2 * k), (y, 2 * k + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), at))
    return out
