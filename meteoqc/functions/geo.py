"""Great-circle distance and bearing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # fixed value


def _valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    km = 2.0 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))
    return F.when(_valid(lat1, lon1) & _valid(lat2, lon2), km)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    deg = F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))
    return F.when(_valid(lat1, lon1) & _valid(lat2, lon2), deg)


def cube_cell(lat: Column, lon: Column, size_km: float) -> Column:
    """Cell of a 3-D grid around the globe: points within ``size_km`` lie in adjacent cells.

    A chord is never longer than its arc, so no pole or date-line case is needed.
    """
    p, q = F.radians(lat), F.radians(lon)
    xyz = [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]
    cells = [F.floor(v * EARTH_RADIUS_KM / size_km).alias(n) for v, n in zip(xyz, ("cx", "cy", "cz"))]
    return F.struct(*cells)


def coarser(cell: Column, steps: Column) -> Column:
    """The cell of a grid whose sides are ``2^steps`` times as long that holds a ``cube_cell``."""
    return F.struct(*[F.call_function("shiftright", cell[a], steps).alias(a) for a in ("cx", "cy", "cz")])
