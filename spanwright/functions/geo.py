"""Spherical and grid kernels on columns: degrees in, kilometres or cells out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def cell(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lon / size).cast("int"), F.floor(lat / size).cast("int")


def ring_area_km2(ring: Column, radius: float = EARTH_KM) -> Column:
    """Unsigned spherical area of a closed ring of (x, y) structs: the sum of dlon * (sin lat) over its sides."""
    n = F.size(ring)
    side = lambda i: F.radians(F.get(ring, i)["x"] - F.get(ring, i - 1)["x"]) * (2 + F.sin(F.radians(F.get(ring, i)["y"])) + F.sin(F.radians(F.get(ring, i - 1)["y"])))
    return F.abs(F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, i: acc + side(i))) * (radius * radius / 2)


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the sides of a closed ring."""

    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(False), lambda acc, i: acc != F.coalesce(crossed(i), F.lit(False)))


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    s = F.sin(F.radians(lat))
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n)
    inside = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), v)).cast("int")
    return inside(x), inside(y)


def box_extent(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Width times height times the cosine of the middle latitude; boxes may cross the antimeridian."""
    width = F.when(e >= w, e - w).otherwise(e - w + 360)
    return F.greatest(F.lit(0.0), width * (n - s) * F.cos(F.radians((s + n) / 2)))
