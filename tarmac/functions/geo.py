"""Column functions of geometry on the sphere and the plane. Angles are degrees, lengths metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius of the WGS84 ellipsoid's equator (as Web Mercator takes it), and mean radius of the earth.
EQUATOR_RADIUS = 6378137.0
MEAN_RADIUS = 6371008.8


def mercator_x(lon: Column) -> Column:
    """Web Mercator easting."""
    return F.radians(lon) * EQUATOR_RADIUS


def mercator_y(lat: Column) -> Column:
    """Web Mercator northing."""
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EQUATOR_RADIUS


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance_3d(flat: Column, rise: Column) -> Column:
    """Length of a way with a rise."""
    return F.sqrt(flat * flat + rise * rise)


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing at the first point, from 0 to below 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return (angle + 360) % 360


def local_east(lon: Column, lon0: Column, lat0: Column, radius: float = MEAN_RADIUS) -> Column:
    """Metres east of an origin, on a plane that touches the sphere there."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius


def local_north(lat: Column, lat0: Column, radius: float = MEAN_RADIUS) -> Column:
    """Metres north of an origin."""
    return F.radians(lat - lat0) * radius


def from_local(east: Column, north: Column, lat0: Column, lon0: Column, radius: float = MEAN_RADIUS) -> tuple[Column, Column]:
    """Latitude and longitude of a point of the plane; the inverse of ``local_east`` and ``local_north``."""
    return lat0 + F.degrees(north / radius), lon0 + F.degrees(east / (radius * F.cos(F.radians(lat0))))


def linestring(points: Column) -> Column:
    """WKT of an array of (x, y), with two decimals."""
    pair = F.transform(points, lambda p: F.concat(F.format_string("%.2f", p["x"]), F.lit(" "), F.format_string("%.2f", p["y"])))
    return F.concat(F.lit("LINESTRING("), F.array_join(pair, ", "), F.lit(")"))
