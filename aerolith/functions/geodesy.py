"""Distances and scale factors on the sphere and on the WGS84 ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.schema import Coordinate

# fixed values: the WGS84 ellipsoid and the mean earth radius
A, FLATTENING, RADIUS = 6378137.0, 1 / 298.257223563, 6371008.7714
E2 = FLATTENING * (2 - FLATTENING)
N = FLATTENING / (2 - FLATTENING)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere between points in degrees."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * RADIUS * F.asin(F.sqrt(h))


def easting(longitude: Column) -> Column:
    """Metres along the equator."""
    return A * F.radians(longitude)


def northing(latitude: Column) -> Column:
    """Metres along the meridian from the equator, by the series in the third flattening."""
    p = F.radians(latitude)
    return (
        A / (1 + N)
        * ((1 + N**2 / 4 + N**4 / 64) * p - 1.5 * (N - N**3 / 8) * F.sin(2 * p) + 15 / 16 * (N**2 - N**4 / 4) * F.sin(4 * p) - 35 / 48 * N**3 * F.sin(6 * p) + 315 / 512 * N**4 * F.sin(8 * p))
    )


def _curvature(latitude: Column) -> Column:
    s = F.sin(F.radians(latitude))
    return 1 - E2 * s * s


def parallel_scale(latitude: Column) -> Column:
    """Of the plate carree projection along a parallel; null at the poles."""
    return F.when(F.abs(latitude) < 90, F.sqrt(_curvature(latitude)) / F.cos(F.radians(latitude)))


def meridional_scale(latitude: Column) -> Column:
    return F.pow(_curvature(latitude), F.lit(1.5)) / (1 - E2)


def check_degrees(latitude: tuple[float, float], units: str) -> None:
    """Raises if a range of latitudes cannot be of the units, `deg` or `rad`."""
    low, high = latitude
    if units == "rad" and max(abs(low), abs(high)) > math.pi / 2:
        raise ValueError("latitudes are beyond pi / 2: they are not in radians")
    if units == "deg" and max(abs(low), abs(high)) > 90:
        raise ValueError("latitudes are beyond 90 degrees")
    if units not in ("deg", "rad"):
        raise ValueError("units are deg or rad")


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres along the WGS84 geodesic between points in degrees; nan where an input is.

    Vincenty's iteration on longitude does not settle near antipodes; those are solved by azimuth.
    """
    b = A * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    apart = lam = np.radians(np.asarray(lon2, float) - lon1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            ss = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
            cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * np.sin(lam) / np.where(ss == 0, 1, ss))
            c2a = 1 - sa**2
            c2m = np.where(c2a == 0, 0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1, c2a))
            c = FLATTENING / 16 * c2a * (4 + FLATTENING * (4 - 3 * c2a))
            new = apart + (1 - c) * FLATTENING * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(settled):
                break
        u = c2a * (A**2 - b**2) / b**2
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    out = np.where(settled, b * big_a * (sigma - d), np.nan)
    apart, u1, u2 = np.broadcast_arrays(apart, u1, u2)
    left = ~settled & np.isfinite(apart + u1 + u2)
    if left.any():
        out = np.array(out)
        out[left] = _by_azimuth(np.abs(np.remainder(apart[left] + np.pi, 2 * np.pi) - np.pi), u1[left], u2[left])
    return out


def _by_azimuth(apart: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """vincenty for reduced latitudes and a difference of longitudes in 0..pi, by halving the range of the first azimuth.

    The points are turned so that the first lies south of the equator and farthest from it; the longitude at which a
    geodesic reaches the other's latitude then rises with its azimuth from 0 to pi.
    """
    swap = np.abs(u2) > np.abs(u1)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    turn = np.where(u1 > 0, -1.0, 1.0)
    u1, u2 = np.minimum(turn * u1, -1e-200), turn * u2
    (su1, cu1), (su2, cu2) = ((np.sin(u), np.cos(u)) for u in (u1, u2))
    b, low, high = A * (1 - FLATTENING), np.zeros_like(u1), np.full_like(u1, np.pi)
    for _ in range(80):
        azimuth = (low + high) / 2
        s1, c1 = np.sin(azimuth), np.cos(azimuth)
        s0 = s1 * cu1
        c0 = np.sqrt(np.maximum(1 - s0 * s0, 0))
        c2 = np.sqrt(np.maximum(c1 * c1 * cu1 * cu1 + (cu2 * cu2 - cu1 * cu1), 0))  # cosine of the azimuth there, times cu2
        from_, to = np.arctan2(su1, c1 * cu1), np.arctan2(su2, c2)
        arc = to - from_
        twice_middle = np.cos(from_ + to)
        c = FLATTENING / 16 * c0 * c0 * (4 + FLATTENING * (4 - 3 * c0 * c0))
        ss, cs = np.sin(arc), np.cos(arc)
        sphere = np.arctan2(s0 * np.sin(to), np.cos(to)) - np.arctan2(s0 * np.sin(from_), np.cos(from_))
        there = sphere - (1 - c) * FLATTENING * s0 * (arc + c * ss * (twice_middle + c * cs * (2 * twice_middle**2 - 1)))
        low, high = np.where(there < apart, azimuth, low), np.where(there < apart, high, azimuth)
    u = c0 * c0 * (A**2 - b**2) / b**2
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = big_b * ss * (twice_middle + big_b / 4 * (cs * (2 * twice_middle**2 - 1) - big_b / 6 * twice_middle * (4 * ss**2 - 3) * (4 * twice_middle**2 - 3)))
    return b * big_a * (arc - d)


def _geodesic(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    found = vincenty(*(x.to_numpy(float, na_value=np.nan) for x in (lon1, lat1, lon2, lat2)))
    return pd.Series(found).where(~np.isnan(found), None)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """vincenty, as a column; null where any input is."""
    return F.pandas_udf(_geodesic, "double")(lon1, lat1, lon2, lat2)


def _distance(a: Coordinate, b: Coordinate) -> float:
    h = math.sin(math.radians(b.latitude - a.latitude) / 2) ** 2 + math.cos(math.radians(a.latitude)) * math.cos(math.radians(b.latitude)) * math.sin(math.radians(b.longitude - a.longitude) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(h))


def midpoint(a: Coordinate, b: Coordinate) -> Coordinate:
    """Of the coordinates, not of the great circle."""
    return Coordinate((a.latitude + b.latitude) / 2, (a.longitude + b.longitude) / 2)


def waypoint_count(a: Coordinate, b: Coordinate, cell_metres: float, factor: float = 1.0) -> int:
    return max(1, math.ceil(_distance(a, b) * factor / cell_metres)) + 1


def waypoints(spark: SparkSession, a: Coordinate, b: Coordinate, points: int) -> DataFrame:
    """(i, latitude, longitude) of evenly spaced points on the great circle, both ends included; on the sphere."""
    if points < 2:
        raise ValueError("a route has two points at least")
    omega = _distance(a, b) / RADIUS
    xyz = lambda c: (math.cos(math.radians(c.latitude)) * math.cos(math.radians(c.longitude)), math.cos(math.radians(c.latitude)) * math.sin(math.radians(c.longitude)), math.sin(math.radians(c.latitude)))
    t = F.col("i") / float(points - 1)
    s = math.sin(omega) or 1.0
    wa, wb = (F.sin((1 - t) * omega) / s, F.sin(t * omega) / s) if omega else (1 - t, t)
    x, y, z = (wa * p + wb * q for p, q in zip(xyz(a), xyz(b), strict=True))
    return spark.range(points).select(F.col("id").alias("i")).select("i", F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("latitude"), F.degrees(F.atan2(y, x)).alias("longitude"))


def route_waypoints(routes: DataFrame, latitude: str, longitude: str, to_latitude: str, to_longitude: str, points: int) -> DataFrame:
    """routes with i, way_latitude and way_longitude: so many evenly spaced points of each great circle, both ends included.

    waypoints for a table of routes; a route from a place to itself stays there, one with a null end has null points.
    """
    if points < 2:
        raise ValueError("a route has two points at least")
    (a, b), (d, e) = ((F.radians(latitude), F.radians(longitude)), (F.radians(to_latitude), F.radians(to_longitude)))
    omega = haversine(F.col(longitude), F.col(latitude), F.col(to_longitude), F.col(to_latitude)) / RADIUS
    t, s = F.col("i") / float(points - 1), F.sin("_omega")
    wa, wb = (F.when(F.col("_omega") == 0, w).otherwise(F.sin(w * F.col("_omega")) / F.when(F.col("_omega") != 0, s)) for w in (1 - t, t))
    x = wa * F.cos(a) * F.cos(b) + wb * F.cos(d) * F.cos(e)
    y = wa * F.cos(a) * F.sin(b) + wb * F.cos(d) * F.sin(e)
    z = wa * F.sin(a) + wb * F.sin(d)
    each = routes.withColumn("_omega", omega).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return each.withColumns({"way_latitude": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), "way_longitude": F.degrees(F.atan2(y, x))}).drop("_omega")
