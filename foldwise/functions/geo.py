"""Coordinate pairs and distances on the earth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# fixed values: WGS-84 ellipsoid and the mean earth radius, in metres
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
MEAN_RADIUS = 6371008.8


def split_pair(text: Column) -> tuple[Column, Column]:
    """``"lng,lat"`` to two doubles; null where there is no number."""
    parts = F.split(text, ",")
    return F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres on the mean sphere, JVM side."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * MEAN_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ellipsoid_metres(lat1, lng1, lat2, lng2) -> np.ndarray:
    """Vincenty's inverse formula on arrays.

    Pairs within about half a degree of antipodal do not converge; they get the
    haversine distance (relative error below 0.6 %).
    """
    lat1, lng1, lat2, lng2 = (np.asarray(a, dtype=float) for a in (lat1, lng1, lat2, lng2))
    b = WGS84_A * (1 - WGS84_F)
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = np.radians(lng2 - lng1)
    span = (span + np.pi) % (2 * np.pi) - np.pi
    lam = span.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            x = cu2 * np.sin(lam)
            y = cu1 * su2 - su1 * cu2 * np.cos(lam)
            sin_s = np.hypot(x, y)
            cos_s = su1 * su2 + cu1 * cu2 * np.cos(lam)
            arc = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, cu1 * cu2 * np.sin(lam) / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 0, cos_s - 2 * su1 * su2 / cos2_a, 0.0)
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            bend = arc + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1))
            new = span + (1 - c) * WGS84_F * sin_a * bend
            moved = np.abs(new - lam)
            lam = new
            if not np.any(moved > 1e-12):
                break
    ok = (moved <= 1e-9) & (np.abs(lam) <= np.pi)
    u_sq = cos2_a * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    inner = cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)
    metres = b * big_a * (arc - big_b * sin_s * (mid + big_b / 4 * inner))
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2
    h = h + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(span / 2) ** 2
    sphere = 2 * MEAN_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    missing = np.isnan(lat1) | np.isnan(lat2) | np.isnan(lng1) | np.isnan(lng2)
    return np.where(missing, np.nan, np.where(ok, metres, sphere))


@F.pandas_udf(T.DoubleType())
def _geodesic(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    return pd.Series(ellipsoid_metres(lat1, lng1, lat2, lng2))


def geodesic_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Geodesic metres on the WGS-84 ellipsoid (Arrow batches)."""
    return _geodesic(lat1, lng1, lat2, lng2)
