"""Geodesy and routes: WGS-84 geodesics as Arrow functions, projections as Columns, route generators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

A, FLAT = 6378137.0, 1 / 298.257223563  # fixed values: WGS-84
B = A * (1 - FLAT)
MAX_LAT = 85.05112878  # fixed value: edge of the square map


def direct(lat, lon, azimuth, distance):
    """Point reached from (lat, lon) along an azimuth, all in degrees and metres, elementwise."""
    p1, l1, az = (np.radians(np.asarray(x, float)) for x in (lat, lon, azimuth))
    s = np.asarray(distance, float)
    tan_u = (1 - FLAT) * np.tan(p1)
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    sin_a, cos_a = np.sin(az), np.cos(az)
    s1 = np.arctan2(tan_u, cos_a)
    alpha = cos_u * sin_a
    c2 = 1 - alpha**2
    k = c2 * (A**2 - B**2) / B**2
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sig = s / (B * big_a)
    for _ in range(100):
        m = np.cos(2 * s1 + sig)
        d = big_b * np.sin(sig) * (m + big_b / 4 * (np.cos(sig) * (2 * m**2 - 1) - big_b / 6 * m * (4 * np.sin(sig) ** 2 - 3) * (4 * m**2 - 3)))
        new = s / (B * big_a) + d
        done = np.max(np.abs(new - sig), initial=0) < 1e-12
        sig = new
        if done:
            break
    m = np.cos(2 * s1 + sig)
    t = sin_u * np.sin(sig) - cos_u * np.cos(sig) * cos_a
    p2 = np.arctan2(sin_u * np.cos(sig) + cos_u * np.sin(sig) * cos_a, (1 - FLAT) * np.sqrt(alpha**2 + t**2))
    lam = np.arctan2(np.sin(sig) * sin_a, cos_u * np.cos(sig) - sin_u * np.sin(sig) * cos_a)
    c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
    dl = lam - (1 - c) * FLAT * alpha * (sig + c * np.sin(sig) * (m + c * np.cos(sig) * (2 * m**2 - 1)))
    out = np.degrees(l1 + dl)
    return np.degrees(p2), (out + 540) % 360 - 180


def inverse(lat1, lon1, lat2, lon2):
    """Distance in metres; the sphere's where the iteration does not settle (nearly opposite points)."""
    p1, p2 = np.radians(np.asarray(lat1, float)), np.radians(np.asarray(lat2, float))
    dl = np.radians((np.asarray(lon2, float) - np.asarray(lon1, float) + 540) % 360 - 180)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(p1)), np.arctan((1 - FLAT) * np.tan(p2))
    lam, ok = dl.copy(), np.zeros(np.shape(dl), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sig = np.arctan2(sin_s, cos_s)
            alpha = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
            c2 = 1 - alpha**2
            m = np.where(c2 == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(c2 == 0, 1, c2))
            c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
            new = dl + (1 - c) * FLAT * alpha * (sig + c * sin_s * (m + c * cos_s * (2 * m**2 - 1)))
            ok = np.abs(new - lam) < 1e-12
            lam = new
            if ok.all():
                break
        k = c2 * (A**2 - B**2) / B**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        d = big_b * sin_s * (m + big_b / 4 * (cos_s * (2 * m**2 - 1) - big_b / 6 * m * (4 * sin_s**2 - 3) * (4 * m**2 - 3)))
        out = B * big_a * (sig - d)
    r = (2 * A + B) / 3
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    return np.where(ok & np.isfinite(out), out, 2 * r * np.arcsin(np.sqrt(np.minimum(h, 1))))


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def direct_udf(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
    p, q = direct(lat, lon, azimuth, distance)
    return pd.DataFrame({"lat": p, "lon": q})


@F.pandas_udf(T.DoubleType())
def inverse_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(inverse(lat1, lon1, lat2, lon2))


def normalize_lon(lon: Column) -> Column:
    """To -180..180; both ends stay as they are."""
    return F.when((lon >= -180) & (lon <= 180), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def mercator_y(lat: Column) -> Column:
    p = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return 0.5 - F.log(F.tan(p) + 1.0 / F.cos(p)) / (2.0 * math.pi)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y))))


def altitude_factor(lat: Column) -> Column:
    """How high a route flies at a latitude: 4 - 3 |sin|^0.4."""
    return 4.0 - 3.0 * F.pow(F.abs(F.sin(F.radians(lat))), F.lit(0.4))


def extra_width(lat: Column) -> Column:
    return 1.0 - F.sqrt(F.abs(F.sin(F.radians(lat))))


def altitude_ladder(target: float, top: float = 16_000_000.0, levels: int = 16) -> list[float]:
    """Altitudes from ``top``, halved while that comes closer to twice the target."""
    out = [top]
    while len(out) < levels and abs(out[-1] / 2 - 2 * target) < abs(out[-1] - 2 * target):
        out.append(out[-1] / 2)
    return out


def spiral(lat: float, lon: float, step: float, total: float) -> list[tuple[float, float]]:
    """Square spiral with legs 1, 1, 2, 2, 3, 3 ... steps; the last leg is trimmed to the total length."""
    pts, left, leg, heading = [(lat, lon)], total, 0, 0.0
    while left > 1e-9:
        n = min((leg // 2 + 1) * step, left)
        p, q = direct(*pts[-1], heading, n)
        pts.append((float(p), float(q)))
        left -= n
        leg += 1
        heading = (heading + 90.0) % 360.0
    return pts


def zigzag(lat: float, lon: float, length: float, spacing: float, cycles: int) -> list[tuple[float, float]]:
    """East and west strokes of ``length``, each followed by ``spacing`` to the north."""
    pts = [(lat, lon)]
    for k in range(2 * cycles):
        for heading, dist in ((90.0 if k % 2 == 0 else 270.0, length), (0.0, spacing)):
            p, q = direct(*pts[-1], heading, dist)
            pts.append((float(p), float(q)))
    return pts


def rectangle_zigzag(south: float, west: float, north: float, east: float, step: float) -> list[tuple[float, float]]:
    """Rows across a rectangle, alternating; the last row is snapped to the top."""
    rows = [south + k * step for k in range(int((north - south) // step) + 1)]
    if rows[-1] < north:
        rows.append(north)
    return [p for k, r in enumerate(rows) for p in (((r, west), (r, east)) if k % 2 == 0 else ((r, east), (r, west)))]


def globe_serpentine(rows: int, cols: int) -> list[tuple[float, float]]:
    """A serpentine over the map's rows; rows near the equator reach further beyond the seam."""
    out = []
    for r in range(rows):
        y = (r + 0.5) / rows
        lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y))))
        margin = 1 - math.sqrt(abs(math.sin(math.radians(lat))))
        lons = [-180 - margin + (360 + 2 * margin) * c / (cols - 1) for c in range(cols)]
        out += [(lat, (x + 540) % 360 - 180) for x in (lons if r % 2 == 0 else reversed(lons))]
    return out
