"""Geodesy as Column expressions: great circles, UTM, datum shifts; only Vincenty's iteration is vectorised Python."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6_371_000.0
#: WGS84: semi-major axis and flattening.
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
#: GRS80, of NAD83.
A_NAD, FLATTENING_NAD = 6_378_137.0, 1 / 298.257222101
#: The seven parameters NAD83 to WGS84, metres, arc seconds and parts per billion.
HELMERT = {"tx": -0.9956, "ty": 1.9013, "tz": 0.5215, "rx": 0.025915, "ry": 0.009426, "rz": 0.011599, "s": 0.62}
BANDS = "CDEFGHIJKLMNOPQRSTUVWX"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def vincenty_metres(lat1, lon1, lat2, lon2, tolerance: float = 1e-12, rounds: int = 200) -> np.ndarray:
    """Geodesic lengths on WGS84: 0 for equal points, NaN where the iteration doesn't settle."""
    p1, l1, p2, l2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    b = (1 - FLATTENING) * A
    u1, u2 = np.arctan((1 - FLATTENING) * np.tan(p1)), np.arctan((1 - FLATTENING) * np.tan(p2))
    apart, lam, open_ = l2 - l1, l2 - l1, np.ones(len(p1), bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            cross = np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), cross)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            new = apart + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            step, lam = np.abs(new - lam), np.where(open_, new, lam)
            open_ = open_ & ~(step < tolerance)
            if not open_.any():
                break
        u = cos2_a * (A**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        shift = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        length = b * big * (sigma - shift)
    return np.where((p1 == p2) & (l1 == l2), 0.0, np.where(open_, np.nan, length))


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(vincenty_metres(a, b, c, d))

    return F.when(lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull(), run(lat1, lon1, lat2, lon2))


def utm_zone(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(number, letter). Southern Norway has zone 32; letters run on from C without gaps, X from 84 degrees, C below -80."""
    number = F.when(lat.between(56, 63.9999999999) & (lon >= 3) & (lon < 12), 32).otherwise(((lon + 180) / 6).cast("int") + 1)
    at = F.floor((lat + 80) / 8).cast("int")
    letter = F.when(lat >= 84, "X").when(lat < -80, "C").otherwise(F.substring(F.lit(BANDS), at + 1, F.lit(1)))
    return number.cast("int"), letter


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone, or of the polar systems beyond 84 and -80 degrees."""
    number, _ = utm_zone(lat, lon)
    return F.when(lat >= 84, 32661).when(lat < -80, 32761).when(lat > 0, 32600 + number).otherwise(32700 + number).cast("int")


def _krueger() -> tuple[float, list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, alpha, beta


def utm_project(lat: Column, lon: Column, zone: Column | int, south: Column | bool = False) -> tuple[Column, Column]:
    """(easting, northing) on WGS84 by Krueger's series, good to a millimetre within a zone."""
    radius, alpha, _ = _krueger()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - ((F.lit(zone) if isinstance(zone, int) else zone) * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(0.5 * F.log((1 + s) / (1 - s)) - e * 0.5 * F.log((1 + e * s) / (1 - e * s)))
    xi, ups = F.atan2(t, F.cos(lam)), F.sin(lam) / F.sqrt(1 + t * t)
    eta = 0.5 * F.log((1 + ups) / (1 - ups))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    false_y = F.when(F.lit(south) if isinstance(south, bool) else south, 1e7).otherwise(0.0)
    return 500_000 + 0.9996 * radius * x, false_y + 0.9996 * radius * y


@lru_cache
def _inverse_series(terms: int = 5, steps: int = 64) -> tuple[float, ...]:
    """The sine series that undoes utm_project's to the last digits of a double, where the usual one stays 50 micrometres off:
    Fourier sums over what fixed-point rounds find."""
    alpha, found = _krueger()[1], []
    for xi in (math.pi * (k + 0.5) / steps for k in range(steps)):
        v = xi
        for _ in range(20):
            v = xi - sum(a * math.sin(2 * j * v) for j, a in enumerate(alpha, 1))
        found.append((xi, xi - v))
    return tuple(2 / steps * sum(d * math.sin(2 * j * xi) for xi, d in found) for j in range(1, terms + 1))


def utm_unproject(x: Column, y: Column, zone: Column | int, south: Column | bool = False, exact: bool = False) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees from UTM, to a tenth of a millimetre; with ``exact`` to some nanometres of what
    utm_project takes there."""
    radius, _, beta = _krueger()
    rounds = 4
    if exact:
        beta, rounds = _inverse_series(), 7
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    xi = (y - F.when(F.lit(south) if isinstance(south, bool) else south, 1e7).otherwise(0.0)) / (0.9996 * radius)
    eta = (x - 500_000) / (0.9996 * radius)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    q = F.asinh(F.sin(xi1) / F.sqrt(F.pow(F.sinh(eta1), F.lit(2)) + F.pow(F.cos(xi1), F.lit(2))))
    phi = F.atan(F.sinh(q))
    for _ in range(rounds):
        phi = F.atan(F.sinh(q + e * F.atanh(e * F.sin(phi))))
    central = (F.lit(zone) if isinstance(zone, int) else zone) * 6 - 183
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + central


def helmert(df: DataFrame, lon: str, lat: str, height: str, inverse: bool = False, rounds: int = 5) -> DataFrame:
    """``df`` with lon_out, lat_out and h_out: NAD83 to WGS84, or back with negated parameters (not the exact inverse). The
    angles of the rotation are the parameters over 3600, in degrees; latitude comes from fixed-point rounds."""
    sign = -1.0 if inverse else 1.0
    p = {k: sign * v for k, v in HELMERT.items()}
    (a1, f1), (a2, f2) = ((A, FLATTENING), (A_NAD, FLATTENING_NAD)) if inverse else ((A_NAD, FLATTENING_NAD), (A, FLATTENING))
    e1, e2 = f1 * (2 - f1), f2 * (2 - f2)
    rx, ry, rz = (math.radians(p[k] / 3600) for k in ("rx", "ry", "rz"))
    m = 1 + p["s"] * 1e-9
    df = df.withColumn("_p", F.radians(lat)).withColumn("_l", F.radians(lon)).withColumn("_n", a1 / F.sqrt(1 - e1 * F.pow(F.sin("_p"), F.lit(2))))
    df = df.withColumns({"_x": (F.col("_n") + F.col(height)) * F.cos("_p") * F.cos("_l"), "_y": (F.col("_n") + F.col(height)) * F.cos("_p") * F.sin("_l"), "_z": (F.col("_n") * (1 - e1) + F.col(height)) * F.sin("_p")})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    df = df.withColumns({"_u": p["tx"] + m * (x - rz * y + ry * z), "_v": p["ty"] + m * (rz * x + y - rx * z), "_w": p["tz"] + m * (rx * y - ry * x + z)})
    df = df.withColumn("_r", F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))).withColumn("_f", F.atan2(F.col("_w"), F.col("_r") * (1 - e2)))
    for _ in range(rounds):
        n = a2 / F.sqrt(1 - e2 * F.pow(F.sin("_f"), F.lit(2)))
        df = df.withColumn("_f", F.atan2(F.col("_w") + e2 * n * F.sin("_f"), F.col("_r")))
    n = a2 / F.sqrt(1 - e2 * F.pow(F.sin("_f"), F.lit(2)))
    out = df.withColumns({"lon_out": F.degrees(F.atan2("_v", "_u")), "lat_out": F.degrees("_f"), "h_out": F.col("_r") / F.cos("_f") - n})
    return out.drop("_p", "_l", "_n", "_x", "_y", "_z", "_u", "_v", "_w", "_r", "_f")


def geoid_cell(lon: Column, lat: Column, origin: tuple[float, float], step: tuple[float, float], right: float) -> tuple[Column, Column]:
    """(row, column) of the raster cell of a point; ``step`` is (dx, dy), dy negative in a raster from the north. Longitudes
    are from 0 to 360 where the raster goes beyond 185 degrees."""
    lon = F.when(lon < 0, lon + 360).otherwise(lon) if right > 185 else lon
    return F.floor((lat - origin[1]) / step[1]).cast("int"), F.floor((lon - origin[0]) / step[0]).cast("int")


def geoid_height(df: DataFrame, grid: DataFrame, lon: str, lat: str, origin: tuple[float, float], step: tuple[float, float], right: float, out: str = "geoid") -> DataFrame:
    """``df`` with the geoid's height at its nearest cell (``grid``: row, col, value); NULL outside."""
    row, col = geoid_cell(F.col(lon), F.col(lat), origin, step, right)
    cells = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias(out))
    return df.withColumn("_row", row).withColumn("_col", col).join(cells, ["_row", "_col"], "left").drop("_row", "_col")
