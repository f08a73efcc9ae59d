"""Coordinate systems by their parameters: degrees, UTM, Web Mercator and Lambert conic ones, and the chain between two."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.functions import geo

US_FOOT = 1200 / 3937


@dataclass(frozen=True)
class Crs:
    """``kind``: degrees, utm, mercator or lambert. ``unit`` is in metres, and so are the false origins. NAD83 systems differ
    from WGS84 ones by the datum shift of geo.helmert."""

    kind: str
    nad83: bool = False
    zone: int = 0
    south: bool = False
    parallels: tuple[float, float] = (0.0, 0.0)
    origin: tuple[float, float] = (0.0, 0.0)  # longitude, latitude
    false: tuple[float, float] = (0.0, 0.0)
    unit: float = 1.0


# Conic state systems in US feet, as code: (parallels, origin, false easting and northing in metres).
_CONIC = {
    6543: ((34 + 20 / 60, 36 + 10 / 60), (-79.0, 33.75), (609601.2192, 0.0)),
    8714: ((40.0, 41 + 40 / 60), (-122.0, 39 + 20 / 60), (2000000.0, 500000.0)),
    8715: ((38 + 20 / 60, 39 + 50 / 60), (-122.0, 37 + 40 / 60), (2000000.0, 500000.0)),
    8716: ((37 + 4 / 60, 38 + 26 / 60), (-120.5, 36.5), (2000000.0, 500000.0)),
    8717: ((36.0, 37.25), (-119.0, 35 + 20 / 60), (2000000.0, 500000.0)),
    8718: ((34 + 2 / 60, 35 + 28 / 60), (-118.0, 33.5), (2000000.0, 500000.0)),
    8719: ((32 + 47 / 60, 33 + 53 / 60), (-116.25, 32 + 10 / 60), (2000000.0, 500000.0)),
}


def parse_crs(code: str) -> Crs:
    """The system of an EPSG code: 4326, 4269, 3857, UTM on WGS84 (326zz, 327zz) or NAD83 (269zz), and the conic state systems
    above. Others raise; they can be given by their parameters."""
    n = int(code.upper().removeprefix("EPSG:"))
    if n in (4326, 4269):
        return Crs("degrees", nad83=n == 4269)
    if n == 3857:
        return Crs("mercator")
    if n // 100 in (326, 327) and 1 <= n % 100 <= 60:
        return Crs("utm", zone=n % 100, south=n // 100 == 327)
    if n // 100 == 269 and 1 <= n % 100 <= 23:
        return Crs("utm", nad83=True, zone=n % 100)
    if n in _CONIC:
        parallels, origin, false = _CONIC[n]
        return Crs("lambert", True, parallels=parallels, origin=origin, false=false, unit=US_FOOT)
    raise ValueError(f"unknown coordinate system {code}")


def _lambert(crs: Crs) -> tuple[float, float, float, float]:
    """(eccentricity, cone, scale, radius of the origin) of a conic system on GRS80."""
    e = math.sqrt(geo.FLATTENING_NAD * (2 - geo.FLATTENING_NAD))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    a, b = (math.radians(p) for p in crs.parallels)
    n = math.sin(a) if a == b else (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
    scale = geo.A_NAD * m(a) / (n * t(a) ** n)
    return e, n, scale, scale * t(math.radians(crs.origin[1])) ** n


def around(lon: Column) -> Column:
    """Degrees brought to -180 to 180 by whole turns; what is over by rounding only (1e-9) stays, and changes no side."""
    return F.when(F.abs(lon) <= 180 + 1e-9, lon).otherwise(lon - 360 * F.floor((lon + 180) / 360))


def project(crs: Crs, lon: Column, lat: Column, over: bool = False) -> tuple[Column, Column]:
    """(x, y) in the system's unit from degrees on its own datum. A conic system is cut opposite of its origin: longitudes are
    taken the shorter way from there. With ``over`` they are taken as they are, also beyond the cut, where others lie too."""
    if crs.kind == "degrees":
        return lon, lat
    if crs.kind == "utm":
        x, y = geo.utm_project(lat, lon, crs.zone, crs.south)
    elif crs.kind == "mercator":
        x, y = geo.A * F.radians(lon), geo.A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    else:
        e, n, scale, top = _lambert(crs)
        s = F.sin(F.radians(lat))
        t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
        turn = lon - crs.origin[0]
        rho, theta = scale * F.pow(t, F.lit(n)), n * F.radians(turn if over else around(turn))
        x, y = crs.false[0] + rho * F.sin(theta), crs.false[1] + top - rho * F.cos(theta)
    return x / crs.unit, y / crs.unit


def unproject(crs: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees on the system's own datum; longitudes are from -180 to 180."""
    if crs.kind == "degrees":
        return x, y
    x, y = x * crs.unit, y * crs.unit
    if crs.kind == "utm":
        lat, lon = geo.utm_unproject(x, y, crs.zone, crs.south, exact=True)
        return around(lon), lat
    if crs.kind == "mercator":
        return around(F.degrees(x / geo.A)), F.degrees(2 * F.atan(F.exp(y / geo.A)) - math.pi / 2)
    e, n, scale, top = _lambert(crs)
    dx, dy = x - crs.false[0], top - (y - crs.false[1])
    t = F.pow(F.sqrt(dx * dx + dy * dy) / abs(scale), F.lit(1 / n))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6):
        s = F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2)))
    return around(crs.origin[0] + F.degrees(F.atan2(dx, dy) / n)), F.degrees(phi)


def reproject(df: DataFrame, source: Crs | str, target: Crs | str, x: str = "x", y: str = "y", z: str | None = None, z_unit: float = 1.0, source_geoid: tuple | None = None, target_geoid: tuple | None = None) -> DataFrame:
    """``df`` with x, y and, if given, z in the target system. z goes from its unit to metres and from the source's geoid to
    the ellipsoid, through the datum shift if the datums differ, and to the target's geoid; geoids are (grid, origin, step,
    right side) as of read_gtx. Without z the height is taken as 0. A point outside a geoid's grid has a NULL z."""
    source, target = (parse_crs(c) if isinstance(c, str) else c for c in (source, target))
    lon, lat = unproject(source, F.col(x), F.col(y))
    out = df.withColumns({"_lon": lon, "_lat": lat, "_h": F.col(z) * z_unit if z else F.lit(0.0)})
    if source_geoid is not None and z:
        out = geo.geoid_height(out, source_geoid[0], "_lon", "_lat", *source_geoid[1:], out="_geoid").withColumn("_h", F.col("_h") + F.col("_geoid")).drop("_geoid")
    if source.nad83 != target.nad83:
        height = F.col("_h")
        out = geo.helmert(out.withColumn("_hs", F.coalesce("_h", F.lit(0.0))), "_lon", "_lat", "_hs", inverse=target.nad83)
        out = out.withColumn("_h", F.when(height.isNotNull(), F.col("h_out"))).drop("_lon", "_lat", "_hs", "h_out").withColumnsRenamed({"lon_out": "_lon", "lat_out": "_lat"})
    if target_geoid is not None and z:
        out = geo.geoid_height(out, target_geoid[0], "_lon", "_lat", *target_geoid[1:], out="_geoid").withColumn("_h", F.col("_h") - F.col("_geoid")).drop("_geoid")
    new = project(target, F.col("_lon"), F.col("_lat"))
    # Both at once, as each is made from the old ones.
    return out.withColumns({x: new[0], y: new[1], **({z: F.col("_h")} if z else {})}).drop("_lon", "_lat", "_h")
