"""Aggregation of photons into along-track segments by declarative recipes: one grouped pass for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.functions.aggregates import OBSERVED, Recipe
from topolidar.functions.rules import bin_key

# The metrics of a photon table and of an airborne-lidar table.
_GROUND, _CANOPY, _CLASS = (1, 2), (2, 3), "combined_class"
PHOTON_RECIPES = [
    Recipe("longitude", "median", _CLASS, (0, 1, 2, 3, 40, 41), "longitude"),
    Recipe("latitude", "median", _CLASS, (0, 1, 2, 3, 40, 41), "latitude"),
    Recipe("h_ph", "median", _CLASS, 1, "h_te_median"),
    Recipe("h_norm", "get_max98", _CLASS, _CANOPY, "h_canopy"),
    Recipe("h_norm", "percentile_rh", _CLASS, _CANOPY, "canopy_rh"),
    Recipe("h_ph", "median", _CLASS, 40, "h_bathy"),
    Recipe("h_ph", "median", _CLASS, 41, "h_surface"),
    Recipe("h_ph", "get_len", _CLASS, 1, "n_terrain"),
    Recipe("h_ph", "get_len", _CLASS, 2, "n_canopy"),
    Recipe("h_ph", "get_len", _CLASS, 3, "n_toc"),
    Recipe("h_ph", "get_len", _CLASS, 40, "n_bathy"),
    Recipe("h_ph", "get_len", _CLASS, 41, "n_surface"),
    Recipe("delta_time", "get_len_unique", _CLASS, (0, 1, 2, 3, 40, 41), "n_shots"),
]
LIDAR_RECIPES = [
    Recipe("ortho_h", "median", "classification", 2, "als_h_te_median"),
    Recipe("h_norm", "get_max98", "classification", (3, 4, 5), "als_h_canopy"),
    Recipe("ortho_h", "median", "classification", 40, "als_h_bathy"),
    Recipe("ortho_h", "get_len", "classification", 2, "als_n_ground"),
    Recipe("ortho_h", "get_len", "classification", (3, 4, 5), "als_n_canopy"),
    Recipe("ortho_h", "get_len", "classification", 40, "als_n_bathy"),
]


def with_start(df: DataFrame, position: str, by: Sequence[str], out: str = "_start") -> DataFrame:
    """``df`` with the least position of each track: a small grouped table joined back, as a window would sort each track in
    one task."""
    least = df.groupBy(*by).agg(F.min(position).alias(out))
    return df.join(least, list(by)) if by else df.crossJoin(F.broadcast(least))


def aggregate_by_segment(df: DataFrame, recipes: Sequence[Recipe], res: float = 20.0, by: Sequence[str] = (), position: str = "alongtrack", start: Column | float | None = None, order: str | None = None, compat: str = OBSERVED) -> DataFrame:
    """A row for each segment of ``res`` along each track of ``by`` that has any row: key_id, its centre as ``position`` and
    a column for each recipe. Recipes of absent fields are skipped; with a longitude among the outputs, segments without a
    location go. ``start`` is where segments are counted from, else each track's own least position."""
    wanted = [r for r in recipes if r.field in df.columns]
    if start is None:
        df = with_start(df, position, by)
        start = F.col("_start")
    else:
        df = df.withColumn("_start", start if isinstance(start, Column) else F.lit(float(start)))
    keyed = df.withColumn("key_id", bin_key(F.col(position), F.col("_start"), res))
    made = keyed.groupBy(*by, "key_id").agg(F.min("_start").alias("_start"), *(r.column(order, compat) for r in wanted))
    out = made.select(*by, "key_id", (F.col("key_id") * res + F.col("_start") + res / 2).alias(position), *(r.name for r in wanted))
    return out.where("longitude is not null and latitude is not null") if {"longitude", "latitude"} <= {r.name for r in wanted} else out


def join_segments(left: DataFrame, right: DataFrame, by: Sequence[str] = (), position: str = "alongtrack") -> DataFrame:
    """Segments of two sensors by key, all of the left ones; both positions stay, as ``position``_x and _y."""
    right = right.withColumnRenamed(position, f"{position}_y")
    return left.withColumnRenamed(position, f"{position}_x").join(right, [*by, "key_id"], "left")
