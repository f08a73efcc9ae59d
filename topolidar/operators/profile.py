"""Profiles for plots: the rows of a figure as (panel, series, x, y). Rendering is left to whoever draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of classes, of photons and of airborne lidar.
PHOTON_SERIES = {"unclassified": (0,), "ground": (1,), "canopy": (2,), "top of canopy": (3,), "bathymetry": (40,), "water surface": (41,)}
LIDAR_SERIES = {"unclassified": (1,), "ground": (2,), "vegetation": (3, 4, 5), "building": (6,), "noise": (7,), "bathymetry": (40,), "water surface": (41,), "water column": (45,)}
CONTESTED_SERIES = {"none": (0,), "land only": (1,), "sea only": (2,), "both": (3,)}
MERGED_SERIES = {"water": (41, 45), "vegetation": (1, 3, 4, 5), "bottom": (2, 40)}

# The panels of each figure, as (table, x, y, class column, series).
_PH, _ALS = "photons", "als"
_A = lambda y, c, s=PHOTON_SERIES: (_PH, "alongtrack", y, c, s)
_B = lambda y, x="alongtrack", s=LIDAR_SERIES: (_ALS, x, y, "classification", s)
_LAND, _SEA, _BOTH = _A("h_ph", "atl08_class"), _A("h_ph", "atl24_class"), _A("h_ph", "contested_class", CONTESTED_SERIES)
FIGURES = {
    "alongtrack": [[_A("h_ph", "combined_class")]],
    "alongtrack_atl08": [[_LAND]],
    "alongtrack_atl24": [[_SEA]],
    "alongtrack_atl08_atl24": [[_LAND], [_SEA]],
    "alongtrack_contested_classes": [[_BOTH]],
    "alongtrack_atl08_atl24_contested": [[_LAND], [_SEA], [_BOTH]],
    "alongtrack_atl08_atl24_contested2": [[_LAND], [_SEA], [_BOTH]],
    "alongtrack_als": [[_B("ortho_h")]],
    "alongtrack_atl08_als": [[_LAND]],
    "alongtrack_atl_als": [[_A("ortho_h", "combined_class"), _B("ortho_h")]],
    "alongtrack_atl_als2": [[_A("ortho_h", "combined_class"), _B("ellip_h")]],
    "alongtrack_atl_als3": [[_LAND, _B("ellip_h", s=MERGED_SERIES)]],
    "alongtrack_atl_als_dual": [[_A("ortho_h", "combined_class")], [_B("ellip_h")]],
    "alongtrack_atl08_als_dual": [[_LAND], [_B("ellip_h")]],
    "alongtrack_atl_als_tri": [[_A("ortho_h", "combined_class")], [_B("ellip_h")], [_A("ortho_h", "combined_class"), _B("ortho_h")]],
    "y_als": [[_B("ortho_h", "y")]],
    "secondary_axis": [[_B("ortho_h", "latitude")]],
    "secondary_axis2": [[_B("ortho_h", "longitude")]],
    "alongtrack_atl_als_versions": [[_A("h_norm", "combined_class")], [_A("h_te_norm", "combined_class")], [_B("h_norm")], [_B("h_toposurf_norm")]],
    "alongtrack_atl_als_versions2": [[_A("h_norm", "combined_class")], [_B("h_topobathy_norm")]],
}


def profile(df: DataFrame, x: str, y: str, cls: str, series: dict[str, Sequence[int]], panel: int = 0, thin: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, panel, series, x, y) of the rows in a series; with ``thin``, an index, every second unclassified row only."""
    name = F.coalesce(*(F.when(F.col(cls).isin(*ids), F.lit(k)) for k, ids in series.items()))
    out = df.select(*by, F.lit(panel).alias("panel"), name.alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *([F.col(thin).alias("_thin")] if thin else []))
    out = out.where("series is not null")
    return out.where("series <> 'unclassified' or _thin % 2 = 0").drop("_thin") if thin else out


def figure(name: str, tables: dict[str, DataFrame], thin: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All panels of a named figure; a panel whose table or columns are absent has no rows."""
    parts = []
    for i, layers in enumerate(FIGURES[name]):
        for table, x, y, cls, series in layers:
            df = tables.get(table)
            if df is not None and {x, y, cls} <= set(df.columns):
                parts.append(profile(df, x, y, cls, series, i, thin if thin in df.columns else None, by))
    if not parts:
        raise ValueError(f"no panel of {name} can be made from these tables")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
