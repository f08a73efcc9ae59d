"""Building edges: the roof's cluster, lines through its outermost points, checks of what lies around, edge spread."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.functions.rules import right_closed_bin
from topolidar.operators import clusters

ROOF = 6


def robust_line(x: np.ndarray, y: np.ndarray, residual: float = 1.5) -> tuple[float, float, np.ndarray] | None:
    """(slope, intercept, inliers): of the lines through two points the one with most inliers, then the least residuals,
    fitted again to its inliers. All pairs are tried, as there are few points, so the result is always the same."""
    best = None
    for i, j in combinations(range(len(x)), 2):
        if x[i] == x[j]:
            continue
        m = (y[j] - y[i]) / (x[j] - x[i])
        off = np.abs(y - (m * x + y[i] - m * x[i]))
        inliers = off <= residual
        rank = (-inliers.sum(), off[inliers].sum())
        if best is None or rank < best[0]:
            best = rank, inliers
    if best is None:
        return None
    inliers = best[1]
    design = np.column_stack((x[inliers], np.ones(inliers.sum())))
    (m, b), *_ = np.linalg.lstsq(design, y[inliers], rcond=None)
    return float(m), float(b), inliers


def is_valid_wall(x: np.ndarray, y: np.ndarray, line: tuple[float, float, np.ndarray], least: float = 0.7, bend: float = 1.5) -> bool:
    """Enough inliers, and the residuals' middle third no further than ``bend`` from the mean of the outer two."""
    slope, intercept, inliers = line
    if not len(x) or inliers.mean() < least:
        return False
    parts = np.array_split((y - (slope * x + intercept))[np.argsort(x, kind="stable")], 3)
    if any(len(p) == 0 for p in parts):
        return True
    left, middle, right = (p.mean() for p in parts)
    return bool(abs(middle - (left + right) / 2) <= bend)


_EDGE = "slope double, intercept double, valid boolean, reason string"
EDGE_SCHEMA = f"entry struct<{_EDGE}>, exit struct<{_EDGE}>"


def roof_ends(roof: pd.DataFrame, reach: float) -> list[np.ndarray]:
    """For each bin of one metre across, the least across and the least along (near wall), and the largest ones (far wall),
    each for itself. ``roof``: x0, x1, y0, y1 of points or of cells that lie in one bin."""
    number = np.clip(np.floor(roof["x0"].to_numpy()) + reach + 1, 0, 2 * reach + 1)
    bins = roof.groupby(number).agg(x0=("x0", "min"), x1=("x1", "max"), y0=("y0", "min"), y1=("y1", "max"))
    return [bins[["x0", "y0"]].to_numpy(), bins[["x1", "y1"]].to_numpy()]


def wall(ends: np.ndarray) -> dict:
    line = robust_line(ends[:, 0], ends[:, 1]) if len(ends) >= 2 else None
    if line is None:
        return {"slope": None, "intercept": None, "valid": False, "reason": "line"}
    ok = is_valid_wall(ends[:, 0], ends[:, 1], line)
    return {"slope": line[0], "intercept": line[1], "valid": ok, "reason": "ok" if ok else "wall"}


def building_edges(points: DataFrame, buildings: DataFrame, by: Sequence[str] = ("building_id",), x: str = "crosstrack", y: str = "alongtrack", cls: str = "classification", reach: int = 6) -> DataFrame:
    """(by, entry, exit): the lines along = slope * across + intercept of the near and far wall of each building, from the
    roof points (class 6) of the cluster nearest to its centre (``buildings``: by, x0, y0). Buildings without roof points or
    a cluster have NULL edges. Clusters come from cells (``clusters.roof_parts``), so a task holds what a building's area
    bounds, however many points lie in it."""
    rows = points.where(F.col(cls) == ROOF).join(buildings.select(*by, F.col("x0").alias("_x0"), F.col("y0").alias("_y0")), list(by))
    d2 = F.pow(F.col(x) - F.col("_x0"), F.lit(2)) + F.pow(F.col(y) - F.col("_y0"), F.lit(2))
    parts = clusters.roof_parts(rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), d2.alias("d2")), by)
    kinds = {f.name: f.dataType.simpleString() for f in buildings.schema.fields}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        chosen = clusters.nearest_cluster(pdf)
        found = [None, None] if chosen is None else [wall(ends) for ends in roof_ends(chosen, reach)]
        return pd.DataFrame([[*key, *found]], columns=[*by, "entry", "exit"])

    edges = parts.groupBy(*by).applyInPandas(fit, ", ".join([*(f"{c} {kinds[c]}" for c in by), EDGE_SCHEMA]))
    return buildings.select(*by).join(edges, list(by), "left")


def checked_edges(found: DataFrame, points: DataFrame, by: Sequence[str] = ("building_id",), x: str = "crosstrack", y: str = "alongtrack") -> DataFrame:
    """(by, direction, slope, intercept, valid, reason, roof_median_h, roof_iqr): the walls of ``building_edges``, one a row;
    those that are straight are held to the conditions around them, of which the first that fails is the reason. ``points``
    have h_norm and classification. Distances are along the track, towards the roof."""
    side = lambda name: F.struct(F.lit(name).alias("direction"), F.col(name).alias("e"))
    walls = found.select(*by, F.explode(F.array(side("entry"), side("exit"))).alias("s")).select(*by, "s.direction", "s.e.*").where("reason is not null")
    ahead = F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))
    around = points.select(*by, x, y, "h_norm", "classification").join(walls.where("valid").select(*by, "direction", "slope", "intercept"), list(by))
    around = around.withColumn("distance", F.when(F.col("direction") == "exit", -ahead).otherwise(ahead)).where(F.abs("distance") <= 8.0)
    checks = local_edge_conditions(around, [*by, "direction"]).select(*by, "direction", F.col("reason").alias("_why"), "roof_median_h", "roof_iqr")
    out = walls.join(checks, [*by, "direction"], "left")
    why = F.when(F.col("valid"), F.coalesce("_why", F.lit("few roof points"))).otherwise(F.col("reason"))
    return out.select(*by, "direction", "slope", "intercept", (why == "ok").alias("valid"), why.alias("reason"), "roof_median_h", "roof_iqr")


def edge_points(df: DataFrame, across: str, along: str, by: Sequence[str], low: float = -6.0, high: float = 6.0, step: float = 1.0) -> DataFrame:
    """The least and largest across and along, each for itself, in bins of across."""
    from topolidar.functions.rules import digitized

    rows = df.withColumn("bin", digitized(F.col(across), low, high, step))
    return rows.groupBy(*by, "bin").agg(F.min(across).alias("entry_xt"), F.min(along).alias("entry_at"), F.max(across).alias("exit_xt"), F.max(along).alias("exit_at"))


def local_edge_conditions(points: DataFrame, by: Sequence[str], distance: str = "distance", height: str = "h_norm", cls: str = "classification", least: int = 10, near: float = 3.0, most_iqr: float = 0.5, clear: tuple[float, float] = (1.0, 8.0), margin: float = 1.0, least_height: float = 3.0) -> DataFrame:
    """(by, n_roof, roof_median_h, roof_iqr, reason): what speaks against an edge, in this order: too few roof points within
    ``near``, an uneven roof, something at roof height in the clear zone before it, a low roof; else ok. ``distance`` is
    from the edge, negative before it."""
    h, d = F.col(height), F.col(distance)
    roof = (F.col(cls) == ROOF) & d.between(0, near)
    q = F.percentile(F.when(roof, h), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = points.groupBy(*by).agg(F.count(F.when(roof, 1)).alias("n_roof"), q.alias("_q"))
    zone = points.where((-d).between(*clear)).join(stats.select(*by, "_q"), list(by))
    blocked = zone.groupBy(*by).agg(F.count(F.when((h > F.col("_q")[0] - margin) & (h < F.col("_q")[2] + margin), 1)).alias("_blocked"))
    out = stats.join(blocked, list(by), "left").withColumn("roof_median_h", F.col("_q")[1]).withColumn("roof_iqr", F.col("_q")[2] - F.col("_q")[0])
    reason = F.when(F.col("n_roof") < least, "few roof points").when(F.col("roof_iqr") > most_iqr, "uneven roof").when(F.coalesce("_blocked", F.lit(0)) > 0, "no clearance").when(F.col("roof_median_h") < least_height, "low roof").otherwise("ok")
    return out.select(*by, "n_roof", "roof_median_h", "roof_iqr", reason.alias("reason"))


def edge_spread(df: DataFrame, distance: str, cls: str, low: float = -10.0, high: float = 10.0, width: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, centre, ground, building, ratio): counts of ground and roof rows in right-closed bins of distance, all bins
    for each of ``by``, and the share of roof; NULL in an empty bin. The last edge is the first one at or over ``high``."""
    n = int(np.ceil((high - low) / width - 1e-9))
    rows = df.where(F.col(cls).isin("ground", "roof", "building")).withColumn("bin", right_closed_bin(F.col(distance), low, width, low + n * width)).where("bin is not null")
    found = rows.groupBy(*by, "bin").agg(F.count(F.when(F.col(cls) == "ground", 1)).alias("ground"), F.count(F.when(F.col(cls) != "ground", 1)).alias("building"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    bins = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    out = bins.join(found, [*by, "bin"], "left")
    g, b = F.coalesce("ground", F.lit(0)), F.coalesce("building", F.lit(0))
    return out.select(*by, "bin", (low + (F.col("bin") + 0.5) * width).alias("centre"), g.alias("ground"), b.alias("building"), F.try_divide(b.cast("double"), (g + b).cast("double")).alias("ratio"))


def quality_gate(df: DataFrame, by: Sequence[str], distance: str = "distance", cls: str = "photon_class", least: int = 3, reach: float = 9.0) -> DataFrame:
    """Rows of files with more than ``least`` ground and roof photons each, ground that comes near and roof that goes far."""
    at = lambda name: F.when(F.col(cls) == name, F.col(distance))
    good = df.groupBy(*by).agg(F.count(at("ground")).alias("g"), F.count(at("roof")).alias("r"), F.max(at("ground")).alias("gm"), F.min(at("roof")).alias("rm"))
    keep = good.where((F.col("g") > least) & (F.col("r") > least) & (F.col("gm") < reach) & (F.col("rm") > -reach)).select(*by)
    return df.join(keep, list(by), "left_semi")


def band(df: DataFrame, along: str, intercept: Column, half: float = 50.0) -> DataFrame:
    """Rows within ``half`` of where an edge crosses the track."""
    return df.where(F.col(along).between(intercept - half, intercept + half))
