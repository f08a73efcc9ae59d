"""Spatial joins by grid cells: both sides meet in cells of equal size, so no pair outside a cell is ever made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.functions import geometry as G


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def covered_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """A row for each cell that a box touches, as _cx, _cy."""
    return df.withColumn("_cx", _cells(x0, x1, size)).withColumn("_cy", _cells(y0, y1, size))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y", bounds: Sequence[str] = ("x_min", "y_min", "x_max", "y_max")) -> DataFrame:
    """Inner join of points with the boxes that hold them, sides included: a point in k boxes gives k rows. ``size`` of a
    cell should be near that of a box."""
    x0, y0, x1, y1 = (F.col(b) for b in bounds)
    left = points.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))
    met = left.join(covered_cells(boxes, x0, y0, x1, y1, size), ["_cx", "_cy"])
    return met.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).drop("_cx", "_cy")


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns ``names`` from a generator of one row, below which the optimiser moves no filter. Else the join's
    inferred IS NOT NULL of a projected coordinate becomes all of its formulas, multiplied step by step, on the driver."""
    made = {c: f"_settled{i}" for i, c in enumerate(names)}
    one = F.inline(F.array(F.struct(*(F.col(c).alias(m) for c, m in made.items()))))
    return df.select("*", one).withColumns({c: F.col(m) for c, m in made.items()}).drop(*made.values())


def within_radius(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y", right_x: str = "px", right_y: str = "py", out: str = "distance") -> DataFrame:
    """Pairs of left and right points less than ``radius`` apart. Cells are as large as the radius, so that a left point
    meets the nine cells around it."""
    left, right = _settled(left, x, y), _settled(right, right_x, right_y)
    here = left.withColumn("_cx", F.explode(F.array(*(F.floor(F.col(x) / radius) + i for i in (-1, 0, 1))))).withColumn("_cy", F.explode(F.array(*(F.floor(F.col(y) / radius) + i for i in (-1, 0, 1)))))
    there = right.withColumn("_cx", F.floor(F.col(right_x) / radius)).withColumn("_cy", F.floor(F.col(right_y) / radius))
    d = F.sqrt(F.pow(F.col(x) - F.col(right_x), F.lit(2)) + F.pow(F.col(y) - F.col(right_y), F.lit(2)))
    return here.join(there, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn(out, d).where(F.col(out) < radius)


def tiles_near_track(tiles: DataFrame, vertices: DataFrame, buffer: float, size: float, key: str = "file_name", bounds: Sequence[str] = ("x_min", "y_min", "x_max", "y_max"), by: Sequence[str] = ()) -> DataFrame:
    """(by, key): tiles at most ``buffer`` from a track's polyline (``vertices``: by, at, x, y), in exact distance. Track
    segments and grown tiles meet in cells."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy("at")
    legs = vertices.select(*by, F.struct("x", "y").alias("a"), F.lead(F.struct("x", "y")).over(w).alias("b")).where("b is not null")
    a, b = F.col("a"), F.col("b")
    legs = covered_cells(legs, F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), size)
    x0, y0, x1, y1 = (F.col(c) for c in bounds)
    grown = covered_cells(tiles, x0 - buffer, y0 - buffer, x1 + buffer, y1 + buffer, size)
    ring = G.box((x0, x1), (y0, y1))
    holds = a["x"].between(x0, x1) & a["y"].between(y0, y1)
    ends = F.least(G.ring_distance(a["x"], a["y"], ring), G.ring_distance(b["x"], b["y"], ring))
    corners = F.array_min(F.transform(ring, lambda p: G.segment_distance(p["x"], p["y"], a, b)))
    cut = F.exists(G.edges(ring), lambda e: _crosses(e["a"], e["b"], a, b))
    near = holds | cut | (F.least(ends, corners) <= buffer)
    return grown.join(legs, ["_cx", "_cy"]).where(near).select(*by, key).distinct()


def _crosses(p: Column, q: Column, a: Column, b: Column) -> Column:
    side = lambda u, v, w: (v["x"] - u["x"]) * (w["y"] - u["y"]) - (v["y"] - u["y"]) * (w["x"] - u["x"])
    return (side(p, q, a) * side(p, q, b) <= 0) & (side(a, b, p) * side(a, b, q) <= 0) & ((p["x"] != q["x"]) | (p["y"] != q["y"]))


def track_line(df: DataFrame, by: Sequence[str] = (), at: str = "alongtrack", x: str = "x", y: str = "y", res: float | None = None) -> DataFrame:
    """(by, line): each track as an ordered array of at, x, y. With ``res`` the first vertex of each floor(at / res), so that
    the array's size follows the track's length and not its photons."""
    if res is not None:
        df = df.groupBy(*by, F.floor(F.col(at) / res).alias("_bin")).agg(F.min(F.struct(F.col(at).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("v"))
    else:
        df = df.select(*by, F.struct(F.col(at).alias("at"), F.col(x).alias("x"), F.col(y).alias("y")).alias("v"))
    return df.groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("line"))


def to_track(points: DataFrame, lines: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", limit: float | None = 25.0) -> DataFrame:
    """Points with crosstrack and alongtrack of their track's line, those with \\|crosstrack\\| below ``limit``."""
    on = points.join(lines, list(by)) if by else points.crossJoin(F.broadcast(lines))
    out = on.withColumn("crosstrack", G.signed_crosstrack(F.col(x), F.col(y), F.col("line"))).withColumn("alongtrack", G.projected_alongtrack(F.col(x), F.col(y), F.col("line"))).drop("line")
    return out if limit is None else out.where(F.abs("crosstrack") < limit)


def corridor_buildings(buildings: DataFrame, lines: DataFrame, by: Sequence[str] = (), buffer: float = 5.0, least_area: float = 300.0) -> DataFrame:
    """Buildings (ring) at most ``buffer`` from a track's line and larger than ``least_area``."""
    met = buildings.join(lines, list(by)) if by else buildings.crossJoin(F.broadcast(lines))
    near = F.exists("ring", lambda p: G.line_distance(p["x"], p["y"], F.col("line")) <= buffer) | F.exists("line", lambda p: G.within(p["x"], p["y"], F.col("ring"), buffer)) | (G.crossings(F.col("ring"), F.col("line")) > 0)
    return met.withColumn("area_sqm", G.area(F.col("ring"))).where((F.col("area_sqm") > least_area) & near)


def simple_crossings(met: DataFrame) -> DataFrame:
    """Buildings that the track's line goes through once: in and out again."""
    return met.where(G.crossings(F.col("ring"), F.col("line")) == 2)


def rings_to_track(met: DataFrame) -> DataFrame:
    """Rings in track coordinates, x across and y along; exterior rings only."""
    line = F.col("line")
    return met.withColumn("ring", F.transform("ring", lambda p: F.struct(G.signed_crosstrack(p["x"], p["y"], line).alias("x"), G.projected_alongtrack(p["x"], p["y"], line).alias("y"))))


def not_grazing(buildings: DataFrame, limit: float = 7.0) -> DataFrame:
    """Buildings, in track coordinates, that reach beyond ``limit`` on both sides of the track."""
    across = F.transform("ring", lambda p: p["x"])
    return buildings.where((F.array_min(across) < -limit) & (F.array_max(across) > limit))


def clip(points: DataFrame, buildings: DataFrame, buffer: float, by: Sequence[str] = (), x: str = "crosstrack", y: str = "alongtrack", key: str = "building_id", size: float = 50.0) -> DataFrame:
    """Points inside a building's ring or less than ``buffer`` from it, with its key: a box test by cells, then the exact one."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = buildings.select(*by, key, "ring", (F.array_min(xs) - buffer).alias("_x0"), (F.array_min(ys) - buffer).alias("_y0"), (F.array_max(xs) + buffer).alias("_x1"), (F.array_max(ys) + buffer).alias("_y1"))
    cells = covered_cells(boxed, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), size)
    here = points.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))
    met = here.join(cells, [*by, "_cx", "_cy"]).where(F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1")))
    return met.where(G.within(F.col(x), F.col(y), F.col("ring"), buffer)).drop("_cx", "_cy", "_x0", "_y0", "_x1", "_y1", "ring")


def heights_around(targets: DataFrame, points: DataFrame, key: str, radius: float = 30.0, ground: Sequence[int] = (2,), upper: Sequence[int] = (0, 1, 3, 4, 5), least: int = 5) -> DataFrame:
    """``key`` with the 98th percentile of heights over the median ground around each target (x, y); NULL without ground or
    with fewer than ``least`` points. Points (px, py, z, classification)."""
    met = within_radius(targets.select(key, "x", "y"), points, radius)
    g = F.median(F.when(F.col("classification").isin(*ground), F.col("z")))
    top = F.percentile(F.when(F.col("classification").isin(*upper), F.col("z")), 0.98)
    found = met.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), F.when(F.count(F.lit(1)) >= least, top - g).alias("als_98"))
    return targets.select(key).join(found, key, "left").select(key, F.coalesce("n_points", F.lit(0)).alias("n_points"), "als_98")
