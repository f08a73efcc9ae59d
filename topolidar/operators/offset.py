"""Geolocation offsets: a gridded ground surface, and the shift of a track that fits it best."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.sources import scratch

#: Rows of a surface, along the track, that one task holds; photons that one task lays over it.
ROWS, PHOTONS = 256, 50_000
#: Tracks whose shifts are broadcast, some hundred bytes each.
TRACKS = 100_000
#: A search's further rounds: shifts on either side of the best one so far, and by how much they get finer.
AROUND, FINER = 4, 4.0


def grid_mean(df: DataFrame, x: str, y: str, z: str, res: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, ix, iy, z, n): means over cells of equal width between the least and largest x and y, ceil(range / res) of them;
    the last cell of an axis holds its right side."""
    ends = df.groupBy(*by).agg(*(f(c).alias(f"_{c}{i}") for c in (x, y) for i, f in enumerate((F.min, F.max))))
    on = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))

    def cell(c: str) -> Column:
        lo, hi = F.col(f"_{c}0"), F.col(f"_{c}1")
        n = F.greatest(F.ceil((hi - lo) / res), F.lit(1))
        return F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - lo) * n, hi - lo), F.lit(0.0))), n - 1).cast("int")

    return on.select(*by, cell(x).alias("ix"), cell(y).alias("iy"), F.col(z).alias("_z")).groupBy(*by, "ix", "iy").agg(F.avg("_z").alias("z"), F.count(F.lit(1)).alias("n"))


def filled_rows(ix: np.ndarray, iy: np.ndarray, z: np.ndarray, first: int, stop: int, columns: int) -> np.ndarray:
    """Rows ``first`` to ``stop`` of a grid of ``columns``: cells without a value take that of the nearest cell that has
    one, by distance between centres, of equally near ones the first by column and row. Exact wherever, for each column,
    the known cells (ix, iy, z) hold all of these rows and the nearest before and after them.

    The nearest known cell of a column is looked up row by row; then a cell's nearest one is the best over columns."""
    rows = np.arange(first, stop)
    away, value = np.full((len(rows), columns), np.inf), np.full((len(rows), columns), np.nan)
    for c in np.unique(ix):
        at = np.sort(iy[ix == c])
        known = z[ix == c][np.argsort(iy[ix == c], kind="stable")]
        after = np.searchsorted(at, rows)
        before, after = np.maximum(after - 1, 0), np.minimum(after, len(at) - 1)
        d0, d1 = np.abs(rows - at[before]), np.abs(at[after] - rows)
        away[:, c], value[:, c] = np.minimum(d0, d1), known[np.where(d0 <= d1, before, after)]
    best, out = np.full(away.shape, np.inf), np.full(away.shape, np.nan)
    for c in np.unique(ix):
        d2 = away[:, c, None] ** 2 + (np.arange(columns) - c)[None, :] ** 2
        out = np.where(d2 < best, value[:, c, None], out)
        best = np.minimum(best, d2)
    return out


def surface(ground: DataFrame, res: float = 1.0, by: Sequence[str] = (), x: str = "crosstrack", y: str = "alongtrack", z: str = "z") -> DataFrame:
    """(by, part, x0, y0, rx, ry, nx, ny, data): the ground as a grid of means without holes, in parts of ROWS rows along the
    track; data has a part's rows in a row, as doubles. A hole is filled by the nearest cell of the whole track: what a part
    lacks are the last cell of each column before it and the first one after, which come from summaries of parts."""
    by = list(by)
    ends = ground.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    count = lambda c: F.greatest(F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / res), F.lit(1))
    ends = ends.where("x0 is not null and y0 is not null").withColumns({"nx": count("x").cast("int"), "ny": count("y").cast("long")})
    ends = ends.withColumns({"rx": (F.col("x1") - F.col("x0")) / F.col("nx"), "ry": (F.col("y1") - F.col("y0")) / F.col("ny")}).drop("x1", "y1")
    cells = grid_mean(ground, x, y, z, res, by).where("z is not null").select(*by, F.floor(F.col("iy") / ROWS).alias("part"), "ix", F.col("iy").cast("long").alias("iy"), "z")
    own = cells.groupBy(*by, "part", "ix").agg(F.min(F.struct("iy", "z")).alias("head"), F.max(F.struct("iy", "z")).alias("tail"))
    parts = ends.select(*by, "nx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ny") - 1) / ROWS))).alias("part"))
    every = parts.select(*by, "part", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("ix")).join(own, [*by, "part", "ix"], "left")
    column = Window.partitionBy(*by, "ix").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*by, "part", "ix", F.last("tail", ignorenulls=True).over(column.orderBy("part")).alias("a"), F.last("head", ignorenulls=True).over(column.orderBy(F.col("part").desc())).alias("b"))
    carried = carried.select(*by, "part", "ix", F.explode(F.array_compact(F.array("a", "b"))).alias("c")).select(*by, "part", "ix", "c.iy", "c.z")
    known = cells.union(carried)
    rows = known.join(ends, by) if by else known.crossJoin(F.broadcast(ends))
    named = ["part", "x0", "y0", "rx", "ry", "nx", "ny"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        first = int(head["part"]) * ROWS
        grid = filled_rows(*(pdf[c].to_numpy() for c in ("ix", "iy", "z")), first, min(int(head["ny"]), first + ROWS), int(head["nx"]))
        return pd.DataFrame([[*(head[c] for c in (*by, *named)), grid.astype("<f8").tobytes()]], columns=[*by, *named, "data"])

    return rows.groupBy(*by, "part").applyInPandas(fill, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, *named)), "data binary"]))


def bilinear(grid: np.ndarray, x0: float, y0: float, res: tuple[float, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between the centres of cells (first axis x); NaN outside them."""
    u, v = ((np.asarray(c) - c0) / (r or 1.0) - 0.5 for c, c0, r in ((x, x0, res[0]), (y, y0, res[1])))
    out = np.full(len(u), np.nan)
    ok = (u >= 0) & (v >= 0) & (u <= grid.shape[0] - 1) & (v <= grid.shape[1] - 1)
    i, j = np.minimum(u[ok].astype(int), max(grid.shape[0] - 2, 0)), np.minimum(v[ok].astype(int), max(grid.shape[1] - 2, 0))
    a, b = u[ok] - i, v[ok] - j
    i1, j1 = np.minimum(i + 1, grid.shape[0] - 1), np.minimum(j + 1, grid.shape[1] - 1)
    out[ok] = grid[i, j] * (1 - a) * (1 - b) + grid[i1, j] * a * (1 - b) + grid[i, j1] * (1 - a) * b + grid[i1, j1] * a * b
    return out


def _laid(photons: DataFrame, surfaces: DataFrame, by: Sequence[str], x: str, y: str, z: str) -> tuple[DataFrame, DataFrame]:
    """Photons (by, _part, _salt, _x, _y, _z) by the part of the surface that they lie over, at most some PHOTONS under one
    salt, and for each such group the parts that shifted photons can meet, their own and its neighbours."""
    by = list(by)
    frame = surfaces.groupBy(*by).agg(F.first(F.struct("y0", "ry", "ny")).alias("f"))
    rows = photons.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(z).cast("double").alias("_z")).where("_x is not null and _y is not null and _z is not null")
    rows = rows.join(frame, by) if by else rows.crossJoin(F.broadcast(frame))
    row = F.coalesce(F.try_divide(F.col("_y") - F.col("f.y0"), F.col("f.ry")), F.lit(0.0))
    last = F.floor((F.col("f.ny") - 1) / ROWS)
    rows = rows.withColumn("_part", F.floor(row / ROWS)).where(F.col("_part").between(-1, last + 1)).drop("f")
    salts = rows.groupBy(*by, "_part").agg(F.ceil(F.count(F.lit(1)) / PHOTONS).alias("_n"))
    rows = rows.join(salts, [*by, "_part"]).withColumn("_salt", F.pmod(F.xxhash64("_x", "_y", "_z"), F.col("_n"))).drop("_n")
    near = F.explode(F.sequence(F.col("part") - 1, F.col("part") + 1)).alias("_part")
    sides = surfaces.select("*", near).join(salts, [*by, "_part"]).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    return rows, sides


def _heights(pieces: pd.DataFrame):
    """The surface as a function of (x, y), from some neighbouring parts of it; NaN outside the centres of the grid's cells."""
    pieces = pieces.sort_values("part")
    head, first = pieces.iloc[0], int(pieces["part"].iloc[0]) * ROWS
    grid = np.ascontiguousarray(np.concatenate([np.frombuffer(d, "<f8").reshape(-1, int(head["nx"])) for d in pieces["data"]]).T)
    return lambda x, y: bilinear(grid, head["x0"], head["y0"] + first * head["ry"], (head["rx"], head["ry"]), x, y)


def _per_group(rows: DataFrame, sides: DataFrame, by: Sequence[str], schema: str, fn) -> DataFrame:
    """``fn(key, photons, parts)`` for each group of ``_laid``, a data frame of ``schema`` after the columns ``by``."""
    key, kinds = [*by, "_part", "_salt"], {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty
        out = fn(left, right)
        for c in reversed(by):
            out.insert(0, c, left[c].iloc[0])
        return out

    whole = ", ".join([*(f"{c} {kinds[c]}" for c in by), schema])
    empty = pd.DataFrame({c.split()[0]: [] for c in whole.split(", ")})
    return rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(run, whole)


def shift_costs(photons: DataFrame, surfaces: DataFrame, reach: float = 10.0, step: float = 0.5, by: Sequence[str] = (), x: str = "crosstrack", y: str = "alongtrack", z: str = "h_ph") -> DataFrame:
    """(by, dx, dy, mae, n): mean absolute height over the surface for each shift of the half-open grid of shifts from
    -``reach`` on. A photon is sent once, to the part of the surface that it lies over; a task sums for all shifts. Shifts
    that leave the surface have no row."""
    return _costs(*_laid(photons, surfaces, by, x, y, z), by, np.arange(round(2 * reach / step)) * step - reach)


def _costs(rows: DataFrame, sides: DataFrame, by: Sequence[str], steps: np.ndarray, around: DataFrame | None = None) -> DataFrame:
    """shift_costs of photons that are laid over a surface, for ``steps`` on both axes from those of ``around`` or from 0."""
    by = list(by)
    if around is None:
        rows = rows.withColumns({"_dx": F.lit(0.0), "_dy": F.lit(0.0)})
    else:
        centres = F.broadcast(around.select(*by, F.col("dx").alias("_dx"), F.col("dy").alias("_dy"))) if around.count() <= TRACKS else around.select(*by, F.col("dx").alias("_dx"), F.col("dy").alias("_dy"))
        rows = rows.join(centres, by) if by else rows.crossJoin(centres)

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {c: left[c].to_numpy() for c in ("_x", "_y", "_z")}
        if np.abs(steps).max() / (right["ry"].iloc[0] or 1e9) > ROWS / 2:
            raise ValueError("the surface is too fine for shifts of this reach")
        out, over = [], _heights(right)
        for dx in left["_dx"].iloc[0] + steps:
            for dy in left["_dy"].iloc[0] + steps:
                off = np.abs(at["_z"] - over(at["_x"] + dx, at["_y"] + dy))
                ok = ~np.isnan(off)
                out.append((dx, dy, off[ok].sum(), ok.sum()))
        return pd.DataFrame(out, columns=["dx", "dy", "total", "n"])

    met = _per_group(rows, sides, by, "dx double, dy double, total double, n long", sums)
    return met.groupBy(*by, "dx", "dy").agg((F.sum("total") / F.sum("n")).alias("mae"), F.sum("n").alias("n")).where("n > 0")


def best_shift(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The shift of least cost for each track, ties to the smaller dx and then dy."""
    return costs.groupBy(*by).agg(F.min(F.struct("mae", "dx", "dy")).alias("b")).select(*by, "b.dx", "b.dy", "b.mae")


def find_shift(photons: DataFrame, surfaces: DataFrame, by: Sequence[str] = (), reach: float = 10.0, step: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """(by, dx, dy, mae): the shift of least cost on the grid, then on ever finer grids around the best one so far, until
    steps are under ``tolerance``. All tracks are searched at once, in a round of the whole for each grid. Photons beside
    their part of the surface, and what a round found, are written, so a lost executor costs a task's work."""
    rows, sides = _laid(photons, surfaces, by, "crosstrack", "alongtrack", "h_ph")
    rows, sides = scratch.written(rows, "photons"), scratch.written(sides, "surface")
    best = scratch.written(best_shift(_costs(rows, sides, by, np.arange(round(2 * reach / step)) * step - reach), by), "shift")
    while step > tolerance:
        step /= FINER
        best = scratch.written(best_shift(_costs(rows, sides, by, np.arange(-AROUND, AROUND + 1) * step, best), by), "shift")
    return best


def z_shift(photons: DataFrame, surfaces: DataFrame, shifts: DataFrame, by: Sequence[str] = (), x: str = "crosstrack", y: str = "alongtrack", z: str = "h_ph") -> DataFrame:
    """(by, z_shift) for each of ``shifts`` (by, dx, dy): the median height of shifted photons over the surface, 0 for a
    track that meets none of it."""
    by = list(by)
    moved = shifted(photons, shifts.withColumns({"dx": -F.col("dx"), "dy": -F.col("dy")}), by, x, y)
    rows, sides = _laid(moved, surfaces, by, x, y, z)
    over = _per_group(rows, sides, by, "above double", lambda left, right: pd.DataFrame({"above": left["_z"].to_numpy() - _heights(right)(left["_x"].to_numpy(), left["_y"].to_numpy())}))
    found = over.where(~F.isnan("above")).groupBy(*by).agg(F.median("above").alias("z_shift"))
    return (shifts.select(*by).join(found, by, "left") if by else found).withColumn("z_shift", F.coalesce("z_shift", F.lit(0.0)))


def cell_costs(photons: DataFrame, cells: DataFrame, res: float, reach: float = 10.0, step: float = 0.5, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(dx, dy, mae, n) like shift_costs, over cells as they are (cx, cy, surface) instead of an interpolated surface: a
    shifted photon without a cell doesn't count. Tiles of cells, grown by ``reach``, meet the photons over them."""
    wide = max(4 * reach, 32 * res)
    tile = lambda c: F.floor(F.col(c) / wide)
    span = int(np.ceil(reach / res)) + 1
    rows = photons.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(z).cast("double").alias("_z")).where("_x is not null and _y is not null and _z is not null").withColumns({"_tx": tile("_x"), "_ty": tile("_y")})
    salts = rows.groupBy("_tx", "_ty").agg(F.ceil(F.count(F.lit(1)) / PHOTONS).alias("_n"))
    rows = rows.join(salts, ["_tx", "_ty"]).withColumn("_salt", F.pmod(F.xxhash64("_x", "_y", "_z"), F.col("_n"))).drop("_n")
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - span) * res / wide), F.floor((F.col(c) + span + 1) * res / wide)))
    sides = cells.withColumn("_tx", touched("cx")).withColumn("_ty", touched("cy")).join(salts, ["_tx", "_ty"]).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    steps = np.arange(round(2 * reach / step)) * step - reach

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"dx": [], "dy": [], "total": [], "n": []})
        cx, cy = right["cx"].to_numpy(), right["cy"].to_numpy()
        grid = np.full((np.ptp(cx) + 1, np.ptp(cy) + 1), np.nan)
        grid[cx - cx.min(), cy - cy.min()] = right["surface"].to_numpy()
        x, y, z = (left[c].to_numpy() for c in ("_x", "_y", "_z"))
        lines = [np.floor((y + dy) / res).astype(np.int64) - cy.min() for dy in steps]
        out = []
        for dx in steps:
            i = np.floor((x + dx) / res).astype(np.int64) - cx.min()
            for dy, j in zip(steps, lines, strict=True):
                ok = (i >= 0) & (i < grid.shape[0]) & (j >= 0) & (j < grid.shape[1])
                off = np.abs(z[ok] - grid[i[ok], j[ok]])
                off = off[~np.isnan(off)]
                out.append((dx, dy, off.sum(), len(off)))
        return pd.DataFrame(out, columns=["dx", "dy", "total", "n"])

    key = ["_tx", "_ty", "_salt"]
    met = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(sums, "dx double, dy double, total double, n long")
    return met.groupBy("dx", "dy").agg((F.sum("total") / F.sum("n")).alias("mae"), F.sum("n").alias("n")).where("n > 0")


def cell_median(photons: DataFrame, cells: DataFrame, res: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(z_shift): the median height over cells as they are, 0 if no photon has one."""
    met = photons.withColumn("cx", F.floor(F.col(x) / res).cast("long")).withColumn("cy", F.floor(F.col(y) / res).cast("long")).join(cells, ["cx", "cy"], "left")
    return met.agg(F.coalesce(F.median(F.col(z) - F.col("surface")), F.lit(0.0)).alias("z_shift"))


def shifted(df: DataFrame, shifts: DataFrame, by: Sequence[str] = (), x: str = "crosstrack", y: str = "alongtrack") -> DataFrame:
    """A swath moved by the shift of its track."""
    on = df.join(shifts.select(*by, "dx", "dy"), list(by)) if by else df.crossJoin(F.broadcast(shifts.select("dx", "dy")))
    return on.withColumn(x, F.col(x) - F.col("dx")).withColumn(y, F.col(y) - F.col("dy")).drop("dx", "dy")
