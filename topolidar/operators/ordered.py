"""Operators over ordered rows: nearest as-of, gap filling, ground normalisation, range sums, running distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.functions.rules import bin_key
from topolidar.operators.segments import with_start
from topolidar.sources import scratch


def _ranged(df: DataFrame, by: Sequence[str], on: str, wide: bool | None) -> DataFrame:
    """``df`` with _part: with ``wide``, by default where there is no ``by``, rows are dealt by ranges of ``by`` and ``on``, so
    that a scan in order is one over each part's rows and one over parts, and no task holds a whole track. The ranges are
    written, as they must not move between the two. Otherwise windows hold a track each."""
    if not (wide if wide is not None else not by):
        return df.withColumn("_part", F.lit(0))
    return scratch.written(df.repartitionByRange(*by, on).withColumn("_part", F.spark_partition_id()), "ranges")


def _handed(df: DataFrame, by: Sequence[str], values: dict[str, Column], down: bool = False) -> DataFrame:
    """(by, _part, values): what the parts before each hand on, by an aggregate of each part and a last over parts."""
    tails = df.groupBy(*by, "_part").agg(*(c.alias(v) for v, c in values.items()))
    before = Window.partitionBy(*by).orderBy(F.col("_part").desc() if down else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return tails.select(*by, "_part", *(F.last(v, ignorenulls=True).over(before).alias(v) for v in values))


def _carry(df: DataFrame, by: Sequence[str], on: str, values: Sequence[str], suffix: str, down: bool = False, tie: str | None = None) -> DataFrame:
    """For each row of ``df`` (see _ranged) the last values at or before it, in order of ``on`` or ``down`` against it: both
    directions use such frames, which are linear, as a frame that looks ahead is quadratic."""
    by = list(by)
    order = [F.col(on).desc() if down else F.col(on), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"{v}{suffix}": F.last(v, ignorenulls=True).over(w) for v in values})
    ends = F.min_by if down else F.max_by
    handed = _handed(df, by, {f"_h_{v}": ends(v, F.when(F.col(v).isNotNull(), F.col(on))) for v in values}, down)
    out = out.join(handed, [*by, "_part"], "left")
    return out.withColumns({f"{v}{suffix}": F.coalesce(f"{v}{suffix}", f"_h_{v}") for v in values}).drop(*(f"_h_{v}" for v in values))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), order: str | None = None, key: str = "right_key", wide: bool | None = None) -> DataFrame:
    """Each left row with ``key`` and ``values`` of the right row nearest on ``on``, of the same ``by``. On a tie the one
    before counts. Of right rows with one key the last in ``order`` counts backwards and the first forwards; without
    ``order`` the largest values do both."""
    by = list(by)
    pick = F.struct(*([F.col(order).alias("_o")] if order else []), *values)
    rows = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(pick).alias("_b"), (F.min(pick) if order else F.max(pick)).alias("_f")).withColumn("_k", F.col(on)).withColumn("_side", F.lit(0))
    id_ = left.withColumn("_left", F.struct(*left.columns)).select(*by, on, "_left").withColumn("_side", F.lit(1))
    both = _ranged(rows.unionByName(id_, allowMissingColumns=True), by, on, wide)
    both = _carry(both, by, on, ["_k", "_b"], "_before", tie="_side")
    both = _carry(both, by, on, ["_k", "_f"], "_after", down=True, tie="_side")
    back, ahead = F.col(on) - F.col("_k_before"), F.col("_k_after") - F.col(on)
    before = F.coalesce(back <= ahead, back.isNotNull())
    found = both.where("_side = 1").select("_left.*", F.when(before, F.col("_k_before")).otherwise(F.col("_k_after")).alias(key), F.when(before, F.col("_b_before")).otherwise(F.col("_f_after")).alias("_v"))
    return found.select(*left.columns, key, *(F.col("_v")[v].alias(v) for v in values))


def interpolated(df: DataFrame, x: str, known: str, by: Sequence[str] = (), out: str = "filled", wide: bool | None = None) -> DataFrame:
    """``df`` with ``known`` filled in linearly over ``x`` where it is NULL, and held constant beyond its first and last
    value. Only rows that exist are filled, so no empty bins need be made."""
    df = _ranged(df.withColumn("_x", F.when(F.col(known).isNotNull(), F.col(x))), by, x, wide)
    df = _carry(df, by, x, ["_x", known], "_0")
    df = _carry(df, by, x, ["_x", known], "_1", down=True)
    x0, z0, x1, z1 = (F.col(c) for c in ("_x_0", f"{known}_0", "_x_1", f"{known}_1"))
    line = z0 + (z1 - z0) * (F.col(x) - x0) / (x1 - x0)
    return df.withColumn(out, F.when(x0 == x1, z0).otherwise(F.coalesce(line, z0, z1))).drop("_part", "_x", "_x_0", "_x_1", f"{known}_0", f"{known}_1")


def normalize_heights(df: DataFrame, height: str, cls: str, ground: Sequence, res: float = 1.0, by: Sequence[str] = (), position: str = "alongtrack", out: str = "h_norm") -> DataFrame:
    """``df`` with heights over the ground: the median of ground rows in bins of ``res``, interpolated over bins that have
    rows and no ground. A track without ground has NULL."""
    df = with_start(df, position, by).withColumn("_bin", bin_key(F.col(position), F.col("_start"), res))
    bins = df.groupBy(*by, "_bin").agg(F.median(F.when(F.col(cls).isin(*ground), F.col(height))).alias("_ground"))
    surface = interpolated(bins, "_bin", "_ground", by).select(*by, "_bin", "filled")
    return df.join(surface, [*by, "_bin"]).withColumn(out, F.col(height) - F.col("filled")).drop("_bin", "_start", "filled")


def range_sum(left: DataFrame, right: DataFrame, low: str, high: str, key: str, value: str, by: Sequence[str] = (), out: str = "total", wide: bool | None = None) -> DataFrame:
    """``left`` with the sum of right values whose ``key`` is from ``low`` to ``high``, 0 if there are none: the difference of
    two running sums, looked up as-of, so that no pairs are made."""
    by = list(by)
    points = right.groupBy(*by, key).agg(F.sum(value).alias("_v")).select(*by, F.col(key).alias("_at"), "_v", F.lit(0).alias("_side"))
    rows = left.withColumn("_left", F.struct(*left.columns)).withColumn("_row", F.monotonically_increasing_id())
    ends = F.explode(F.array(F.struct((F.col(high)).alias("_at"), F.lit(1).alias("_sign"), F.lit(1).alias("_side")), F.struct(F.col(low).alias("_at"), F.lit(-1).alias("_sign"), F.lit(-1).alias("_side"))))
    asks = rows.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high))).select(*by, "_row", ends.alias("_e")).select(*by, "_row", "_e.*")
    w = Window.partitionBy(*by, "_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = _ranged(points.unionByName(asks, allowMissingColumns=True), by, "_at", wide)
    totals = both.groupBy(*by, "_part").agg(F.sum("_v").alias("_v"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_before"))
    sums = both.withColumn("_own", F.coalesce(F.sum("_v").over(w), F.lit(0))).join(totals, [*by, "_part"], "left")
    sums = sums.withColumn("_s", F.col("_own") + F.coalesce("_before", F.lit(0)))
    found = sums.where("_row is not null").groupBy("_row").agg(F.sum(F.col("_sign") * F.col("_s")).alias(out))
    return rows.join(found, "_row", "left").select("_left.*", F.coalesce(out, F.lit(0)).alias(out))


def running_distance(df: DataFrame, step: Column, order: str, by: Sequence[str] = (), out: str = "alongtrack") -> DataFrame:
    """``df`` with the running sum of ``step``, which may use F.lag over the same window; NULL steps count 0."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def first_per_bin(df: DataFrame, position: str, res: float, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The first row, in ``order``, of each floor(position / res): an aggregate that combines before its shuffle."""
    rows = df.withColumn("_bin", F.floor(F.col(position) / res))
    return rows.groupBy(*by, "_bin").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_first")).select("_first.*")


#: Ways to take a line's value between its points; see sample_line.
KINDS = ("linear", "nearest", "nearest-up", "previous", "next", "zero")


def sample_line(df: DataFrame, line: DataFrame, x: str, line_x: str, line_y: str, by: Sequence[str] = (), kind: str = "linear", out: str = "y", beyond: str = "hold", wide: bool | None = None) -> DataFrame:
    """``df`` with a line's value at ``x`` between its points: linear; nearest, on a tie the one before, nearest-up the one
    after; previous or zero, the one before; next. ``beyond`` the line's ends the value is held, NULL ("null"), or, of a
    linear one, goes on straight from the last two points ("extend"). Points of one x are one point, their mean."""
    if kind not in KINDS or beyond not in ("hold", "null", "extend"):
        raise ValueError(f"no interpolation {kind!r} with {beyond!r}")
    points = line.where(F.col(line_x).isNotNull() & F.col(line_y).isNotNull()).groupBy(*by, F.col(line_x).alias(x)).agg(F.avg(line_y).alias("_known"))
    if kind == "linear" and beyond == "extend":
        # Each track's first and last two points, for what lies before and after.
        ranked = points.groupBy(*by).agg(F.min(x).alias("_a"), F.max(x).alias("_z"))
        inner = points.join(ranked, list(by)) if by else points.crossJoin(F.broadcast(ranked))
        seconds = inner.groupBy(*by).agg(F.min(F.when(F.col(x) > F.col("_a"), F.col(x))).alias("_b"), F.max(F.when(F.col(x) < F.col("_z"), F.col(x))).alias("_y"))
        ends = inner.join(seconds, list(by)) if by else inner.crossJoin(F.broadcast(seconds))
        at = lambda c: F.max(F.when(F.col(x) == F.col(c), F.col("_known"))).alias(f"{c}v")
        ends = ends.groupBy(*by, "_a", "_b", "_y", "_z").agg(at("_a"), at("_b"), at("_y"), at("_z"))
    rows = df.withColumn("_left", F.struct(*df.columns)).select(*by, x, "_left")
    both = points.unionByName(rows, allowMissingColumns=True)
    known = F.col("_known").isNotNull()
    both = _ranged(both.withColumn("_n", F.when(known, 0).otherwise(1)).withColumn("_x", F.when(known, F.col(x))), by, x, wide)
    both = _carry(both, by, x, ["_x", "_known"], "_0", tie="_n")
    both = _carry(both, by, x, ["_x", "_known"], "_1", down=True, tie="_n")
    x0, y0, x1, y1 = (F.col(c) for c in ("_x_0", "_known_0", "_x_1", "_known_1"))
    back, ahead = F.col(x) - x0, x1 - F.col(x)
    value = {
        "linear": F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col(x) - x0) / (x1 - x0)),
        "nearest": F.when(back <= ahead, y0).otherwise(y1),
        "nearest-up": F.when(ahead <= back, y1).otherwise(y0),
        "next": y1,
    }.get(kind, y0)
    inside = x0.isNotNull() & x1.isNotNull()
    found = both.where("_left is not null")
    if kind == "linear" and beyond == "extend":
        found = found.join(ends, list(by), "left") if by else found.crossJoin(F.broadcast(ends))
        slope = lambda p, q: F.coalesce((F.col(f"{q}v") - F.col(f"{p}v")) / (F.col(q) - F.col(p)), F.lit(0.0))
        before, after = F.col("_av") + slope("_a", "_b") * (F.col(x) - F.col("_a")), F.col("_zv") + slope("_y", "_z") * (F.col(x) - F.col("_z"))
        value = F.when(inside, value).when(x0.isNull(), before).otherwise(after)
    elif beyond == "hold":
        value = F.when(inside, value).otherwise(F.coalesce(y0, y1))
    else:
        value = F.when(inside, value)
    return found.select("_left.*", value.alias(out))


def in_thirds(df: DataFrame, order: str, value: str, by: Sequence[str] = (), parts: int = 3) -> DataFrame:
    """The mean of ``value`` in each of ``parts`` runs of rows as equal as can be, the first ones longer."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("part", F.ntile(parts).over(w)).groupBy(*by, "part").agg(F.avg(value).alias("mean"))
