"""Row rules over photon and lidar tables, as Column expressions. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATHYMETRY = (40, 41)
VEGETATION = (3, 4, 5)
FEET = 0.3048


def ids(wanted: int | str | Sequence) -> list:
    """A class filter's ids as a list; one id may come alone."""
    return list(wanted) if isinstance(wanted, (list, tuple, set, range)) else [wanted]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def within_box(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    """Inclusive on all sides; ``box`` is (min lon, min lat, max lon, max lat)."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def confident_class(cls: Column, confidence: Column, wanted: int = 40, above: float = 0.6) -> Column:
    """0 instead of ``wanted`` where the confidence is over the limit, as observed."""
    return F.when((cls == wanted) & (confidence > above), F.lit(0)).otherwise(cls)


def combine_classes(land: Column, sea: Column) -> Column:
    """Bathymetry wins; other sea classes fill in where the land product has none."""
    return F.when(sea.isin(*BATHYMETRY) | ((land == 0) & (sea != 0)), sea).otherwise(land)


def contested(land: Column, sea: Column) -> Column:
    """0 labelled by none, 1 by land, 2 by sea, 3 by both; negative labels pass through in the sum."""
    total = F.when(land > 0, 1).otherwise(land) + F.when(sea > 0, 10).otherwise(sea)
    return F.when(total == 10, 2).when(total == 11, 3).otherwise(total)


def measurement_type(columns: Sequence[str]) -> Column:
    """Names of the columns that have a value, joined by a dash, or none."""
    joined = F.concat_ws("-", *(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))


def reclassify_unclassified(cls: Column) -> Column:
    return F.when(cls == 1, 3).otherwise(cls)


def reclassify_vegetation(df: DataFrame, cls: str, by: Sequence[str]) -> DataFrame:
    """All vegetation as 3; unclassified points too where a track has ground and no vegetation at all."""
    merged = F.when(F.col(cls).isin(4, 5), 3).otherwise(F.col(cls))
    flags = df.groupBy(*by).agg(F.max((F.col(cls) == 2).cast("int")).alias("_ground"), F.max(F.col(cls).isin(*VEGETATION).cast("int")).alias("_vegetation"))
    bare = (F.col("_ground") == 1) & (F.coalesce("_vegetation", F.lit(0)) == 0)
    return df.join(flags, list(by)).withColumn(cls, F.when(bare & (F.col(cls) == 1), 3).otherwise(merged)).drop("_ground", "_vegetation")


def photon_rate(part: Column, shots: Column) -> Column:
    return F.try_divide(part.cast("double"), shots.cast("double"))


def to_metres(c: Column, factor: float = FEET) -> Column:
    return c * factor


def decimated(index: Column, step: int) -> Column:
    """Every ``step``-th row, by an index that says what the order is."""
    return F.pmod(index, F.lit(step)) == 0


def photon_class(height: Column, roof: Column, tolerance: float = 2.0) -> Column:
    """ground or roof by height, roof where both fit, else noise."""
    return F.when(F.abs(height - roof) <= tolerance, "roof").when(F.abs(height) <= tolerance, "ground").otherwise("noise")


def line_at(x: Column, slope: Column, intercept: Column) -> Column:
    return slope * x + intercept


def line_distance(across: Column, along: Column, slope: Column, intercept: Column, leaving: Column | bool = False) -> Column:
    """Signed distance to the line along = slope * across + intercept, negative before an entry edge and after an exit one."""
    d = (along - line_at(across, slope, intercept)) / F.sqrt(slope * slope + 1)
    return F.when(F.lit(leaving) if isinstance(leaving, bool) else leaving, -d).otherwise(d)


def right_closed_bin(value: Column, low: float, width: float, last: float) -> Column:
    """Number of the bin (low + i * width, low + (i + 1) * width], the first one closed on both sides; NULL outside."""
    return F.when(value.between(low, last), F.greatest(F.ceil((value - low) / width) - 1, F.lit(0)).cast("int"))


def digitized(value: Column, low: float, high: float, step: float) -> Column:
    """How many of the edges low, low + step, ..., high are at most ``value``."""
    return F.greatest(F.lit(0), F.least(F.floor((value - low) / step) + 1, F.lit(int(round((high - low) / step)) + 1))).cast("int")


def bin_key(position: Column, start: Column, width: float) -> Column:
    return F.floor((position - start) / width).cast("long")


def start_of(position: str, by: Sequence[str]) -> Column:
    """The least position of a row's track. A grouped minimum joined back is better for long tracks; see segments."""
    return F.min(position).over(Window.partitionBy(*by))


def sub_segment_offset(flags: Sequence[Column], width: float = 20.0, missing: int = -127) -> Column:
    """Along-track offset of a segment's centre from the first of its parts with a flag over -1, 0 if none has: 50, 30, 10,
    -10 and -30 m for five parts of 20 m. ``missing`` marks no value."""
    n, out = len(flags), None
    for i, flag in enumerate(flags):
        live = (flag != missing) & (flag > -1)
        out = (F if out is None else out).when(live, F.lit(width * (n / 2 - i)))
    return out.otherwise(F.lit(0.0))
