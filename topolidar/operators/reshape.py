"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The families of five columns that a land segment has for its 20 m parts.
FAMILIES = ("latitude_20m", "longitude_20m", "h_te_best_fit_20m", "h_canopy_20m", "subset_te_flag", "subset_can_flag")


def expand_families(df: DataFrame, families: Sequence[str] = FAMILIES, n: int = 5, index: str = "sub_segment_index") -> DataFrame:
    """Columns name_0 ... name_{n-1} of each family as n rows; families that lack a column are left out, and with none of
    them there are no rows."""
    there = [f for f in families if all(f"{f}_{i}" in df.columns for i in range(n))]
    gone = {f"{f}_{i}" for f in there for i in range(n)}
    rest = [c for c in df.columns if c not in gone]
    if not there:
        return df.limit(0)
    zipped = F.arrays_zip(*(F.array(*(F.col(f"{f}_{i}") for i in range(n))).alias(f) for f in there))
    return df.select(*rest, F.posexplode(zipped).alias(index, "_f")).select(*rest, index, *(F.col(f"_f.{f}").alias(f) for f in there))


def exploded_columns(df: DataFrame, arrays: dict[str, int]) -> DataFrame:
    """Fixed-size arrays as columns name_0 ... name_{n-1}."""
    return df.select(*(c for c in df.columns if c not in arrays), *(F.try_element_at(a, F.lit(i + 1)).alias(f"{a}_{i}") for a, n in arrays.items() for i in range(n)))


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of some tables, columns by name; absent ones are NULL."""
    out, *more = frames
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
