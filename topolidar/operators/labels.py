"""Joins that bring the labels of other products to photons. Positions in files are columns, never row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_segments(segments: DataFrame, values: Sequence[str], by: Sequence[str] = (), begin: str = "ph_index_beg", count: str = "ph_count", order: str | None = None) -> DataFrame:
    """(by, ph_index, values): a row for each photon of each segment, photons counted from 0 and ``begin`` from 1. Segments
    that begin at 0 or have no photon give none; of several for one photon the last in ``order`` (or by begin) counts."""
    live = segments.where((F.col(begin) > 0) & (F.col(count) > 0))
    rows = live.select(*by, F.explode(F.sequence((F.col(begin) - 1).cast("long"), (F.col(begin) + F.col(count) - 2).cast("long"))).alias("ph_index"), F.struct(F.col(order or begin).alias("_o"), *values).alias("_v"))
    return rows.groupBy(*by, "ph_index").agg(F.max("_v").alias("_v")).select(*by, "ph_index", *(F.col("_v")[v].alias(v) for v in values))


def segment_to_photon(photons: DataFrame, segments: DataFrame, values: Sequence[str], by: Sequence[str] = (), **names) -> DataFrame:
    """``photons`` with the values of the segment they are in, 0 where they are in none."""
    found = expand_segments(segments, values, by, **names)
    return photons.join(found, [*by, "ph_index"], "left").withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def with_alongtrack(photons: DataFrame) -> DataFrame:
    return photons.withColumn("alongtrack", F.col("segment_dist_x") + F.col("dist_ph_along"))


def label_index(signal: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``signal`` (ph_segment_id, classed_pc_indx) with ph_index: its place in the segment after the place where the segment
    begins. Signals of unknown or empty segments go; of a segment's repeated rows the first begin counts."""
    first = segments.groupBy(*by, F.col("segment_id").alias("ph_segment_id")).agg(F.min("ph_index_beg").alias("_begin")).where("_begin <> 0")
    return signal.join(first, [*by, "ph_segment_id"]).withColumn("ph_index", (F.col("classed_pc_indx") + F.col("_begin") - 2).cast("long")).drop("_begin")


def scatter(photons: DataFrame, labels: DataFrame, values: Sequence[str], by: Sequence[str] = (), order: str | None = None, fill: int | float | None = 0) -> DataFrame:
    """``photons`` with values scattered by ph_index, in one join for all of them; ``fill`` elsewhere. Of several labels the
    last in ``order`` counts, or the largest values."""
    v = F.struct(*([F.col(order).alias("_o")] if order else []), *values)
    one = labels.groupBy(*by, "ph_index").agg(F.max(v).alias("_v")).select(*by, "ph_index", *(F.col("_v")[x].alias(x) for x in values))
    out = photons.join(one, [*by, "ph_index"], "left")
    return out if fill is None else out.withColumns({x: F.coalesce(x, F.lit(fill)) for x in values})


def out_of_range(photons: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels whose photon doesn't exist: what a scatter into arrays would have failed on."""
    return labels.join(photons.select(*by, "ph_index"), [*by, "ph_index"], "left_anti")


def is_member(rows: DataFrame, reference: DataFrame, keys: Sequence[str], index: str, out: str = "first_index") -> DataFrame:
    """``rows`` with the least ``index`` of an equal reference row, compared on all of ``keys``; NULL for no member."""
    first = reference.groupBy(*keys).agg(F.min(index).alias(out))
    return rows.join(first, list(keys), "left")


def read_labelled(photons: DataFrame, segments: DataFrame, land: DataFrame | None = None, sea: DataFrame | None = None, by: Sequence[str] = ("granule", "gt")) -> DataFrame:
    """The photon table with alongtrack, solar elevation and, where their products are given, the classes of land
    (atl08_class, h_norm) and sea (atl24_class, ortho_h), and what both together say."""
    from topolidar.functions.rules import combine_classes, contested

    out = with_alongtrack(segment_to_photon(photons, segments, ["segment_dist_x", "solar_elevation"], by, count="segment_ph_cnt"))
    if land is not None:
        found = label_index(land, segments, by).select(*by, "ph_index", F.col("classed_pc_flag").alias("atl08_class"), F.col("ph_h").alias("h_norm"))
        out = scatter(out, found, ["atl08_class", "h_norm"], by)
    if sea is not None:
        found = sea.select(*by, F.col("index_ph").cast("long").alias("ph_index"), F.col("class_ph").alias("atl24_class"), "ortho_h")
        out = scatter(out, found, ["atl24_class", "ortho_h"], by)
    if land is not None and sea is not None:
        out = out.withColumn("combined_class", combine_classes(F.col("atl08_class"), F.col("atl24_class"))).withColumn("contested_class", contested(F.col("atl08_class"), F.col("atl24_class")))
    return out
