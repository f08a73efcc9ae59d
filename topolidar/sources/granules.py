"""Granules: finding files, pairing products of one overpass, and the attributes that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolidar.functions.meta import pairing_key

ATTRIBUTES = ("description", "atlas_beam_type", "atlas_pce", "atlas_spot_number", "atmosphere_profile", "groundtrack_id", "sc_orientation")


def find_files(spark: SparkSession, folder: str, extensions: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """(path, length) of the files under ``folder`` with one of the extensions; contents are not read."""
    wanted = [extensions] if isinstance(extensions, str) else list(extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin([e.lower().lstrip(".*") for e in wanted]))


def pair_granules(names: DataFrame, others: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Each granule with the other product's file of the same overpass, NULL without one; of several the least path."""
    first = others.groupBy(pairing_key_of(path).alias("_pair")).agg(F.min(path).alias(path))
    return names.withColumn("_pair", pairing_key_of(name)).join(first, "_pair", "left").drop("_pair")


def unpaired(names: DataFrame, others: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Granules that have no counterpart: what a run will skip."""
    return names.withColumn("_pair", pairing_key_of(name)).join(others.select(pairing_key_of(path).alias("_pair")), "_pair", "left_anti").drop("_pair")


def pairing_key_of(column: str):
    return pairing_key(F.col(column))


def with_attributes(df: DataFrame, attributes: DataFrame, by: Sequence[str] = ("granule", "gt")) -> DataFrame:
    """``df`` with its granule's attributes as text; a granule that lacks any of them has all of them blank."""
    complete = F.lit(True)
    for a in ATTRIBUTES:
        complete = complete & F.col(a).isNotNull()
    known = attributes.where(complete).select(*by, *(F.col(a).cast("string").alias(a) for a in ATTRIBUTES))
    return df.join(known, list(by), "left").withColumns({a: F.coalesce(a, F.lit("")) for a in ATTRIBUTES})
