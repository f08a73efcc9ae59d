"""The driver's tables in the roles of the domain's: events as photons of a track, embeddings as a point cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    """Rounded, and never minus zero, so that sums of floats in another order compare equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value and pos, the time in seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("pos"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x, y, z in metres."""
    at = lambda i: (F.get("embedding", F.lit(i)).cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, lat, lon in degrees."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("custkey"), (F.pmod(k * 7919, F.lit(16000)) / 100.0 - 80).alias("lat"), (F.pmod(k * 104729, F.lit(36000)) / 100.0 - 180).alias("lon"))


E_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS pos FROM events)"
V_SQL = "v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"
C_SQL = "c AS (SELECT c_custkey AS custkey, (c_custkey * 7919 % 16000) / 100.0::DOUBLE - 80 AS lat, (c_custkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer)"
