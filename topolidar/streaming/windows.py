"""Streams of photons or events: tumbling windows with a watermark, and incremental segment counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(df: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """(window_start, by, n, total): rows later than ``late`` behind the latest are dropped, by the watermark."""
    at = F.col(time).cast("timestamp")
    rows = df.withColumn("_at", at).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended to Parquet; windows that the watermark has passed."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
