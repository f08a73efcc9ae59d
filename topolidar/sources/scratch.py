"""Tables written to the folder that driver and executors share, so that a lost executor costs one task and not the job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset a folder of our own is made, but only by a local master, as in
    tests: on a cluster, executors would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="topolidar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/topolidar/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing will read again."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
