"""Tables that cut lineage: written once in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary folder on a local master only: executors of a
    cluster would not see it, so that is a ValueError there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/scriptoria/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The frame, written as a table and read again: what follows never computes it anew, also after an executor is lost. The
    table goes with the driver's end."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(f"{folder}/table")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(f"{folder}/table")
