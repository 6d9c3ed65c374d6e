"""The folder that driver and executors share, and cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a temporary folder only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="arcwell-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder: later plans start there and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arcwell/loop-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
