"""What the operators of this subpackage share: the shared folder and reading."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from arcwell.scratch import shared_dir

#: Words of a text: runs of anything but the six ASCII white space characters.
#: ``bytes.split()`` splits UTF-8 text at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def store(uri: str):
    """The file system and path of a shared place, for the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


#: Rows of an Arrow batch: texts may be long, and a batch is in memory several times.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arcwell/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: what reads it survives the loss of executors without
    running the steps before again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables and archives below the shared folder.

    For the caller, once the results that read them are written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/arcwell")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
