"""Tables that several steps of one job read: written once to the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``. Only a local session may do without the setting; elsewhere that is an error."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-stored-")
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to a shared folder and read from there, so that what it took to make it isn't done again for each reader."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, *columns: str) -> DataFrame:
    """df, stored in as many buckets of the columns as the session has shuffle partitions, so that joins by them don't shuffle it again.

    A temporary name in the session's catalog stands for the folder; as with other stored tables, both stay for the results that are read from them.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).option("path", shared_folder(spark)).saveAsTable(name)
    return spark.table(name)
