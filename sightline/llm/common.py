"""What the operators of this subpackage share: reading tables, cutting lineage, joining hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices that a hot key of a salted join is dealt out to.
SALTS = 16
#: Rows of a key table up to which it is sent to all tasks as it is, where the rows that it is joined to hold texts.
SENT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it a new column of df, whatever the case of df's own."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, whose executors are the driver, may do without the setting; elsewhere that is an error. The folders stay for the
    results that are read from them; their owner removes them with the checkpoint folder.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that later steps survive lost executors.

    A written table is read by columns and has its true size. (A checkpointed one keeps the estimate of its plan, and those of
    iterated joins soon have more digits than can be counted.)
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def salted_left_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of rows with one row per key, where a key may hold a large part of all rows.

    Each key's row is copied to every salt and rows choose a salt by ``spread``, so a hot key meets in many tasks. Both sides are shuffled:
    the size that Spark expects of the keys leaves the copies out, and a broadcast of them would take ``salts`` times its limit of the driver's memory.
    """
    (salt,) = unused(rows, "salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = keys.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, salt], "left").drop(salt)


def text_left_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """``salted_left_join`` of rows that hold texts with keys that are cut: up to ``SENT`` keys are sent to the rows, so that these aren't shuffled."""
    return rows.join(F.broadcast(keys), on, "left") if keys.count() <= SENT else salted_left_join(rows, keys, on, spread)
