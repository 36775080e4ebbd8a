"""Places in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def placed(rows: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in their group, from 1 in the given order, as a window's row number would be.

    Rows are sorted over range partitions by group and order, so one group's rows are in many tasks, where a window has them in one. Each
    partition's rows of a group are counted, and what stands in earlier partitions is added. A null group is a group. The order should be
    total; rows that are equal in it have any of their places.
    """
    if name in rows.columns:
        rows = rows.drop(name)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    rows = stored(rows).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows).withColumn("_part", F.shiftright("_at", 33))
    starts = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_own")).agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_group").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_group", "_own", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_shift"))
    out = rows.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    return out.withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop("_at", "_part", "_group", "_own", "_shift")
