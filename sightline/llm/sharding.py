"""Sharding by a minimax contiguous partition: the smallest shard capacity that holds ordered atomic groups, found by binary search."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, salted_left_join, table
from .copies import given_key, own_id

#: Group bounds that the driver searches itself. While more are left, Spark narrows them down (see _narrowed).
DRIVER_BOUNDS = 200_000
#: Capacities that are tried at once in a narrowing pass.
TRIALS = 16


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, leader, digest, row, before: documents in order of their group's smallest doc_id, then its text's hash, then doc_id.

    Groups are equal texts (null equals empty), also where a doc_id has several. ``row`` counts documents and ``before`` bytes that stand before, without a gap.
    Both come from a range partition with one total for each partition, so a group of any size is spread over tasks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(given_key().alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = salted_left_join(rows, several, ["digest"], F.col("doc_id")).withColumn("leader", F.coalesce("leader", "doc_id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, "leader", "digest", "doc_id").withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy("part").collect()  # a row for each partition
    sizes, counts, starts = 0, 0, []
    for t in totals:
        starts.append((t["part"], sizes, counts))
        sizes, counts = sizes + t["size"], counts + t["rows"]
    starts = docs.sparkSession.createDataFrame(starts, "part int, size_start long, row_start long")
    own = Window.partitionBy("part").orderBy("leader", "digest", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(starts), "part")
    rows = rows.withColumn("before", F.col("size_start") + F.sum("size").over(own) - F.col("size")).withColumn("row", F.col("row_start") + F.row_number().over(Window.partitionBy("part").orderBy("leader", "digest", "doc_id")) - 1)
    first = F.row_number().over(Window.partitionBy("part", "leader", "digest").orderBy("doc_id")) == 1
    return cut(rows.withColumn("bound", first & (F.col("doc_id") == F.col("leader"))).select("doc_id", "size", "text_crc32", "leader", "digest", "row", "before", "bound"))


def greedy(bounds: list[int], total: int, capacity: int, shards: int) -> list[int] | None:
    """Starts of the shards when each takes all groups that fit; None if the shards don't hold all."""
    cuts, start = [0], 0
    while total - start > capacity:
        k = bisect_right(bounds, start + capacity) - 1
        if k < 0 or bounds[k] <= start or len(cuts) == shards:
            return None
        start = bounds[k]
        cuts.append(start)
    return cuts


def minimax_cuts(bounds: DataFrame, total: int, largest: int, shards: int, driver_bounds: int = DRIVER_BOUNDS) -> list[int]:
    """Starts of the shards, in bytes, of the contiguous partition with the smallest largest shard.

    bounds: column ``before``, the start of each group in order. Greedy filling needs no more shards than any other way, so a
    capacity is feasible if greedy filling under it is, and the smallest such is found by binary search. It lies between
    the larger of the mean and the largest group, and the mean plus the largest group.

    The k-th cut of a capacity lies between those of a smaller and a larger one. So only bounds in these windows matter, and
    each pass over the bounds, which tries TRIALS capacities at once, leaves about a part in TRIALS of the windows; the driver
    goes on alone when no more than ``driver_bounds`` are left.
    """
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    windows = [(max(0, k * low - k * largest), min(total, k * high)) for k in range(1, shards + 1)]
    near = bounds.select("before")
    while True:
        inside = F.lit(False)
        for a, b in _united(windows):
            inside = inside | F.col("before").between(a, b)
        near = near.filter(inside)
        if near.limit(driver_bounds + 1).count() <= driver_bounds:
            break
        if low >= high:  # the capacity is known, and one pass for each shard finds its cuts
            return _cuts(near, total, [high], shards)[0][:-1]
        low, high, windows = _narrowed(near, total, low, high, shards)
    found = sorted({r["before"] for r in near.distinct().collect()} | {0})
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(found, total, middle, shards) else (middle + 1, high)
    return greedy(found, total, high, shards)


def _united(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _narrowed(near: DataFrame, total: int, low: int, high: int, shards: int) -> tuple[int, int, list[tuple[int, int]]]:
    """The range of capacities after one pass for each shard, and the windows of the cuts between its ends."""
    trials = sorted({low + (high - low) * k // (TRIALS - 1) for k in range(TRIALS)})
    cuts = _cuts(near, total, trials, shards)
    feasible = next(k for k, c in enumerate(cuts) if c[-1] >= total)
    worse = cuts[max(feasible - 1, 0)]
    windows = [(min(a, b), max(a, b)) for a, b in zip(worse[1:], cuts[feasible][1:], strict=True)]
    return (trials[feasible - 1] + 1 if feasible else low), trials[feasible], windows


def _cuts(near: DataFrame, total: int, trials: list[int], shards: int) -> list[list[int]]:
    """Each trial's cuts, from 0 to where its last shard ends: the total if it is feasible."""
    cuts = [[0] for _ in trials]
    for _ in range(shards):
        limits = [c[-1] + t for c, t in zip(cuts, trials, strict=True)]
        ends: list[Column] = [F.lit(total) if limit >= total else F.max(F.when(F.col("before") <= limit, F.col("before"))) for limit in limits]
        row = near.agg(*(e.alias(f"c{k}") for k, e in enumerate(ends)), F.count("*")).first()
        for k, c in enumerate(cuts):
            c.append(max(c[-1], row[k] or 0))
    return cuts


def shard_documents(docs: DataFrame, shards: int = 16, driver_bounds: int = DRIVER_BOUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in contiguous shards of near-equal bytes.

    The law is ``bytes``: the largest shard is the smallest that any contiguous partition of the groups has. Groups are equal
    texts and never parted, so a group larger than the mean sets the capacity. Size is the text's bytes in UTF-8 plus 1 (null: 1).
    ``slot`` counts a shard's documents from 0. grown_shard is null, as a contiguous partition moves rows when shards are added.

    Null counts as an empty text; a very long text is one document, whose size may set the capacity. Repeated rows are placed each, the
    texts of one repeated doc_id are groups of their own, one after the other; rows without a doc_id come last. Of capacities the smallest is taken, and shards are filled
    from the first, so there are no ties. With fewer groups than shards the last shards are empty; an empty table gives no rows; other
    columns are ignored.
    """
    rows = ordered(docs)
    bounds = rows.filter("bound")
    sums = rows.agg(F.sum("size").alias("total")).first()["total"] or 0
    largest = rows.groupBy("leader", "digest").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] or 0
    cuts = minimax_cuts(bounds, sums, largest, shards, driver_bounds) if sums else [0]
    starts = {r["before"]: r["row"] for r in bounds.filter(F.col("before").isin(cuts)).select("before", "row").collect()}  # at most one for each shard
    shard, first = F.lit(0), F.lit(0).cast("long")
    for k, c in enumerate(cuts[1:], 1):
        shard = F.when(F.col("before") >= c, k).otherwise(shard)
        first = F.when(F.col("before") >= c, F.lit(starts[c])).otherwise(first)
    return rows.select(own_id(), "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), (F.col("row") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
