"""Whitening of embeddings over distinct vectors: each is weighed by its multiplicity, whitened once and joined back to its rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted_left_join, table

#: An entry c becomes the integer floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components that are returned.
COMPONENTS = 8
#: Rows of one vector from which on its key is dealt over salts when it is joined back. There are at most rows / HOT such vectors.
HOT = 1000
#: A component whose variance is below this part of the largest has none but rounding, and can't be scaled to one.
LEAST_SHARE = 1e-12
#: Largest integers that entries may become: beyond it products of sums wouldn't be whole numbers of 64 bits.
MOST = 1 << 50


class Fit(NamedTuple):
    """n vectors with sums S by dimension; unit axes by falling variance, the share each explains, and its root."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float | None]
    scale: list[float | None]


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """rows with ``x``, the vector as integers, and ``key``, its SHA-256; without rows whose vector is null or holds null or non-finite entries.

    Vectors of another length than the most frequent one (of equally frequent ones the greater) are left out too, and so are those with
    entries whose integers are beyond 2^50.
    """
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) <= MOST / SCALE), F.lit(False)))
    rows = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    lengths = rows.groupBy(F.size(vector).alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    rows = rows.filter(F.size(vector) == (lengths["d"] if lengths else 0))
    rows = rows.withColumn("x", F.transform(c, lambda v: (F.floor(v * SCALE) + OFFSET).cast("long")))
    return rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)))


def distinct_vectors(rows: DataFrame, weigh: str = "count") -> DataFrame:
    """(key, x, rows, weight): each different vector once, stored. Its weight is the number of its rows, or 1. Counted before rows are shuffled."""
    groups = rows.groupBy("key").agg(F.first("x").alias("x"), F.count("*").alias("rows"))
    return cut(groups.withColumn("weight", F.col("rows") if weigh == "count" else F.lit(1).cast("long")))


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Principal axes of weighted vectors. None without any.

    Sums are whole numbers. With them each partition centres its vectors and multiplies them, weighted, by themselves; the products are
    added by cell on executors, and the driver gets one number for each pair of dimensions.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                weight, x = batch["weight"].to_numpy(), _matrix(batch["x"])
                if float(weight.sum()) * float(np.abs(x).max()) >= 1 << 62:
                    weight, x = weight.astype(object), x.astype(object)  # whole numbers of any size
                each = weight @ x
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(each)), pa.int32()), pa.array([int(x) for x in each], pa.decimal128(38, 0))], ["i", "s"])

    totals = vectors.agg(F.sum("weight").alias("n")).first()["n"]
    if not totals:
        return None
    found = {r["i"]: int(r["s"]) for r in vectors.select("weight", "x").mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    total = [found[i] for i in range(len(found))]
    d = len(total)
    mean_int = [s // totals for s in total]
    rest = np.array([(s % totals) / totals for s in total])  # x - S / n is (x - floor) - rest, without loss of digits
    floors = np.array(mean_int, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            y = (_matrix(batch["x"]) - floors) - rest if batch.num_rows else np.zeros((0, d))
            gram += (y * batch["weight"].to_numpy().astype(float)[:, None]).T @ y
        if gram.any():
            cells = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(cells // d, pa.int32()), pa.array(cells % d, pa.int32()), pa.array(gram.ravel())], ["i", "j", "v"])

    covariance = np.zeros((d, d))
    for r in vectors.select("weight", "x").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        covariance[r["i"], r["j"]] = r["v"] / totals
    covariance = (covariance + covariance.T) / 2
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    trace, largest = float(np.trace(covariance)), float(max(values.max(), 0))
    good = [bool(values[k] > LEAST_SHARE * largest) for k in order]
    return Fit(totals, total, axes[:, order], [float(max(values[k], 0)) / trace if trace > 0 else None for k in order], [float(np.sqrt(values[k])) if g else None for k, g in zip(order, good, strict=True)])


def _whitened(vectors: DataFrame, model: Fit) -> DataFrame:
    """(key, rows, weight, deviation, z): each vector once. z is null in components without variance."""
    n, sums = model.n, model.sums
    floors, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    scale = np.array([x or np.nan for x in model.scale])
    top = 1 << 63

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"]) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
            z = ((x - floors) - rest) @ model.axes / scale
            small = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums)) < top // 4
            away = x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
            if small and float(np.abs(away).max(initial=0)) ** 2 * len(sums) >= top // 4:
                away = away.astype(object)  # whole numbers of any size
            deviation = (away * away).sum(axis=1)
            deviation = pa.array([int(v) if v < top else None for v in deviation], pa.int64())
            listed = pa.array([[None if v != v else float(v) for v in row] for row in z], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["rows"], batch["weight"], deviation, listed], ["key", "rows", "weight", "deviation", "z"])

    return vectors.mapInArrow(work, "key binary, rows long, weight long, deviation long, z array<double>")


def identity_error(white: DataFrame, n: int, components: list[int]) -> float | None:
    """Largest absolute entry of the whitened vectors' weighted covariance minus the identity, over components that have variance."""
    if not components:
        return None
    z = {k: F.col("z")[k] for k in components}
    means = white.agg(*(F.sum(F.col("weight") * z[k]).alias(str(k)) for k in components)).first()
    away = {k: z[k] - F.lit(means[str(k)] / n) for k in components}
    cells: list[Column] = [F.sum(F.col("weight") * away[a] * away[b]).alias(f"{a},{b}") for a in components for b in components if a <= b]
    row = white.agg(*cells).first().asDict()
    return max(abs(v / n - (cell.split(",")[0] == cell.split(",")[1])) for cell, v in row.items())


def joined_back(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with their vector's columns. Vectors of HOT rows or more, of which there are few, are dealt over salts; the others join plainly."""
    marked = salted_left_join(rows, values.filter(F.col("rows") >= HOT).select("key", F.struct(*(c for c in values.columns if c != "key")).alias("own")), ["key"], F.col("at"))
    hot = marked.filter("own IS NOT NULL").select(*rows.columns, "own.*")
    return hot.unionByName(marked.filter("own IS NULL").drop("own").join(values.filter(F.col("rows") < HOT), "key"))


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weigh: str = "count") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each row with a whole vector and each component, from 1.

    Entries become integers (SCALE, OFFSET). Equal vectors are grouped and whitened once. With ``weigh`` "count" the fit counts each as
    often as it stands there, which is a fit over all rows; with "one" as 1, so that copies don't shape the axes; n is the sum of weights.
    deviation is the exact sum over dimensions of (n * x - S)^2; null where it is over 63 bits. Axes have either sign, the same for all rows.

    Rows whose vector is null, empty, of an unusual length, or holds null, non-finite or huge entries (see ``integers``) are dropped. A
    component without variance has null as its whitened value and no part in identity_error; without any variance explained is null too. Of
    axes with equal variance the order is any, but one for all rows. Vectors of fewer dimensions than components give a row for each dimension.
    Null and repeated ids are handed on; an empty table gives no rows; other columns are ignored and may have any name.
    """
    rows = integers(rows.select(F.col(id).alias("id"), F.col(vector).alias("vector")), "vector").select("id", "key", "x")
    vectors = distinct_vectors(rows, weigh)
    kind = dict(rows.dtypes)["id"]
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = cut(_whitened(vectors, model))
    error = identity_error(white, model.n, [k for k, s in enumerate(model.scale) if s is not None])
    out = joined_back(rows.select("id", "key").withColumn("at", F.monotonically_increasing_id()), white).select("id", "deviation", F.posexplode("z").alias("k", "whitened"))
    explained = F.lit(None).cast("double")
    for k, share in enumerate(model.explained):
        explained = F.when(F.col("k") == k, F.lit(share).cast("double")).otherwise(explained)
    return out.select(F.col("id").alias(id), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
