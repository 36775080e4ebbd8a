"""Joins with hot keys: what they send through the driver."""

import pytest
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.common import cut, salted_left_join, text_left_join
from sightline.llm.components import components


def sent(df) -> int:
    """Broadcasts of the plan that made df's rows."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_copies_for_salts_are_not_broadcast(spark):
    """The tables are far below the limit for broadcasts; the copies of keys are not in what Spark expects of their size."""
    rows, keys = spark.range(300).select("id", (F.col("id") % 50 % 7).alias("k")), cut(spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")))
    got = salted_left_join(rows, keys, ["k"], F.col("id"))
    assert sent(got) == 0
    assert {(r.id, r.v) for r in got.collect()} == {(i, k * 10 if (k := i % 50 % 7) < 5 else None) for i in range(300)} and got.count() == 300
    labels = components(spark.range(1, 40).select(F.col("id").alias("a"), F.col("id").bitwiseAND(24).alias("b")))
    assert sent(labels) == 0 and {(r.node, r.component) for r in labels.collect()} == {(i, i & 24) for i in range(40)}


@pytest.mark.parametrize("most", [4, 5])
def test_rows_with_texts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SENT", most)
    rows = spark.createDataFrame([(i % 8, f"text {i}") for i in range(80)], "k long, text string")
    got = text_left_join(rows, cut(spark.range(5).select(F.col("id").alias("k"), F.lit(True).alias("found"))), ["k"], F.col("text"))
    assert (sent(got) > 0) == (most == 5) and {(r.k, r.text, r.found) for r in got.collect()} == {(i % 8, f"text {i}", True if i % 8 < 5 else None) for i in range(80)}
