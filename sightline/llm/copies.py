"""Keys of documents, and exact copies of them, which the substring operators count once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_left_join, text_left_join, unused

#: From here on keys are made of the row, for those whose id doesn't tell them. They are never null, so joins need no test for null.
NO_ID = 1 << 62
#: Of a document's role: no other has its text; the first with its text; another one with it.
SINGLE, FIRST, COPY = 0, 1, 2


def made_key(*columns: str) -> Column:
    return F.lit(NO_ID) + F.xxhash64(*columns).bitwiseAND(F.lit((1 << 61) - 1))


def given_key(id: str = "doc_id") -> Column:
    """The id, or where it is null a key that is made of the text, above all ids."""
    return F.coalesce(F.col(id).cast("long"), made_key("text"))


def own_id(name: str = "doc_id") -> Column:
    """The id, null again where it was."""
    return F.when(F.col(name) < NO_ID, F.col(name)).alias(name)


class Keyed(NamedTuple):
    """Rows with a key, whether an id has several texts, and whether a row stands there again."""

    rows: DataFrame
    clash: bool
    again: bool


def keyed(docs: DataFrame, id: str = "doc_id", name: str = "row") -> Keyed:
    """docs with a key, the column ``name``, which docs must not have (see ``unused``).

    Rows with equal keys have equal ids and equal texts: the key is the id, or where the id is null or has several texts, one
    made of id and text. Whether there are such ids is told by a pre-aggregated hash of the text; where there are none, nothing is joined.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    tags = docs.select(given_key(id).alias("own"), F.xxhash64("text").alias("tag")).groupBy("own").agg(F.count("*").alias("n"), F.min("tag").alias("low"), F.max("tag").alias("high"))
    clash, again = (bool(x) for x in tags.agg(F.max(F.col("low") != F.col("high")), F.max(F.col("n") > 1)).first())
    if not clash:
        return Keyed(docs.withColumn(name, given_key(id)), False, again)
    own, several = unused(docs, "own", "clash")
    clashes = cut(tags.filter("low <> high").select(F.col("own").alias(own), F.lit(True).alias(several)))
    rows = text_left_join(docs.withColumn(own, given_key(id)), clashes, [own], F.col("text"))
    return Keyed(rows.withColumn(name, F.when(F.col(several), made_key(own, "text")).otherwise(F.col(own))).drop(own, several), True, again)


def with_roles(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, role) of each document. A text's copies are told by its SHA-256; only hashes are grouped."""
    docs = keyed(docs.select(F.col("doc_id").cast("long"), "text")).rows
    hashed = docs.select("row", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    several = hashed.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    roles = salted_left_join(hashed, several, ["digest"], F.col("row")).filter(F.col("first").isNotNull())
    roles = roles.groupBy("row").agg(F.max(F.when(F.col("first") == F.col("row"), FIRST).otherwise(COPY)).alias("role"))
    return docs.join(roles, "row", "left").select("row", "doc_id", "text", F.coalesce("role", F.lit(SINGLE)).alias("role"))
