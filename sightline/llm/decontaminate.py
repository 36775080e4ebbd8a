"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .copies import keyed

WIDTH, SHARE = 5, 0.75
#: Bytes up to which a side whose bytes were counted is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def worded(df: DataFrame, *keys: str) -> DataFrame:
    """The keys and the words of ``text`` as a column, so that they are split once and not for each shingle."""
    return df.select(*keys, word_list(F.col("text")).alias("words"))


def shingle_list(words: Column, of) -> Column:
    """``of(list of five columns)`` for each five words in a row; fewer words are one shingle, none are none."""
    n = F.size(words)
    return (
        F.when(n >= WIDTH, F.transform(F.slice(words, F.lit(1), n - (WIDTH - 1)), lambda w, i: of([w, *(F.get(words, i + k) for k in range(1, WIDTH))])))
        .when(n > 0, F.array(of([F.get(words, F.lit(k)) for k in range(WIDTH)])))
        .otherwise(F.array().cast("array<string>").cast(_kind(of)))
    )


def _kind(of) -> str:
    return "array<bigint>" if of is _hashed else "array<string>"


def _hashed(five: list[Column]) -> Column:
    return F.xxhash64(*five)


def _joined(five: list[Column]) -> Column:
    return F.concat_ws(" ", *five)


def sized(df: DataFrame) -> DataFrame:
    """df, cut and measured, to be broadcast if it is small and joined by shuffle otherwise. Its columns are numbers and strings."""
    df = cut(df)
    width = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        width = width + F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else width
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common, containment) where a document holds 75 % of an item's shingles or more.

    Items are partitioned by size into powers of two. The MinHash sketch of an item are its smallest shingle hashes; the
    partition's largest size sets how many: with k = size - ceil(0.75 size) + 1 of them no document that holds 75 % can miss
    them all, however long it is, so no candidate is lost. (A signature of fixed length on the document's side would need
    thousands of hashes: a 40-word item in a 20,000-word document has a Jaccard similarity near 0.002.) Documents shorter than
    an item's 75 % are left out, and the others are verified by exact containment of the shingles themselves.

    Null or empty texts and items have no shingles and are never found; a text of fewer than five words is one shingle, a very long one is
    read whole. A null doc_id or item_id is reported as null, each text of it by itself, and so is each text of an id that has several;
    repeated rows count once. No order of rows matters, so there are no ties. Empty tables give no rows; other columns are ignored.
    """
    return findings(keyed(docs.select("doc_id", "text")).rows, items).drop("row")


def findings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contained_items`` of documents with their ``row`` (see ``keyed``), which is never null."""
    docs = docs.select("row", "doc_id", "text")
    items = keyed(items.select("item_id", "text"), "item_id").rows.withColumnRenamed("row", "item")
    items = worded(items, "item", "item_id").select("item", "item_id", F.array_distinct(shingle_list(F.col("words"), _joined)).alias("shingles"))
    items = cut(items.filter(F.size("shingles") > 0).withColumn("n_item_shingles", F.size("shingles").cast("long")).dropDuplicates(["item"]))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item_shingles")) + 1) - 1
    hashes = F.array_sort(F.transform("shingles", lambda s: _hashed([F.get(F.split(s, " "), F.lit(k)) for k in range(WIDTH)])))
    sketch = F.slice(hashes, F.lit(1), (largest - F.ceil(SHARE * largest) + 1).cast("int"))
    need = F.ceil(SHARE * F.col("n_item_shingles"))
    sketches = sized(items.select(need.alias("need"), F.explode(sketch).alias("hash")).groupBy("hash").agg(F.min("need").alias("need")))

    # explode_outer: for explode() the optimizer pushes a test of the list's size down to the scan and splits the text for each shingle
    probes = worded(docs, "row").select("row", shingle_list(F.col("words"), _hashed).alias("hashes"))
    probes = probes.select("row", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("hash"))
    candidates = sized(probes.join(sketches, "hash").filter("n >= need").select("row").distinct())

    held = worded(docs.join(candidates, "row", "left_semi"), "row", "doc_id")
    held = held.select("row", "doc_id", F.explode_outer(F.array_distinct(shingle_list(F.col("words"), _joined))).alias("shingle"))
    wanted = sized(items.select("item", "item_id", "n_item_shingles", F.explode("shingles").alias("shingle")))
    common = held.join(wanted, "shingle").groupBy("row", "doc_id", "item", "item_id", "n_item_shingles").agg(F.count_distinct("shingle").alias("n_common"))
    common = common.filter(100 * F.col("n_common") >= 75 * F.col("n_item_shingles")).withColumn("containment", F.col("n_common") / F.col("n_item_shingles"))
    return common.select("row", "doc_id", "item_id", "n_item_shingles", "n_common", "containment")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
items AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM items),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_common, count(*) / n_item_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles
HAVING 100 * count(*) >= 75 * n_item_shingles
"""
