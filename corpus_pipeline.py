"""The corpus pipeline: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.bpe import encode_documents
from sightline.llm.common import cut, shared_folder, table, text_left_join, unused
from sightline.llm.copies import keyed
from sightline.llm.decontaminate import findings
from sightline.llm.near_dedup import verdicts
from sightline.llm.pii import KEY, pseudonymise
from sightline.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host isn't rejected; see ``quality_rules`` for nulls, long texts, repeated rows and ties.

    A document is told by its key (see ``keyed``) and host, so null and repeated doc_ids don't matter. Other columns stay as they are, whatever
    their names. An empty table gives no rows.
    """
    key, host = unused(docs, "row", "host")
    rows = keyed(docs, name=key).rows.withColumn(host, F.coalesce("source", F.lit("")).cast("string"))
    kept = quality_rules(rows.select(F.col(key).alias("doc_id"), "text", "source")).filter("kept")
    kept = kept.select(F.col("doc_id").alias(key), F.col("host").alias(host)).distinct()
    return rows.join(kept, [key, host], "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, or if none has one, any of the group's.

    Of repeated rows one stays. Null and empty texts are no duplicates of each other and all stay; see ``near_duplicates`` for the other cases.
    Other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    key, several = unused(docs, "row", "again")
    told = keyed(docs, name=key)
    rows = told.rows
    if told.again:  # of rows that nothing tells apart but their other columns one stays, where they have words
        words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        again = cut(rows.filter(words).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit(True).alias(several)))
        marked = text_left_join(rows, again, [key], F.col("text"))
        rows = marked.filter(F.col(several).isNull()).unionByName(marked.filter(several).dropDuplicates([key])).drop(several)
    kept = verdicts(told._replace(rows=told.rows.select(F.col(key).alias("row"), "doc_id", "text"))).filter("chosen").select(F.col("row").alias(key)).distinct()
    return rows.join(kept, key, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 75 % of every benchmark item's shingles; see ``contained_items`` for nulls, long texts and repeated ids.

    Other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    (key,) = unused(docs, "row")
    rows = keyed(docs, name=key).rows
    found = findings(rows.select(F.col(key).alias("row"), "doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("row").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; n_chars counts the new text, and is null where that is. See ``pseudonymise`` for the odd cases.

    Other columns stay as they are, whatever their names.
    """
    new = pseudonymise(docs, KEY)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of what they decode to. See ``encode_documents`` for the odd cases."""
    import public_tokenizers

    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", pii), ("byte-level BPE", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is Parquet in the shared folder. An empty table goes through as it is."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: SQL can express neither the Feistel permutation nor BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None
