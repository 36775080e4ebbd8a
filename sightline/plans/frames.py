"""The library's tables, derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.visibility import STAGE_WEIGHTS
from ..sources.pages import extract_pages
from ..storage import stored

#: Words of the synthetic languages that stand for brands: id, name, host, kind and aliases.
BRANDS = (("b1", "The", "the.example.com", "target", ["the", "of"]), ("b2", "Que", "que.example.org", "competitor", ["que", "los"]), ("b3", "Und", "und.example.net", "competitor", ["und"]), ("b4", "C++", "cpp.example.io", "competitor", ["C++"]))
EXPERIMENTS = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers of seven experiments."""
    stage = F.element_at(F.array(*map(F.lit, STAGE_WEIGHTS)), (F.col("conv_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") % EXPERIMENTS).cast("string").alias("experiment_id"), F.concat_ws("-", "conv_id", "turn").alias("answer_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ordinal"),
        F.when(F.col("conv_id") % 11 == 0, "failed").otherwise("completed").alias("status"), F.col("text").alias("raw"), (F.col("conv_id") % 13 == 0).alias("truncated"), (F.col("conv_id") % 17 != 0).alias("analyzed"),
        (F.col("conv_id") % 19 == 0).alias("refused"), stage.alias("stage"), F.concat(F.lit("t"), F.col("conv_id") % 3).alias("type"), F.concat(F.lit("p"), F.col("conv_id") % 4).alias("persona_id"),
        F.concat(F.lit("prov"), F.col("conv_id") % 2).alias("provider"), F.concat(F.lit("m"), F.col("turn") % 2).alias("model"),
    )


def brands(spark: SparkSession) -> DataFrame:
    rows = [(str(e), *b) for e in range(EXPERIMENTS) for b in BRANDS]
    return spark.createDataFrame(rows, "experiment_id string, brand_id string, name string, host string, kind string, aliases array<string>")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as citations of answers."""
    got = answers(spark, sf_dir).select("experiment_id", "answer_id", "ordinal")
    urls = read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url")
    from ..functions.urls import domain_key

    rows = got.join(urls, (F.col("ordinal") / 100).cast("long") == F.col("pos"))
    return rows.select("experiment_id", "answer_id", "pos", "url", domain_key(F.col("url")).alias("domain"), F.when(F.col("pos") % 2 == 0, "provider").otherwise("answer_text").alias("source"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions of five projects."""
    stage = F.element_at(F.array(*map(F.lit, STAGE_WEIGHTS)), (F.col("conv_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 5).cast("string").alias("project_id"), "text", stage.alias("stage"),
        F.concat(F.lit("p"), F.col("conv_id") % 4).alias("persona_id"), (F.col("conv_id") % 5 + 1).cast("int").alias("intent"), (F.col("turn") % 3 == 0).alias("branded"), F.when(F.col("conv_id") % 10 == 0, "archived").otherwise("active").alias("status"),
        (F.col("conv_id") % 4 == 0).alias("selected"), F.lit("Unspecified").alias("geography"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts of their brand: size by type and container-free name."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("1").alias("project_id"), F.col("p_brand").alias("brand_id"), F.lit("product").alias("category"), F.col("p_type").alias("subject"), F.lit("Size").alias("attribute"),
        F.col("p_size").cast("string").alias("value"), F.when(F.col("p_partkey") % 9 == 0, "rejected").otherwise("unreviewed").alias("status"), (F.col("p_partkey") * 7919 % 10007).alias("updated_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "error", "failed").otherwise("validated").alias("status"), F.col("event_type").alias("cache_key"),
        F.col("value").alias("cost"), (F.col("value") * 100).cast("long").alias("input_tokens"), F.length("props").cast("long").alias("output_tokens"), F.col("ts").alias("created_at"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched pages of the crawl of their source."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("crawl_run_id"), F.col("doc_id").alias("id"), F.col("text").alias("visible_text"), F.sha2("text", 256).alias("text_hash"))


def crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(crawls, pages) of the pages table: a crawl for each host, its pages read from raw HTML."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    raw = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), host.alias("crawl_run_id"), F.concat(F.lit("brand-"), host).alias("brand_id"), "url", F.col("url").alias("final_url"), F.col("url").alias("scope"), "html")
    pages = stored(extract_pages(raw))
    none = F.array().cast("array<string>")
    pages = pages.select("*", F.lit("fetched").alias("status"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.array().cast("array<struct<url:string,status:int,destination:string>>").alias("redirects"), F.lit(False).alias("in_sitemap"), F.lit(None).cast("string").alias("error"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"))
    urls = read(spark, sf_dir, "pages").select(host.alias("id")).distinct()
    discovery = F.struct(F.concat(F.lit("https://"), F.col("id")).alias("origin"), none.alias("sitemap_urls"), none.alias("page_urls"), none.alias("warnings"), F.lit(False).alias("truncated"))
    signals = F.lit(None).cast("struct<robots:array<struct<origin:string,url:string,status:int,text:string>>,llms:struct<url:string,status:int,text:string,truncated:boolean,error:string>>")
    crawls = urls.select("id", F.concat(F.lit("brand-"), F.col("id")).alias("brand_id"), F.lit("completed").alias("status"), discovery.alias("discovery"), signals.alias("site_signals"), F.lit(0).alias("pages_discovered"), F.lit(0).alias("pages_processed"))
    return crawls, pages
