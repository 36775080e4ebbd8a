"""A crawl derived from the documents table, with links, redirects, canonicals and structured data, by expressions that Spark and DuckDB share.

Each document is a page attempt of one of seven crawls; what it has besides its text follows from its number k. So a page of every kind
is in every crawl, and crawls grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pages import parse_robots

CRAWLS = 7


def site(k: str) -> str:
    return f"'https://s' || CAST({k} % {CRAWLS} AS STRING) || '.example.com'"


def url_of(k: str) -> str:
    """The URL of page k: the first page of a crawl is its home."""
    text = f"CAST({k} AS STRING)"
    path = " ".join(f"WHEN {k} % 6 = {n} THEN '{start}' || {text}" for n, start in ((1, "/products/p"), (2, "/faq/q"), (3, "/blog/b"), (4, "/a/b/")))
    return f"(CASE WHEN {k} % 29 = 5 THEN 'http://s' || CAST({k} % {CRAWLS} AS STRING) || '.example.com' ELSE {site(k)} END || CASE WHEN {k} < {CRAWLS} THEN '/' {path} ELSE '/p' || {text} END)"


def status(k: str) -> str:
    return f"(CASE WHEN {k} % 11 = 3 THEN 'failed' WHEN {k} % 13 = 4 THEN 'skipped' ELSE 'fetched' END)"


#: Columns of a page, as expressions of its number k and text t.
COLUMNS = {
    "id": "CAST(k AS STRING)",
    "crawl_run_id": f"'c' || CAST(k % {CRAWLS} AS STRING)",
    "brand_id": f"'b' || CAST(k % {CRAWLS} AS STRING)",
    "url": url_of("k"),
    "final_url": f"CASE WHEN {status('k')} = 'skipped' THEN {url_of('(k + 7)')} WHEN k % 17 = 2 THEN {url_of('k')} || '#top' WHEN k % 17 = 3 THEN '' ELSE {url_of('k')} END",
    "status": status("k"),
    "status_code": f"CAST(CASE WHEN {status('k')} <> 'failed' THEN 200 WHEN k % 2 = 0 THEN 404 WHEN k % 3 = 0 THEN NULL ELSE 500 END AS INT)",
    "canonical_url": f"CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN {url_of('(k + 7)')} WHEN 2 THEN '' WHEN 3 THEN {site('k')} || '/nowhere' ELSE {url_of('k')} END",
    "title": "CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'A shared  Title of pages' WHEN 3 THEN 'a shared title OF pages ' WHEN 4 THEN 'Short' ELSE 'A proper title of page ' || CAST(k AS STRING) END",
    "meta_description": "CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN 'The same description' WHEN 2 THEN NULL ELSE 'About page ' || CAST(k AS STRING) END",
    "visible_text": "t",
    "text_hash": "sha256_of_t",
    "word_count": "CAST(length(t) % 400 AS INT)",
    "in_sitemap": "k % 3 = 0",
    "error": "CASE WHEN k % 11 = 3 THEN 'no answer' END",
}
HOPS = f"{site('k')} || '/old' || CAST(k AS STRING)", f"{site('k')} || '/mid' || CAST(k AS STRING)"
#: Links of a page, each with the test that it has it.
LINKS = (
    ("k % 10 <> 9", url_of(f"(k % {CRAWLS})")),
    ("k % 10 <> 9 AND k % 5 <> 0", url_of("(k + 7)")),
    ("k % 10 <> 9 AND k % 5 <> 0", url_of("(k + 14)") + " || '#part'"),
    ("k % 10 <> 9 AND k % 3 = 1", f"{site('k')} || '/old' || CAST(k + 7 AS STRING)"),
    ("k % 10 <> 9 AND k % 4 = 1", url_of("(k + 7)") + " || '/'"),
)
HEADINGS = {0: [], 1: [(1, "a")], 2: [(1, "a"), (3, "b")], 3: [(1, "a"), (2, "b"), (3, "c"), (1, "d")], 4: [(2, "x")], 5: [(1, "a"), (2, "b"), (4, "c")]}
ORGANIZATION, PRODUCT, CRUMBS = '{"@type":"Organization","name":"Acme"}', '{"@graph":[{"@type":["https://schema.org/Product"],"name":"P"}]}', '{"@type":"BreadcrumbList"}'
FAQ = '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"%s","acceptedAnswer":{"text":"<b>%s</b>"}}]}'
#: Structured data by k % 10: whether the block is valid, its text, and an error.
BLOCKS = {
    0: [], 1: [(False, "{", "bad")], 2: [(True, ORGANIZATION, None)], 3: [(True, PRODUCT, None)], 4: [(True, FAQ % ("the", "of"), None)], 5: [(True, FAQ % ("der", "die"), None), (True, ORGANIZATION, None)],
    6: [(True, CRUMBS, None)], 7: [(True, '{"@type":"FAQPage","mainEntity":[]}', None)], 8: [(True, ORGANIZATION, None), (False, "{", "bad")], 9: [(True, PRODUCT, None), (True, CRUMBS, None)],
}
DIRECTIVES = {0: ["robots: noindex, follow"], 1: ["googlebot: NONE"], 2: ["robots: index"], 3: ["robots: noindexed"]}
PUBLISHED = {0: [], 1: ["soon"], 2: ["2024-01-02"], 3: ["2024-01-02"], 4: ["2024-01-02"]}
MODIFIED = {0: ["2023-02-01"], 1: ["2024-03-01"], 2: []}
ROBOTS = "User-agent: *\nDisallow: /faq\nAllow: /faq/q2\n\nUser-agent: GPTBot\nDisallow: /\n"
#: llms.txt of each crawl: status, text, whether it was cut off, error; None where it wasn't asked for.
LLMS = {0: None, 1: (200, "# Acme\n[docs](https://a.com)", False, None), 2: (200, "<html>", False, None), 3: (404, "", False, None), 4: (200, "# Acme", True, None), 6: (None, None, False, "timeout")}


def _pick(by: str, n: int, cases: dict[int, Column], other: Column) -> Column:
    out = other
    for k, value in cases.items():
        out = F.when(F.col(by) % n == k, value).otherwise(out)
    return out


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page attempts of seven crawls, a document each."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.sha2("text", 256).alias("sha256_of_t"))
    k = F.col("k")
    hop = lambda n, code, to: F.struct(F.expr(HOPS[n]).alias("url"), F.lit(code).alias("status"), to.alias("destination"))
    hops = F.when(k % 17 == 6, F.array(hop(0, 301, F.expr(HOPS[1])), hop(1, 302, F.expr(url_of("k"))))).when(k % 17 == 7, F.array(hop(0, 301, F.expr(url_of("k"))))).otherwise(F.array().cast("array<struct<url:string,status:int,destination:string>>"))
    links = F.filter(F.array(*(F.expr(f"CASE WHEN {test} THEN {url} END") for test, url in LINKS)), lambda x: x.isNotNull())
    heads = lambda rows: F.array(*(F.struct(F.lit(n).alias("level"), F.lit(text).alias("text")) for n, text in rows)).cast("array<struct<level:int,text:string>>")
    blocks = lambda rows: F.array(*(F.struct(F.lit(v).alias("valid"), F.lit(text).alias("value"), F.lit(e).cast("string").alias("error")) for v, text, e in rows)).cast("array<struct<valid:boolean,value:string,error:string>>")
    link = lambda raw, url: F.struct(raw.alias("raw"), url.alias("url"))
    own = F.expr(COLUMNS["canonical_url"])
    candidates = F.when(k % 8 == 2, F.array(link(own, own), link(own, own))).when(k % 8 == 3, F.array(link(F.lit(""), F.lit(None).cast("string")))).otherwise(F.array(link(own, own)))
    kind = F.when(k < CRAWLS, "home").when(k % 6 == 3, "editorial").when(k % 6 == 1, "product").when(k % 6 == 2, "faq").otherwise("other")
    signals = F.struct(
        kind.alias("page_kind"), candidates.alias("canonical_candidates"), F.when(k % 4 == 0, _texts([])).otherwise(_texts(["x"])).alias("authors"), _pick("k", 5, {n: _texts(v) for n, v in PUBLISHED.items()}, _texts([])).alias("published_dates"),
        _pick("k", 3, {n: _texts(v) for n, v in MODIFIED.items()}, _texts([])).alias("modified_dates"), F.when((k % CRAWLS == 1) & (k % 4 == 1), _texts(["mailto:x"])).otherwise(_texts([])).alias("contact_signals"),
        F.when((k % CRAWLS).isin(2, 3), _texts(["Acme"])).otherwise(_texts([])).alias("identity_signals"), (k % 3).cast("int").alias("script_count"), F.when(k % 20 == 7, "enable javascript").alias("javascript_notice"), F.lit("").alias("main_text"),
    )
    return rows.select(
        *(F.expr(e).alias(c) for c, e in COLUMNS.items()), hops.alias("redirects"), links.alias("internal_links"), F.when(k % 4 == 0, _texts(["https://other.com/"])).otherwise(_texts([])).alias("external_links"), _pick("k", 6, {n: heads(v) for n, v in HEADINGS.items()}, heads([])).alias("headings"),
        _pick("k", 10, {n: blocks(v) for n, v in BLOCKS.items()}, blocks([])).alias("structured_data"), _pick("k", 12, {n: _texts(v) for n, v in DIRECTIVES.items()}, _texts([])).alias("robots_directives"), F.when(k % 16 != 15, signals).alias("technical_signals"),
        (F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("fetched_at"),
    )


def crawl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven crawls, as far as documents reach."""
    rows, k = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % CRAWLS).alias("k")).distinct(), F.col("k")
    none = _texts([])
    discovery = F.struct(
        F.expr(site("k")).alias("origin"), F.when(k < 2, F.array(F.concat(F.expr(site("k")), F.lit("/sitemap.xml")))).otherwise(none).alias("sitemap_urls"), F.when(k == 1, F.array(F.expr(url_of("(k + 7)")), F.expr(url_of("(k + 21)")))).otherwise(none).alias("page_urls"),
        F.when(k == 2, _texts(["slow", "slow"])).otherwise(none).alias("warnings"), (k == 3).alias("truncated"),
    )
    kind = "struct<url:string,status:int,text:string,truncated:boolean,error:string>"
    llms = F.lit(None).cast(kind)
    for n, value in LLMS.items():
        if value:
            llms = F.when(k == n, F.struct(F.lit("u").alias("url"), *(F.lit(v).cast(t).alias(c) for v, c, t in zip(value, ("status", "text", "truncated", "error"), ("int", "string", "boolean", "string"), strict=True)))).otherwise(llms)
    signals = F.when(k != 5, F.struct(F.array().cast("array<struct<origin:string,url:string,status:int,text:string>>").alias("robots"), llms.alias("llms")))
    return rows.select(
        F.concat(F.lit("c"), k).alias("id"), F.concat(F.lit("b"), k).alias("brand_id"), F.when(k == 4, "failed").otherwise("completed").alias("status"), discovery.alias("discovery"), signals.alias("site_signals"),
        F.lit(10).alias("pages_discovered"), F.when(k == 6, 9).otherwise(10).alias("pages_processed"),
    )


def robots_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of the crawls c0 to c3."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % CRAWLS).alias("k")).distinct().filter("k < 4")
    return parse_robots(rows.select(F.concat(F.lit("c"), F.col("k")).alias("crawl_run_id"), F.expr(site("k")).alias("origin"), F.lit(ROBOTS).alias("text")))
