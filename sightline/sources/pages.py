"""Raw HTML and fetch logs to page rows; sitemaps, robots policies, imported answers and stored tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.htmltree import PageTree
from ..functions.jsonld import load_block, summary
from ..functions.urls import PAGE_KINDS, canonical, is_page_candidate, same_domain, url_key
from ..storage import stored

PAGE_SCHEMA = (
    "id string, crawl_run_id string, brand_id string, url string, final_url string, canonical_url string, title string, meta_description string, headings array<struct<level:int,text:string>>, "
    "visible_text string, text_hash string, word_count int, language string, internal_links array<string>, external_links array<string>, structured_data array<struct<valid:boolean,value:string,error:string>>, "
    "robots_directives array<string>, technical_signals struct<page_kind:string,canonical_candidates:array<struct<raw:string,url:string>>,authors:array<string>,published_dates:array<string>,modified_dates:array<string>,"
    "contact_signals:array<string>,identity_signals:array<string>,script_count:int,javascript_notice:string,main_text:string>"
)
#: Links of a page that are kept.
MOST_LINKS = 5000


#: White space of page texts (fixed values: what scripts on the web take for it).
_SPACES = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN, _EDGES = re.compile(f"[{_SPACES}]+"), re.compile(f"^[{_SPACES}]+|[{_SPACES}]+$")


def _clean(text: str) -> str:
    return _RUN.sub(" ", text).strip(" ")


def extract(html: str | None, url: str, scope: str, header_robots: list[str] | None = None) -> dict:
    """Page columns of one HTML text at its URL; links to the scope's site are internal. header_robots: robots rules of the answer's headers.

    Null and empty texts give empty columns; whatever the text holds, it gives columns.
    """
    page = PageTree(html or "")
    base = canonical(page.base, url) if page.base else url
    base = base or url
    values, data = [], []
    for block in page.blocks:
        good, value = load_block(block["text"])
        values += [value] * good
        data.append({"valid": good, "value": block["text"] if good else block["text"][:5000], "error": None if good else "Invalid JSON-LD syntax"})
    ld = summary(values)
    texts = lambda entries: [t for t in (_clean(e["text"]) for e in entries) if t]
    meta = lambda key, name: [v for v in (_clean(m.get("content", "")) for m in page.metas if m[key] == name) if v]
    dates = lambda name: texts(d for d in page.dates if d["property"] == name)
    internal, external = {}, {}
    host = _host_key(scope)
    for href in page.anchors:
        if len(internal) + len(external) >= MOST_LINKS:
            break
        if link := canonical(href, base):
            (internal if _host_key(link) == host else external)[link] = None
    path = re.sub(r"^https?://[^/?#]*", "", url).split("?")[0].split("#")[0] or "/"
    article = bool({"Article", "BlogPosting", "NewsArticle", "TechArticle"} & set(ld["types"]))
    kind = "home" if path == "/" else "editorial" if article else next((k for k, p in PAGE_KINDS if re.search(p, path, re.I)), "other")
    canonicals = [a.get("href", "") for a in page.links if "canonical" in a.get("rel", "").lower().split()]
    unique = lambda xs: list(dict.fromkeys(x for x in xs if x))
    visible, notice = _clean(page.text), "".join(n["text"] for n in page.notices)
    robots = [f"{m['raw']}: {m.get('content', '')}" for m in page.metas if m["name"] in ("robots", "googlebot", "bingbot")]
    return {
        "canonical_url": canonical(canonicals[0], base) if canonicals and canonicals[0] else None,
        "title": _clean(page.titles[0]["text"]) if page.titles else "",
        "meta_description": next((_EDGES.sub("", m.get("content", "")) for m in page.metas if m["name"] == "description"), ""),
        "headings": [{"level": h["level"], "text": _clean(h["text"])} for h in page.headings],
        "visible_text": visible,
        "text_hash": hashlib.sha256(visible.encode()).hexdigest(),
        "word_count": len(visible.split(" ")) if visible else 0,
        "language": page.lang or None,
        "internal_links": list(internal),
        "external_links": list(external),
        "structured_data": data,
        "robots_directives": robots + [f"X-Robots-Tag: {v}" for v in header_robots or [] if v is not None],
        "technical_signals": {
            "page_kind": kind,
            "canonical_candidates": [{"raw": h, "url": canonical(h, base) if h else None} for h in canonicals],
            "authors": unique([*meta("name", "author"), *texts(page.authors), *ld["authors"]]),
            "published_dates": unique([*meta("property", "article:published_time"), *dates("datePublished"), *ld["published"]]),
            "modified_dates": unique([*meta("property", "article:modified_time"), *dates("dateModified"), *ld["modified"]]),
            "contact_signals": [h[:500] for h in page.anchors if re.search(r"^(?:mailto:|tel:)|(?:^|/)contact(?:[/.?#]|$)", h, re.I)][:30],
            "identity_signals": [*meta("property", "og:site_name"), *ld["organizations"], *(h for h in page.anchors if re.search(r"(?:^|/)about(?:[/.?#]|$)", h, re.I))][:30],
            "script_count": page.scripts,
            "javascript_notice": _clean(notice)[:500] if re.search(r"(?:enable|turn on|requires?)\s+javascript", notice, re.I) else None,
            "main_text": _clean(page.main) or visible,
        },
    }


def _host_key(url: str) -> str:
    return re.sub(r"^https?://(?:www\.)?([^/:?#]*).*$", r"\1", canonical(url) or "", flags=re.S)


#: Pages of raw HTML that are parsed at once.
BATCH_PAGES = 200


def extract_pages(raw: DataFrame) -> DataFrame:
    """Page columns of raw rows: id, crawl_run_id, brand_id, url, final_url, scope, html, and header_robots if there. Narrow: HTML isn't shuffled.

    What goes to a worker at once is bounded by the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``;
    what comes back by BATCH_PAGES.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_PAGES):
                rows = []
                for i in range(low, min(low + BATCH_PAGES, batch.num_rows)):  # one HTML text at a time as Python's
                    id, crawl, brand, url, final, scope, html, robots = (batch.column(k)[i].as_py() for k in range(8))
                    at = final or url or ""
                    rows.append({"id": id, "crawl_run_id": crawl, "brand_id": brand, "url": url, "final_url": final} | extract(html, at, scope or at, robots))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(PAGE_SCHEMA))
    robots = F.col("header_robots") if "header_robots" in raw.columns else F.lit(None).cast("array<string>").alias("header_robots")
    return raw.select("id", "crawl_run_id", "brand_id", "url", "final_url", "scope", "html", robots).mapInArrow(work, PAGE_SCHEMA)


def classify_fetches(log: DataFrame) -> DataFrame:
    """A fetch log with status and error: skipped where robots forbid it, where it isn't HTML or was fetched before, failed by HTTP status.

    log: crawl_run_id, seq, url, final_url, allowed, status_code, content_type, error.
    """
    good = F.col("status_code").between(200, 299)
    html = F.coalesce(F.lower("content_type").rlike(r"^\s*(?:text/html|application/xhtml\+xml)"), F.lit(False))
    state = lambda s, e: F.struct(F.lit(s).alias("s"), e.cast("string").alias("e"))
    status = (
        F.when(~F.col("allowed"), state("skipped", F.lit("Disallowed by robots.txt")))
        .when(F.col("status_code").isNull(), state("failed", F.coalesce("error", F.lit("No response"))))
        .when(~good, state("failed", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))))
        .when(~html, state("skipped", F.lit("Not HTML")))
        .otherwise(state("fetched", F.lit(None)))
    )
    rows = log.withColumn("_s", status).withColumn("_key", url_key(F.coalesce("final_url", "url")))
    again = F.row_number().over(Window.partitionBy("crawl_run_id", "_key", F.col("_s.s")).orderBy("seq"))
    rows = rows.withColumn("_again", (F.col("_s.s") == "fetched") & (again > 1))
    # a URL that is asked for after a fetch ended on it isn't fetched either
    finals = rows.filter("_s.s = 'fetched' AND NOT _again").select("crawl_run_id", F.col("_key").alias("_asked"), F.col("seq").alias("_at"))
    rows = rows.withColumn("_asked", url_key(F.col("url"))).join(finals, ["crawl_run_id", "_asked"], "left")
    repeat = F.col("_again") | (F.col("allowed") & F.coalesce(F.col("_at") < F.col("seq"), F.lit(False)))
    return rows.withColumn("status", F.when(repeat, "skipped").otherwise(F.col("_s.s"))).withColumn("error", F.when(repeat, "Already fetched").otherwise(F.col("_s.e"))).drop("_s", "_key", "_again", "_asked", "_at")


#: Characters of a sitemap text that are parsed at once.
XML_PIECE = 1 << 16


def sitemap_urls(xml: str | None) -> list[tuple[str, bool]]:
    """(loc, whether it is a sitemap) of a sitemap text, whatever its namespaces; none of a text with a DTD or that isn't such XML.

    Entries are dropped as they end, so only their locs are held.
    """
    if not xml or re.search(r"<!(?:DOCTYPE|ENTITY)", xml, re.I):
        return []
    xml, found, open_ = xml.strip(), [], []
    parser, name = ElementTree.XMLPullParser(("start", "end")), lambda e: e.tag.rpartition("}")[2]
    try:
        for low in range(0, len(xml), XML_PIECE):
            parser.feed(xml[low : low + XML_PIECE])
            if low + XML_PIECE >= len(xml):
                parser.close()
            for event, element in parser.read_events():
                if event == "start":
                    open_.append(element)
                    continue
                open_.pop()
                wanted = {"urlset": "url", "sitemapindex": "sitemap"}.get(name(open_[0])) if open_ else None
                if len(open_) == 2 and name(open_[1]) == wanted and name(element) == "loc" and not len(element):
                    found.append(((element.text or "").strip(), wanted == "sitemap"))
                elif len(open_) == 1:
                    open_[0].clear()
    except ElementTree.ParseError:
        return []
    return found


def _entries(files: DataFrame, *keys: str) -> DataFrame:
    """(keys.., pos, url, is_index) of the sitemap texts in the column xml, URLs by key."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                yield pd.DataFrame([(*row[:-1], k, *found) for k, found in enumerate(sitemap_urls(row[-1]))], columns=[*keys, "pos", "url", "is_index"])

    rows = files.select(*keys, "xml").mapInPandas(work, ", ".join(f"{k} string" for k in keys) + ", pos int, url string, is_index boolean")
    return rows.withColumn("url", url_key(F.col("url")))


def read_sitemaps(files: DataFrame, home: str = "home") -> DataFrame:
    """(crawl_run_id, url, is_index) in sitemap texts: pages of the site and further sitemaps, each once. Files with a DTD or broken XML are left out.

    files: crawl_run_id, xml and the site's home URL. ``follow_sitemaps`` reads those that others name.
    """
    rows = _entries(files.withColumn("home", F.col(home)), "crawl_run_id", "home")
    return rows.filter(same_domain(F.col("url"), F.col("home")) & (F.col("is_index") | is_page_candidate(F.col("url")))).select("crawl_run_id", "url", "is_index").distinct()


def follow_sitemaps(files: DataFrame, starts: DataFrame, most_files: int = 12, most_urls: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(pages, visited) of each crawl's sitemaps: (crawl_run_id, url, place) and (crawl_run_id, url, place, read).

    files: crawl_run_id, url, xml, the saved texts. starts: crawl_run_id, url, seen (order), home. From the starts on, sitemaps that an index names
    are visited breadth first, each once, so nested ones are followed and cycles end; of other sites' only the visit counts. A crawl visits
    ``most_files`` and gives its first ``most_urls`` candidate pages, in order of file and entry. ``read`` tells whether a saved text was there.

    Each text is parsed once, before the first round. A round finds what all crawls visit next; there are as many as the deepest nesting, and
    ``most_files`` at most.
    """
    texts = files.select("crawl_run_id", url_key(F.col("url")).alias("file"), "xml").dropDuplicates(["crawl_run_id", "file"])
    entries, saved = stored(_entries(texts, "crawl_run_id", "file")), stored(texts.select("crawl_run_id", F.col("file").alias("url"), (F.length("xml") > 0).alias("read")))
    homes = starts.groupBy("crawl_run_id").agg(F.min("home").alias("home"))
    queue = starts.select("crawl_run_id", url_key(F.col("url")).alias("url"), F.struct(F.lit(0).alias("after"), F.col("seen").cast("int").alias("pos")).alias("order"))
    visited = None
    for _ in range(most_files):
        new = queue.groupBy("crawl_run_id", "url").agg(F.min("order").alias("order"))
        before = F.lit(0)
        if visited is not None:
            new = new.join(visited.select("crawl_run_id", "url"), ["crawl_run_id", "url"], "left_anti").join(visited.groupBy("crawl_run_id").agg(F.max("place").alias("so_far")), "crawl_run_id", "left")
            before = F.coalesce("so_far", F.lit(0))
        place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("order", "url"))
        new = new.withColumn("k", place).filter(F.col("k") <= most_files).select("crawl_run_id", "url", (before + F.col("k")).alias("place")).filter(F.col("place") <= most_files)
        new = stored(new.join(homes, "crawl_run_id").select("crawl_run_id", "url", "place", same_domain(F.col("url"), F.col("home")).alias("own"), "home"))
        if new.isEmpty():
            break
        visited = new if visited is None else visited.unionByName(new)
        named = new.filter("own").select("crawl_run_id", F.col("url").alias("file"), F.col("place").alias("after")).join(entries.filter("is_index"), ["crawl_run_id", "file"])
        queue = named.select("crawl_run_id", "url", F.struct("after", "pos").alias("order"))
    if visited is None:
        visited = starts.limit(0).select("crawl_run_id", "url", F.lit(0).alias("place"), F.lit(True).alias("own"), "home")
    found = visited.filter("own").select("crawl_run_id", F.col("url").alias("file"), "place", "home").join(entries.filter("NOT is_index"), ["crawl_run_id", "file"])
    found = found.filter(same_domain(F.col("url"), F.col("home")) & is_page_candidate(F.col("url"))).groupBy("crawl_run_id", "url").agg(F.min(F.struct("place", "pos")).alias("order"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("order", "url"))).filter(F.col("place") <= most_urls)
    state = visited.join(saved, ["crawl_run_id", "url"], "left").select("crawl_run_id", "url", "place", (F.col("own") & F.coalesce("read", F.lit(False))).alias("read"))
    return found.select("crawl_run_id", "url", "place"), state


def robots_rules(text: str) -> list[tuple[str, bool, str, int]]:
    """(agent, allow, pattern, length) of a policy; an empty disallow allows all."""
    rules, agents, said = [], [], True
    for line in (text or "").splitlines():
        field, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
        field = field.lower()
        if field == "user-agent":
            agents, said = ([value] if said else [*agents, value]), False
        elif field in ("allow", "disallow"):
            said = True
            if value:
                pattern = "^" + re.sub(r"\\\*", ".*", re.escape(value.removesuffix("$"))) + ("$" if value.endswith("$") else "")
                rules += [(a, field == "allow", pattern, len(value)) for a in agents]
            else:
                rules += [(a, True, "^", 0) for a in agents]
    return rules


def parse_robots(policies: DataFrame) -> DataFrame:
    """Rule rows of policies: crawl_run_id, origin, agent, allow, pattern (a regular expression for the path) and length."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, o, *rule) for c, o, text in batch[["crawl_run_id", "origin", "text"]].itertuples(index=False, name=None) for rule in robots_rules(text)]
            yield pd.DataFrame(rows, columns=["crawl_run_id", "origin", "agent", "allow", "pattern", "length"])

    return policies.mapInPandas(work, "crawl_run_id string, origin string, agent string, allow boolean, pattern string, length int")


ANSWER_COLUMNS = ("provider", "model", "question", "answer", "citation_urls", "observed_at", "notes")
REQUIRED = ("provider", "question", "answer", "observed_at")


def read_answer_csv(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of imported answers: quoted cells may hold newlines and doubled quotes. A wrong header is an error; a wrong row is one if strict."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "enforceSchema": False}
    header = [c.removeprefix("﻿") for c in spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).columns]
    if unknown := [c for c in header if c not in ANSWER_COLUMNS]:
        raise ValueError(f"unknown or repeated columns: {unknown}")
    if missing := [c for c in REQUIRED if c not in header]:
        raise ValueError(f"missing columns: {missing}")
    rows = spark.read.options(**options | {"enforceSchema": True}).schema(", ".join(f"{c} string" for c in header) + ", _corrupt string").csv(path)
    rows = rows.select(*header, *(F.lit(None).cast("string").alias(c) for c in ANSWER_COLUMNS if c not in header), "_corrupt")
    blank = F.concat(*(F.coalesce(c, F.lit("")) for c in header)) == ""
    rows = rows.filter(~blank | F.col("_corrupt").isNotNull())
    # Spark doesn't read the column of wrong rows alone
    wrong = F.col("_corrupt").isNotNull() & (F.length(F.concat_ws("", *header, "_corrupt")) >= 0)
    if strict and not rows.filter(wrong).isEmpty():
        raise ValueError("the file has wrong rows")
    return rows.filter(~wrong).drop("_corrupt"), rows.filter(wrong)


def normalize_imports(rows: DataFrame, questions: DataFrame, as_of: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected): typed rows matched to the library's questions by their words, with defaults where none matches.

    If strict, a row that would be rejected is an error, so an import is taken whole or not at all.
    """
    seen = F.try_to_timestamp("observed_at")
    rows = rows.withColumn("_seen", seen).withColumn("_why", F.when(F.length(F.trim(F.coalesce("answer", F.lit("")))) == 0, "empty answer").when(seen.isNull(), "unreadable time").when(seen > F.lit(as_of).cast("timestamp"), "time in the future"))
    if strict and not rows.filter("_why IS NOT NULL").isEmpty():
        raise ValueError("the import has rows that can't be taken")
    library = questions.groupBy(F.lower(F.trim("text")).alias("_q")).agg(F.min(F.struct("id", "stage", "type", "persona_id", "geography", "intent")).alias("q"))
    good = rows.filter("_why IS NULL").withColumn("_q", F.lower(F.trim("question"))).join(library, "_q", "left")
    either = lambda c, d: F.coalesce(F.col(f"q.{c}"), F.lit(d)).alias(c)
    urls = F.filter(F.split(F.coalesce("citation_urls", F.lit("")), r"[;\s]+"), lambda u: u != "")
    answers = good.select("provider", "model", "question", F.col("answer").alias("raw"), F.col("_seen").alias("observed_at"), urls.alias("supplied"), "notes", F.col("q.id").alias("question_id"), either("stage", "solution_research"), either("type", "category_recommendation"), F.col("q.persona_id"), either("geography", "Unspecified"), either("intent", 3))
    return answers, rows.filter("_why IS NOT NULL").drop("_seen").withColumnRenamed("_why", "reason")


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, dict[str, str]], form: str = "parquet") -> dict[str, DataFrame]:
    """Stored tables, with columns of JSON text parsed: schemas names each table's such columns and their types."""
    out = {}
    for name, columns in schemas.items():
        df = spark.read.format(form).load(f"{folder}/{name}.{form}")
        out[name] = df.withColumns({c: F.from_json(c, kind) for c, kind in columns.items()}) if columns else df
    return out


__all__ = ["classify_fetches", "extract", "extract_pages", "follow_sitemaps", "normalize_imports", "parse_robots", "read_answer_csv", "read_sitemaps", "read_tables"]
