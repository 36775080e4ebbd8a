"""Technical audit of crawls: 38 rules with four outcomes, coverage and run rows.

An outcome is finding, passed, unavailable (the evidence wasn't collected) or not_applicable; the second is never read from a missing row.
Crawls: id, brand_id, status, discovery, site_signals, pages_discovered, pages_processed. Pages: the table of page attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonld import jsonld_summary
from ..functions.text import comparable, compact, noindex_directives
from ..functions.urls import url_key
from ..storage import stored
from .duplicates import class_members, duplicates, equal_texts, text_classes
from .links import broken_links, canonical_targets, incoming_links, keyed_pages, link_edges, page_links, resolve_links, robots_verdicts

RULE_VERSION = "technical-1.0.0"
#: Agents that the site rule on AI robots asks for.
AI_AGENTS = ("GPTBot", "OAI-SearchBot", "ClaudeBot", "PerplexityBot", "Google-Extended")
#: Rules (fixed values): id, severity, category, scope.
RULES = (
    ("http-status", "error", "Access", "page"),
    ("redirect-chain", "warning", "Access", "page"),
    ("https", "warning", "Access", "html"),
    ("canonical-missing", "warning", "Indexability", "html"),
    ("canonical-invalid", "warning", "Indexability", "signals"),
    ("canonical-mismatch", "observation", "Indexability", "html"),
    ("indexability", "observation", "Indexability", "html"),
    ("canonical-noindex", "warning", "Indexability", "html"),
    ("robots-access", "observation", "Access", "page"),
    ("sitemap-inclusion", "observation", "Discovery", "html"),
    ("title-missing", "warning", "Content", "html"),
    ("title-duplicate", "warning", "Content", "html"),
    ("title-length", "observation", "Content", "html"),
    ("description-missing", "warning", "Content", "html"),
    ("description-duplicate", "warning", "Content", "html"),
    ("h1-count", "observation", "Content", "html"),
    ("heading-order", "observation", "Content", "html"),
    ("word-count", "observation", "Content", "html"),
    ("internal-links", "observation", "Links", "html"),
    ("potential-orphan", "observation", "Links", "html"),
    ("broken-internal-links", "error", "Links", "html"),
    ("jsonld-missing", "observation", "Structured data", "html"),
    ("jsonld-parse", "error", "Structured data", "html"),
    ("organization-schema", "observation", "Structured data", "signals"),
    ("product-schema", "observation", "Structured data", "signals"),
    ("faq-schema", "observation", "Structured data", "signals"),
    ("faq-visible-match", "warning", "Structured data", "html"),
    ("breadcrumb-schema", "observation", "Structured data", "html"),
    ("editorial-author", "observation", "Trust signals", "signals"),
    ("editorial-dates", "observation", "Trust signals", "signals"),
    ("javascript-content", "observation", "Content", "signals"),
    ("content-duplicate", "observation", "Content", "html"),
    ("content-near-duplicate", "observation", "Content", "html"),
    ("company-identity", "observation", "Trust signals", "site"),
    ("contact-information", "observation", "Trust signals", "site"),
    ("llms-presence", "observation", "AI conventions", "site"),
    ("llms-syntax", "observation", "AI conventions", "site"),
    ("ai-robots", "observation", "AI conventions", "site"),
)
SEVERITY_ORDER = ("error", "warning", "observation")
UNAVAILABLE, NOT_APPLICABLE = "unavailable", "not_applicable"


def _finding(test: Column, *evidence: tuple[str, Column], also: Column | None = None) -> Column:
    """Outcome of one rule: a finding with its evidence where the test holds, else passed; ``also`` may give another outcome first."""
    said = F.array(*(F.struct(F.lit(label).alias("label"), _texts(value).alias("value")) for label, value in evidence))
    outcome = F.when(F.coalesce(test, F.lit(False)), "finding").otherwise("passed")
    outcome = F.coalesce(also, outcome) if also is not None else outcome
    return F.struct(outcome.alias("outcome"), F.when(outcome == "finding", said).alias("evidence"))


def _texts(value: Column) -> Column:
    return F.filter(F.array(value.cast("string")), lambda x: x.isNotNull())


def _listed(values: Column) -> Column:
    """Several values as one piece of evidence."""
    return F.array_join(values, "\n")


def _has(types: Column, *names: str) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, names)))


def row_rules(p: DataFrame) -> dict[str, Column]:
    """Rules that read one page alone, with what has been joined to it. One projection, no shuffle."""
    c = F.col
    path = F.coalesce(F.try_parse_url("page_url", F.lit("PATH")), F.lit(""))
    s, kind = c("technical_signals"), c("technical_signals.page_kind")
    types, text = c("ld.types"), F.coalesce(c("visible_text"), F.lit(""))
    none = F.array().cast("array<string>")
    directives = noindex_directives(F.coalesce("robots_directives", none))
    invalid = F.filter(F.coalesce("structured_data", F.array().cast("array<struct<valid:boolean,value:string,error:string>>")), lambda b: ~b["valid"])
    level = lambda k: F.size(F.filter("headings", lambda h: h["level"] == k))
    jumps = F.filter(F.transform("headings", lambda h, i: F.when((i > 0) & (h["level"] > F.get(c("headings"), i - 1)["level"] + 1), h["text"])), lambda x: x.isNotNull())
    dates, first = F.concat(s["published_dates"], s["modified_dates"]), lambda d: F.try_to_timestamp(F.get(d, F.lit(0)))
    missing = F.filter("ld.faq_texts", lambda t: (t == "") | ~F.contains(comparable(text), comparable(t)))
    optional = lambda relevant, *names: _finding(~_has(types, *names), ("Types found", _listed(types)), also=F.when(~relevant, NOT_APPLICABLE))
    return {
        "http-status": _finding(c("status") == "failed", ("HTTP status", F.coalesce(c("status_code").cast("string"), F.lit("none"))), ("Failure", F.coalesce("error", F.lit("unknown")))),
        "redirect-chain": _finding(F.size("redirects") > 1, ("Redirects", _listed(F.transform("redirects", lambda r: F.concat_ws(" ", r["status"], r["url"], r["destination"]))))),
        "https": _finding(~F.lower("page_url").startswith("https:"), ("Final URL", c("page_url"))),
        "canonical-missing": _finding(F.coalesce("canonical_url", F.lit("")) == "", ("Canonical", F.lit("none"))),
        "canonical-invalid": _finding((F.size(s["canonical_candidates"]) > 1) | F.exists(s["canonical_candidates"], lambda x: F.coalesce(x["url"], F.lit("")) == ""), ("Links", _listed(F.transform(s["canonical_candidates"], lambda x: x["raw"])))),
        "canonical-mismatch": _finding(c("canonical_k") != c("page_k"), ("Final URL", c("page_url")), ("Canonical", c("canonical_url"))),
        "indexability": _finding(F.size(directives) > 0, ("Directives", _listed(directives))),
        "canonical-noindex": _finding(F.coalesce(F.size("target_noindex") > 0, F.lit(False)), ("Canonical", c("canonical_url")), ("Directives", _listed(c("target_noindex"))), also=F.when(F.coalesce("canonical_url", F.lit("")) == "", NOT_APPLICABLE).when(~F.coalesce(c("target_status") == "fetched", F.lit(False)), UNAVAILABLE)),
        "robots-access": _finding(~c("robots_allowed"), ("URL", c("url")), also=F.when(c("robots_allowed").isNull(), UNAVAILABLE)),
        "sitemap-inclusion": _finding(~F.coalesce("in_sitemap", F.lit(False)) & ~c("in_discovery"), ("In the sitemap", F.lit("no")), also=F.when(~F.coalesce("has_sitemap", F.lit(False)), UNAVAILABLE)),
        "title-missing": _finding(compact(F.coalesce("title", F.lit(""))) == "", ("Title", F.lit("none"))),
        "title-duplicate": _finding(c("same_title.n") > 1, ("Pages with the title", c("same_title.n")), ("Group", c("same_title.first"))),
        "title-length": _finding((F.coalesce("title", F.lit("")) != "") & ~F.length("title").between(15, 65), ("Title", c("title")), ("Characters", F.length("title"))),
        "description-missing": _finding(compact(F.coalesce("meta_description", F.lit(""))) == "", ("Description", F.lit("none"))),
        "description-duplicate": _finding(c("same_description.n") > 1, ("Pages with the description", c("same_description.n")), ("Group", c("same_description.first"))),
        "h1-count": _finding(level(1) != 1, ("H1 headings", level(1))),
        "heading-order": _finding(F.size(jumps) > 0, ("Headings", _listed(jumps))),
        "word-count": _finding(c("word_count") < 100, ("Words", c("word_count"))),
        "internal-links": _finding(F.size("internal_links") == 0, ("Internal links", F.lit("0"))),
        "potential-orphan": _finding(F.coalesce("incoming", F.lit(0)) == 0, ("Incoming links", F.lit("0")), also=F.when(path.isin("", "/"), NOT_APPLICABLE)),
        "broken-internal-links": _finding(F.size("broken") > 0, ("Links", _listed(c("broken"))), also=F.when(F.coalesce(F.size("broken") > 0, F.lit(False)), "finding").when(F.coalesce("unknown", F.lit(False)), UNAVAILABLE).when(F.size("internal_links") == 0, NOT_APPLICABLE)),
        "jsonld-missing": _finding(F.size("structured_data") == 0, ("Blocks", F.lit("0"))),
        "jsonld-parse": _finding(F.size(invalid) > 0, ("Errors", _listed(F.transform(invalid, lambda b: b["error"])))),
        "organization-schema": optional(kind == "home", "Organization", "Corporation", "LocalBusiness"),
        "product-schema": optional(kind == "product", "Product", "SoftwareApplication", "WebApplication"),
        "faq-schema": optional(kind == "faq", "FAQPage"),
        "faq-visible-match": _finding(F.size(missing) > 0, ("Not in the text", _listed(missing)), also=F.when(c("ld.faqs") == 0, NOT_APPLICABLE).when(F.size("ld.faq_texts") == 0, UNAVAILABLE)),
        "breadcrumb-schema": optional(F.size(F.filter(F.split(path, "/"), lambda x: x != "")) >= 2, "BreadcrumbList"),
        "editorial-author": _finding(F.size(s["authors"]) == 0, ("Authors", F.lit("none")), also=F.when(kind != "editorial", NOT_APPLICABLE)),
        "editorial-dates": _finding((F.size(s["published_dates"]) == 0) | F.exists(dates, lambda d: F.try_to_timestamp(d).isNull()) | F.coalesce(first(s["modified_dates"]) < first(s["published_dates"]), F.lit(False)), ("Published", _listed(s["published_dates"])), ("Modified", _listed(s["modified_dates"])), also=F.when(kind != "editorial", NOT_APPLICABLE)),
        "javascript-content": _finding((c("word_count") < 100) & ((s["script_count"] > 0) | s["javascript_notice"].isNotNull()), ("Words", c("word_count")), ("Scripts", s["script_count"])),
        "content-duplicate": _finding((text != "") & (c("same_text.n") > 1), ("Pages with the text", c("same_text.n")), ("Group", c("same_text.first"))),
        "content-near-duplicate": _finding(c("similar.pages") > 1, ("Similar pages", c("similar.pages")), ("Group", c("similar.class")), also=F.when(~F.coalesce("comparable_text", F.lit(False)), NOT_APPLICABLE)),
    }


def _gated(rule: str, scope: str, result: Column) -> Column:
    """A rule's result behind its scope: without a fetched page, or its signals, there is no evidence."""
    gate = F.col("status") != "fetched" if scope != "page" else F.lit(False)
    gate = gate | F.col("technical_signals").isNull() if scope == "signals" else gate
    return F.struct(F.lit(rule).alias("rule_id"), F.when(gate, UNAVAILABLE).otherwise(result["outcome"]).alias("outcome"), F.when(~gate, result["evidence"]).alias("evidence"))


def page_outcomes(crawls: DataFrame, pages: DataFrame, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """(crawl_run_id, page_id, url, rule_id, outcome, evidence): every page rule on every page of its crawl and brand.

    robots: rule rows of parse_robots with crawl_run_id and origin. What the link graph and the groups need of a page is stored once,
    without its texts, with each URL's key worked out; what they say of a page is brought together by one aggregate and joined to the pages once.
    """
    own = crawls.select(F.col("id").alias("crawl_run_id"), "brand_id", (F.size("discovery.sitemap_urls") > 0).alias("has_sitemap"))
    pages = pages.join(own, ["crawl_run_id", "brand_id"])
    slim = pages.select("crawl_run_id", "id", "url", "final_url", "canonical_url", "status", "status_code", "redirects", "internal_links", "robots_directives", "text_hash", comparable(F.col("title")).alias("title_k"), comparable(F.col("meta_description")).alias("description_k"))
    slim = stored(keyed_pages(slim))
    fetched, id_ = slim.filter("status = 'fetched'"), ["crawl_run_id", F.col("id").alias("page_id")]
    resolved = resolve_links(slim)
    links = page_links(slim)
    parts = [slim.select(*id_, "page_url", "page_k", "canonical_k"), incoming_links(link_edges(links, resolved)), broken_links(links, resolved)]
    noindex = slim.select("crawl_run_id", F.col("id").alias("target_id"), noindex_directives("robots_directives").alias("target_noindex")).filter(F.size("target_noindex") > 0)
    parts.append(canonical_targets(slim, resolved).join(noindex, ["crawl_run_id", "target_id"], "left").select("crawl_run_id", "page_id", "target_status", "target_noindex"))
    for name, key in (("same_title", "title_k"), ("same_description", "description_k"), ("same_text", "text_hash")):
        parts.append(duplicates(fetched, F.col(key)).select(*id_, F.struct("first", "n").alias(name)))
    main = F.coalesce(F.when(F.col("technical_signals.main_text") != "", F.col("technical_signals.main_text")), F.col("visible_text"))
    texts = pages.filter("status = 'fetched'").select("crawl_run_id", "id", "text_hash", main.alias("main"))
    parts.append(similar_pages(texts))
    found = crawls.select(F.col("id").alias("crawl_run_id"), F.explode("discovery.page_urls").alias("u")).select("crawl_run_id", url_key(F.col("u")).alias("page_k")).distinct()
    parts.append(slim.select(*id_, "page_k").join(found, ["crawl_run_id", "page_k"]).select("crawl_run_id", "page_id", F.lit(True).alias("in_discovery")))
    if robots is not None:
        origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
        at = slim.select(*id_, origin.alias("origin"), F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/")).alias("path"))
        parts.append(robots_verdicts(at, robots, [agent]).groupBy("crawl_run_id", "page_id").agg(F.min("allowed").alias("robots_allowed")))
    said = parts[0]
    for part in parts[1:]:
        said = said.unionByName(part, allowMissingColumns=True)
    said = said.groupBy("crawl_run_id", "page_id").agg(*(F.any_value(c, F.lit(True)).alias(c) for c in said.columns if c not in ("crawl_run_id", "page_id")))
    if robots is None:
        said = said.withColumn("robots_allowed", F.lit(None).cast("boolean"))
    rows = pages.withColumnRenamed("id", "page_id").join(said, ["crawl_run_id", "page_id"])
    valid = F.transform(F.filter(F.coalesce("structured_data", F.array().cast("array<struct<valid:boolean,value:string,error:string>>")), lambda b: b["valid"]), lambda b: b["value"])
    rows = rows.withColumn("ld", jsonld_summary(valid)).withColumn("in_discovery", F.coalesce("in_discovery", F.lit(False)))
    rules = row_rules(rows)
    results = F.array(*(_gated(rule, scope, rules[rule]) for rule, _, _, scope in RULES if scope != "site"))
    return rows.select("crawl_run_id", "page_id", F.col("page_url").alias("url"), F.inline(results))


def similar_pages(texts: DataFrame) -> DataFrame:
    """(crawl_run_id, page_id, similar, comparable_text) of the pages whose texts are long enough to be compared.

    ``similar``: the page's class of near-duplicates and its number of pages; null where no other text is similar. The pages of a class are those
    with its id.
    """
    classes, sets = text_classes(texts, F.col("main"), F.col("text_hash"))
    near = class_members(texts, F.col("text_hash"), classes, sets, "crawl_run_id", "id").select("crawl_run_id", "id", F.struct("class", "pages").alias("similar"))
    members = equal_texts(texts, F.col("text_hash"), "crawl_run_id", "id").join(sets.select("crawl_run_id", F.col("id").alias("first")), ["crawl_run_id", "first"])
    return members.join(near, ["crawl_run_id", "id"], "left").select("crawl_run_id", F.col("id").alias("page_id"), "similar", F.lit(True).alias("comparable_text"))


def site_outcomes(crawls: DataFrame, pages: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """The same for the rules on a crawl as a whole; page_id is null."""
    own = crawls.select(F.col("id").alias("crawl_run_id"), "brand_id")
    known = F.col("technical_signals").isNotNull() & (F.col("status") == "fetched")
    counts = pages.join(own, ["crawl_run_id", "brand_id"]).groupBy("crawl_run_id").agg(
        F.count_if(known).alias("known"), F.max(known & (F.size("technical_signals.identity_signals") > 0)).alias("identity"), F.max(known & (F.size("technical_signals.contact_signals") > 0)).alias("contact"))
    rows = crawls.withColumnRenamed("id", "crawl_run_id").join(counts, "crawl_run_id", "left")
    nobody = F.when(F.coalesce("known", F.lit(0)) == 0, UNAVAILABLE)
    llms, body = F.col("site_signals.llms"), F.coalesce(F.col("site_signals.llms.text"), F.lit(""))
    odd = (F.trim(body) == "") | body.rlike(r"(?i)^\s*<(?:!doctype|html)") | ~body.rlike(r"(?m)^#\s+\S") | ~body.rlike(r"\[[^\]]+\]\([^)]+\)")
    syntax = F.when(llms.isNull() | llms["truncated"] | llms["error"].isNotNull(), UNAVAILABLE).when(F.coalesce(llms["status"], F.lit(0)) != 200, NOT_APPLICABLE)
    if robots is None:
        rows = rows.withColumn("agents", F.lit(None).cast("array<string>"))
    else:
        home = robots.select("crawl_run_id", "origin").distinct().withColumn("path", F.lit("/"))
        verdicts = robots_verdicts(home, robots, list(AI_AGENTS)).select("crawl_run_id", F.concat_ws(" ", "origin", "agent", F.when(F.col("allowed"), "allowed").otherwise("disallowed")).alias("v"))
        rows = rows.join(verdicts.groupBy("crawl_run_id").agg(F.array_sort(F.collect_list("v")).alias("agents")), "crawl_run_id", "left")
    results = {
        "company-identity": _finding(~F.col("identity"), ("Pages with signals", F.col("known")), also=nobody),
        "contact-information": _finding(~F.col("contact"), ("Pages with signals", F.col("known")), also=nobody),
        "llms-presence": _finding(F.lit(True), ("HTTP status", llms["status"]), ("Text", F.substring(body, 1, 2000)), also=F.when(llms.isNull(), UNAVAILABLE)),
        "llms-syntax": _finding(odd, ("Text", F.substring(body, 1, 2000)), also=syntax),
        "ai-robots": _finding(F.lit(True), ("Agents", _listed(F.col("agents"))), also=F.when(F.col("agents").isNull(), UNAVAILABLE)),
    }
    inline = F.inline(F.array(*(F.struct(F.lit(r).alias("rule_id"), x["outcome"].alias("outcome"), x["evidence"].alias("evidence")) for r, x in results.items())))
    return rows.select("crawl_run_id", F.lit(None).cast("string").alias("page_id"), F.col("discovery.origin").alias("url"), inline)


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, severity string, category string, scope string")


def coverage(outcomes: DataFrame) -> DataFrame:
    """Of each crawl and rule: evaluated, passed, findings, not_applicable and unavailable; rules of crawls without a page are zeros."""
    out = F.col("outcome")
    counts = outcomes.groupBy("crawl_run_id", "rule_id").agg(F.count_if(out.isin("finding", "passed")).alias("evaluated"), F.count_if(out == "passed").alias("passed"), F.count_if(out == "finding").alias("findings"), F.count_if(out == NOT_APPLICABLE).alias("not_applicable"), F.count_if(out == UNAVAILABLE).alias("unavailable"))
    rules = F.broadcast(rule_table(outcomes.sparkSession))
    grid = outcomes.select("crawl_run_id").distinct().crossJoin(rules)  # 38 rows for each crawl
    return grid.join(counts, ["crawl_run_id", "rule_id"], "left").fillna(0, ["evaluated", "passed", "findings", "not_applicable", "unavailable"])


def findings(outcomes: DataFrame) -> DataFrame:
    """Outcomes that are findings, with their rule's severity, category and a title that searches look in."""
    rules = F.broadcast(rule_table(outcomes.sparkSession))
    return outcomes.filter("outcome = 'finding'").join(rules, "rule_id").select("crawl_run_id", "page_id", "rule_id", "severity", "category", F.initcap(F.replace("rule_id", F.lit("-"), F.lit(" "))).alias("title"), "url", "evidence")


def audit_runs(crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each crawl: rule_version, pages_analyzed and distinct warnings on what the evidence doesn't cover."""
    fetched = pages.filter("status = 'fetched'").groupBy("crawl_run_id").agg(F.count("*").alias("pages_analyzed"), F.max(F.col("technical_signals").isNull()).alias("old"))
    c = crawls.withColumnRenamed("id", "crawl_run_id").join(fetched, "crawl_run_id", "left")
    said = F.array(
        F.when(F.col("status") != "completed", F.concat(F.lit("The crawl ended as "), F.col("status"), F.lit("; evidence is partial."))),
        F.when((F.col("pages_processed") < F.col("pages_discovered")) | F.coalesce("discovery.truncated", F.lit(False)), F.lit("Some known URLs weren't collected.")),
        F.when(F.coalesce("old", F.lit(False)) | F.col("site_signals").isNull(), F.lit("Some signals weren't collected; those checks are unavailable.")),
        F.when(F.coalesce("site_signals.llms.truncated", F.lit(False)), F.lit("The llms.txt text was cut off.")),
    )
    warnings = F.array_distinct(F.concat(F.coalesce("discovery.warnings", F.array().cast("array<string>")), F.filter(said, lambda x: x.isNotNull())))
    return c.select("crawl_run_id", F.lit(RULE_VERSION).alias("rule_version"), F.coalesce("pages_analyzed", F.lit(0)).alias("pages_analyzed"), warnings.alias("warnings"))


def unsaved(runs: DataFrame, saved: DataFrame) -> DataFrame:
    """Runs that aren't saved yet: one audit for each crawl and rule version."""
    return runs.dropDuplicates(["crawl_run_id", "rule_version"]).join(saved.select("crawl_run_id", "rule_version"), ["crawl_run_id", "rule_version"], "left_anti")


def audit(crawls: DataFrame, pages: DataFrame, robots: DataFrame | None = None, agent: str = "*") -> dict[str, DataFrame]:
    """findings, coverage and runs of all crawls."""
    outcomes = page_outcomes(crawls, pages, robots, agent).unionByName(site_outcomes(crawls, pages, robots))
    return {"findings": findings(outcomes), "coverage": coverage(outcomes), "runs": audit_runs(crawls, pages)}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def issue_summary(issues: DataFrame, run: str = "crawl_run_id") -> DataFrame:
    """Issues of each run by severity, and the categories and rules that they are of."""
    sev = F.col("severity")
    return issues.groupBy(run).agg(*(F.count_if(sev == s).alias(f"{s}s") for s in SEVERITY_ORDER), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("rule_id")).alias("rules"))


def attention_groups(issues: DataFrame, run: str = "crawl_run_id", top: int = 3) -> DataFrame:
    """The categories with most findings that aren't observations; those with an error first."""
    groups = issues.filter("severity <> 'observation'").groupBy(run, "category").agg(F.max(F.col("severity") == "error").alias("any_error"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("any_error"), F.desc("n"), "category"))
    return groups.withColumn("rank", rank).filter(F.col("rank") <= top)


def search_issues(issues: DataFrame, severity=None, category=None, rule=None, words: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of issues, by severity, rule and URL. Words are looked for in URL and title as they are, wildcards included."""
    for name, value in (("severity", severity), ("category", category), ("rule_id", rule)):
        issues = issues.filter(F.col(name) == value) if value else issues
    if words:
        issues = issues.filter(F.exists(F.array(*(c for c in ("url", "title") if c in issues.columns)), lambda x: F.contains(F.lower(x), F.lower(F.lit(words)))))
    return issues.orderBy(severity_rank(F.col("severity")), "rule_id", "url").offset((page - 1) * size).limit(size)
