"""Registered queries: each applies operators to tables derived from the driver's, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import text as T
from ..functions import urls as U
from ..operators import audit as A
from ..operators import content as C
from ..operators import duplicates as D
from ..operators import facts as FA
from ..operators import ledger as L
from ..operators import links as LI
from ..operators import questions as Q
from ..operators import validate as VA
from ..operators import visibility as V
from ..sources import pages as P
from ..storage import stored
from . import crawls as CR
from . import frames as B
from . import oracle as O
from . import oracle_audit as OA

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places: two engines add in different orders."""
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return V.find_mentions(B.answers(spark, d), B.brands(spark)).withColumns({"recommended": F.col("first_position") == 1, "recommendation_position": F.lit(1)})


@query(O.BRAND_METRICS)
def brand_metrics(spark, d):
    return V.brand_metrics(B.answers(spark, d), B.brands(spark), _mentions(spark, d), B.citations(spark, d))


@query(O.BRAND_BY_TYPE)
def brand_metrics_by_type(spark, d):
    return V.brand_metrics(B.answers(spark, d), B.brands(spark), _mentions(spark, d), grain=("type",)).select("experiment_id", "type", "brand_id", "eligible", "mentioned", "mention_value", "share")


@query(O.STAGE_METRICS)
def stage_metrics(spark, d):
    return V.stage_metrics(B.answers(spark, d), B.brands(spark), _mentions(spark, d))


@query(O.SOURCE_METRICS)
def source_metrics(spark, d):
    return V.source_metrics(B.answers(spark, d), B.brands(spark), _mentions(spark, d))


@query(O.SLICED_METRICS)
def sliced_metrics(spark, d):
    return V.sliced_metrics(B.answers(spark, d), B.brands(spark), _mentions(spark, d), B.citations(spark, d)).drop("name", "kind", "share_denominator", "position", "position_samples", "absent")


@query(O.ANSWER_COUNTS)
def answer_counts(spark, d):
    return V.answer_counts(B.answers(spark, d))


@query(O.MENTION_ORDER)
def mention_order(spark, d):
    return V.find_mentions(B.answers(spark, d), B.brands(spark))


@query(O.CITATION_DOMAINS)
def citation_domains(spark, d):
    return V.citation_domains(B.answers(spark, d), B.brands(spark), B.citations(spark, d)).withColumns({c: F.array_join(c, " ") for c in ("urls", "source_kinds")})


@query(O.CITATION_URLS)
def citation_urls(spark, d):
    return V.citation_urls(B.answers(spark, d), B.citations(spark, d))


@query(O.CONCENTRATION)
def citation_concentration(spark, d):
    return V.citation_concentration(V.citation_domains(B.answers(spark, d), B.brands(spark), B.citations(spark, d)))


@query(O.CLAIM_AGREEMENT)
def claim_agreement(spark, d):
    kind = F.when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "view", "unverifiable").otherwise("supported")
    return V.claim_agreement(B.read(spark, d, "events").select((F.col("user_id") % 7).alias("experiment_id"), kind.alias("classification")))


@query(O.SLICED_CITATIONS)
def sliced_citations(spark, d):
    return V.sliced_citations(B.answers(spark, d), B.brands(spark), B.citations(spark, d))


@query(O.SLICED_CONCENTRATION)
def sliced_concentration(spark, d):
    return V.sliced_concentration(V.sliced_citations(B.answers(spark, d), B.brands(spark), B.citations(spark, d)))


@query(O.SLICED_AGREEMENT)
def sliced_agreement(spark, d):
    """A claim for each answer, of a kind that its number tells."""
    kind = F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "unverifiable", "time_sensitive", "supported"))), (F.col("ordinal") % 5 + 1).cast("int"))
    return V.sliced_agreement(B.answers(spark, d), B.answers(spark, d).select("experiment_id", "answer_id", kind.alias("classification")))


@query(O.FILTERED)
def filtered_answers(spark, d):
    return V.filter_answers(B.answers(spark, d).withColumn("observed_at", F.lit("2026-01-01")), stage="solution_research", type="t2", source="prov0 / m1").select("experiment_id", "answer_id")


@query(O.PREVIOUS_RUN)
def previous_run(spark, d):
    runs = B.read(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("setup"), F.col("ts").alias("created_at"), F.col("event_id").alias("run_id"))
    return V.previous_run(runs, ["setup"]).drop("created_at")


@query(O.RUN_PROGRESS)
def run_progress(spark, d):
    return V.run_progress(B.answers(spark, d))


@query(O.ANSWER_GRID)
def answer_grid(spark, d):
    asked = B.questions(spark, d).filter("selected").select(F.col("project_id").alias("experiment_id"), F.col("id").alias("place"))
    return V.answer_grid(asked, 3)


@query(O.RUN_ESTIMATE)
def run_estimate(spark, d):
    return V.run_estimate(B.questions(spark, d).filter("selected").withColumnRenamed("project_id", "experiment_id"), 3, 2000)


@query(O.RUN_HISTORY)
def run_history(spark, d):
    runs = B.brands(spark).select("experiment_id").distinct().select((F.col("experiment_id").cast("int") % 2).alias("project_id"), "experiment_id", F.col("experiment_id").alias("created_at"))
    return V.run_history(V.brand_metrics(B.answers(spark, d), B.brands(spark), _mentions(spark, d)), runs, 2).select("project_id", "experiment_id", "brand_id", "mentioned", "eligible")


@query(O.USAGE_TOTALS)
def usage_totals(spark, d):
    return L.usage_totals(B.usage(spark, d))


@query(O.LATEST_USAGE)
def latest_usage(spark, d):
    return L.latest_usage(B.usage(spark, d), 10).select("project_id", "id", "place")


@query(O.LATEST_RESPONSES)
def latest_responses(spark, d):
    return L.latest_responses(B.usage(spark, d)).select("project_id", "cache_key", "id")


@query(O.LATEST_CRAWLS)
def latest_crawls(spark, d):
    return L.latest_crawls(B.read(spark, d, "orders").select(F.col("o_custkey").alias("brand_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).select("brand_id", "id")


@query(O.CRAWL_COUNTERS)
def crawl_counters(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("fetched")
    return L.crawl_counters(B.read(spark, d, "events").select(F.col("user_id").alias("crawl_run_id"), status.alias("status")))


@query(O.CONTRADICTIONS)
def contradictions(spark, d):
    return FA.contradictions(B.facts(spark, d)).withColumns({c: F.array_join(c, " ") for c in ("values", "fact_ids")})


@query(O.CONTRADICTING_FACTS)
def contradicting_facts(spark, d):
    return FA.contradicting_facts(B.facts(spark, d))


@query(O.REFERENCE_FACTS)
def reference_facts(spark, d):
    kinds = B.facts(spark, d).select("brand_id").distinct().withColumn("kind", F.when(F.col("brand_id").endswith("1"), "target").otherwise("competitor"))
    return FA.reference_facts(B.facts(spark, d), kinds).select("brand_id", "id", "place")


@query(O.CONTEXT_FACTS)
def context_facts(spark, d):
    return FA.context_facts(B.facts(spark, d), by="brand_id").select("brand_id", "id", "place")


@query(O.MERGED_FACTS)
def merged_facts(spark, d):
    source = F.array(F.struct(F.lit("u").alias("url"), F.lit("h").alias("text_hash"), F.lit("q").alias("quote")))
    facts = B.facts(spark, d).withColumn("sources", source)
    return FA.merge_facts(facts.filter("id % 2 = 0"), facts.filter("id % 2 = 1")).select("id")


@query(O.DEDUPED_QUESTIONS)
def deduped_questions(spark, d):
    return Q.dedupe_questions(B.questions(spark, d)).select("project_id", "id", "normalized_text")


@query(O.RECOMMENDED)
def recommended_questions(spark, d):
    return Q.recommended_questions(B.questions(spark, d)).select("project_id", "id", "place")


@query(O.LIBRARY_CHECK)
def library_check(spark, d):
    return Q.library_check(B.questions(spark, d))


@query(O.STAGE_SHORTAGE)
def stage_shortage(spark, d):
    return Q.stage_shortage(B.questions(spark, d))


@query(O.FINGERPRINT)
def selection_fingerprint(spark, d):
    return Q.selection_fingerprint(B.questions(spark, d))


@query(O.BRANDED)
def branded_questions(spark, d):
    names = F.array(F.lit("the"), F.lit("que"))
    return B.questions(spark, d).withColumn("n", T.normalized_question(F.col("text"))).filter(T.is_branded(F.col("n"), names)).select("id")


@query(O.EXACT_DUPLICATES)
def exact_duplicates(spark, d):
    return D.duplicates(B.document_pages(spark, d), F.col("text_hash"))


@query(O.NEAR_DUPLICATES)
def near_duplicate_pages(spark, d):
    """Documents as pages, and every fifth once more with some words more: a row for each page of a class."""
    rows = B.read(spark, d, "documents").select(F.col("lang").alias("crawl_run_id"), F.col("doc_id").alias("id"), F.col("text").alias("visible_text"))
    more = rows.filter("id % 5 = 0").select("crawl_run_id", (F.col("id") + 1_000_000_000_000).alias("id"), F.concat("visible_text", F.lit(" and a tail")).alias("visible_text"))
    pages = rows.union(more).withColumn("text_hash", F.sha2("visible_text", 256))
    return D.near_duplicate_classes(pages, F.col("visible_text"), F.col("text_hash"))


@query(O.NORMALIZED_URLS)
def normalized_urls(spark, d):
    return B.read(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query(O.DOMAINS)
def page_domains(spark, d):
    url = F.col("url")
    return B.read(spark, d, "pages").select("page_id", U.domain_key(url).alias("domain"), U.is_page_candidate(url).alias("candidate"), U.host_matches(U.domain_key(url), F.lit("example.com")).alias("own"), U.is_excluded(url, F.array(F.lit("/fr"))).alias("excluded"))


@query(O.FRONTIER)
def crawl_frontier(spark, d):
    rows = B.read(spark, d, "pages").select(U.domain_key(F.col("url")).alias("crawl_run_id"), "url", F.col("page_id").alias("seen"), F.concat(F.lit("http://"), U.domain_key(F.col("url")), F.lit("/")).alias("home"), F.array(F.lit("/de")).alias("excluded_paths"))
    return LI.frontier(rows, 3)


@query(O.SAFE_CSV)
def safe_csv(spark, d):
    return sinks.safe_csv(B.read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" ="), F.col("event_type"))).otherwise(F.col("event_type")).alias("kind"), (-F.col("user_id")).alias("n")))


@query(O.REDACTED)
def redacted_documents(spark, d):
    return sinks.redact(B.read(spark, d, "documents").select("doc_id", "text"), ["the", "mail3"])


@query(O.PRIORITIES)
def action_priorities(spark, d):
    effort = F.when(F.col("p_partkey") % 3 == 0, "small").when(F.col("p_partkey") % 3 == 1, "medium").otherwise("large")
    return B.read(spark, d, "part").select("p_partkey", C.priority(F.col("p_size"), F.col("p_size") + 30, F.lit(0.65), effort).alias("priority"))


@query(O.COVERAGE_MATRIX)
def coverage_matrix(spark, d):
    rows = B.read(spark, d, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_returnflag").alias("brand_id"), F.col("l_orderkey").alias("page_id"))
    return C.coverage_matrix(rows, ["A", "N", "R"])


@query(O.THIRD_PARTY)
def third_party_sources(spark, d):
    brands = B.brands(spark).select(F.col("experiment_id").alias("project_id"), F.concat(F.lit("https://www.tionble."), F.lit("example.org")).alias("domain"))
    return C.third_party_sources(B.citations(spark, d).join(B.answers(spark, d).select("answer_id", "ordinal"), "answer_id").withColumnRenamed("experiment_id", "project_id"), brands)


def _issues(spark, d):
    kind, n = F.col("event_type"), F.col("event_id")
    return B.read(spark, d, "events").select((F.col("user_id") % 20).alias("crawl_run_id"), F.when(kind == "error", "error").when(n % 2 == 0, "warning").otherwise("observation").alias("severity"), F.concat(F.lit("c"), n % 5).alias("category"), F.concat(F.lit("r"), n % 13).alias("rule_id"), F.concat(F.lit("https://a.com/"), n).alias("url"))


@query(O.ISSUE_SUMMARY)
def issue_summary(spark, d):
    return A.issue_summary(_issues(spark, d)).select("crawl_run_id", "errors", "warnings", "observations", F.size("categories").alias("n_categories"), F.size("rules").alias("n_rules"))


@query(O.ATTENTION)
def attention_groups(spark, d):
    return A.attention_groups(_issues(spark, d))


@query(O.SEARCH_ISSUES)
def search_issues(spark, d):
    return A.search_issues(_issues(spark, d), category="c2", words="/1", page=2)


@query(O.EXTRACTED_CITATIONS)
def extracted_citations(spark, d):
    raw = F.concat(F.lit("See "), F.col("url"), F.lit("). Or "), F.col("url"), F.lit(", http://localhost/x, https://www.other.com/"), F.col("page_id"), F.lit("!"))
    rows = B.read(spark, d, "pages").select(F.lit("e").alias("experiment_id"), F.col("page_id").alias("answer_id"), raw.alias("raw"), F.array("url").alias("supplied"), F.lit("provider").alias("supplied_source"))
    return V.extract_citations(rows).select("answer_id", "url", "domain", "source")


@query(O.ADJUDICATED)
def adjudicated_claims(spark, d):
    facts = B.read(spark, d, "part").select(F.col("p_brand").alias("experiment_id"), F.col("p_partkey").alias("fact_id"), F.when(F.col("p_partkey") % 5 == 0, "pricing").otherwise("feature").alias("category"), F.col("p_type").alias("subject"), F.lit("size").alias("attribute"), F.col("p_size").cast("string").alias("value"))
    claims = B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("experiment_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("claim_id"), F.when(F.col("l_linenumber") == 1, "costs 5 today").otherwise("has a size").alias("text"), F.lit("supported").alias("classification"), F.array("l_partkey").alias("fact_ids"))
    return V.adjudicate_claims(claims, facts).select("claim_id", "classification")


def _content(spark, d):
    """Parts as questions, suppliers as pages that match the parts they supply, nations' parity as brands."""
    questions = B.read(spark, d, "part").select(F.lit("p").alias("project_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 2 == 0, "pricing").otherwise("other").alias("type"), (F.col("p_size") % 5 + 1).alias("intent"))
    matched = B.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page_id")).agg(F.transform(F.collect_set("l_partkey"), lambda q: F.struct(q.alias("question_id"))).alias("matches"))
    pages = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.when(F.col("s_nationkey") % 2 == 0, "b1").otherwise("b2").alias("brand_id"), F.concat(F.lit("https://a.com/"), F.col("s_suppkey")).alias("url"), (F.col("s_suppkey") % 20).cast("double").alias("direct_answer"), F.lit("completed").alias("status"))
    brands = spark.createDataFrame([("p", "b1", "target"), ("p", "b2", "competitor")], "project_id string, brand_id string, kind string")
    return questions, pages.join(matched, "page_id"), brands


@query(O.GAP_PAGES)
def gap_pages(spark, d):
    questions, pages, brands = _content(spark, d)
    return C.gap_pages(C.content_gaps(questions, pages, brands), pages, brands).drop("project_id")


@query(O.CONTENT_GAPS)
def content_gaps(spark, d):
    return C.content_gaps(*_content(spark, d)).select("question_id", "type", "action", "effort", "impact", "confidence", "rivals")


@query(O.ACTION_PLAN)
def action_plan(spark, d):
    issues = _issues(spark, d).withColumn("project_id", F.lit("p"))
    projects = spark.createDataFrame([("p", 5)], "project_id string, answers int")
    gaps = C.content_gaps(*_content(spark, d))
    return C.action_plan(C.technical_actions(issues), C.gap_actions(gaps), C.repeat_actions(projects)).groupBy("project_id", "category", "month", "priority").agg(F.count("*").alias("actions"))


@query(O.PROFILE_SOURCES)
def profile_sources(spark, d):
    part = F.element_at(F.array(*map(F.lit, ("/", "/about/us", "/pricing", "/blog/x"))), (F.col("doc_id") % 4 + 1).cast("int"))
    pages = B.read(spark, d, "documents").select(F.col("source").alias("crawl_run_id"), F.col("doc_id").alias("id"), F.concat(F.lit("https://a.com"), part, F.lit("?id="), F.col("doc_id")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit("fetched").alias("status"), F.col("text").alias("visible_text"))
    return FA.profile_sources(pages, 5).select("crawl_run_id", "id", "level", "place")


@query(O.BRAND_ALIASES)
def brand_aliases(spark, d):
    brands = B.facts(spark, d).select("brand_id").distinct().select("brand_id", F.col("brand_id").alias("name"), F.lit("https://www.a.com").alias("domain"), F.array(F.lit("x"), F.lit("Alias ")).alias("brand_aliases"), F.array().cast("array<string>").alias("product_names"))
    return FA.brand_aliases(brands, B.facts(spark, d)).select("brand_id", F.array_join("aliases", "|").alias("aliases"))


@query(O.REPEATED_DOMAINS)
def repeated_domains(spark, d):
    return FA.repeated_domains(B.read(spark, d, "pages").select((F.col("page_id") % 20).alias("project_id"), F.col("url").alias("domain")))


@query(O.BRAND_CHANGES)
def brand_changes(spark, d):
    host = U.domain_key(F.col("url"))
    rows = B.read(spark, d, "pages").groupBy((F.col("page_id") % 2).alias("half"), F.concat(F.lit("https://"), host).alias("domain")).agg(F.min("page_id").cast("string").alias("id"))
    rows = rows.select("half", F.lit("p").alias("project_id"), F.col("domain").alias("name"), "domain", F.lit("competitor").alias("kind"), "id")
    return FA.sync_brands(rows.filter("half = 0"), rows.filter("half = 1")).select("domain", "id", "active", "change")


@query(O.COMPANY_SUMMARY)
def company_summary(spark, d):
    category = F.element_at(F.array(*map(F.lit, ("summary", "target_customer", "product", "feature"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    facts = B.read(spark, d, "part").select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("id"), category.alias("category"), F.col("p_name").alias("value"), F.lit("unreviewed").alias("status"), F.col("p_size").alias("updated_at"))
    projects = facts.select("project_id").distinct().select("project_id", F.when(F.col("project_id").endswith("1"), "Own words").alias("description"), F.lit("").alias("target_customer"))
    return FA.company_summary(projects, facts).select("project_id", "summary", F.array_join("customers", "|").alias("customers"), F.array_join("offers", "|").alias("offers"))


@query(O.IDENTICAL_PAGES)
def identical_pages(spark, d):
    pages = B.read(spark, d, "documents").select(F.col("lang").alias("brand_id"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_hash"))
    return C.identical_pages(pages).select("brand_id", "id", F.array_join("similar", ",").alias("similar"))


@query(O.SITE_AVERAGES)
def site_averages(spark, d):
    pages = B.read(spark, d, "orders").select(F.col("o_custkey").alias("brand_id"), F.col("o_totalprice").cast("double").alias("score"), F.lit(60).alias("evaluated_weight"))
    return C.site_averages(pages)


@query(O.VALID_FACTS)
def valid_facts(spark, d):
    pages = B.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("visible_text"))
    facts = B.read(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 2).alias("page_id"), F.when(F.col("doc_id") % 3 == 0, "odd").otherwise("product").alias("category"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise("s").alias("subject"), F.when(F.col("doc_id") % 11 == 0, F.repeat(F.lit("a"), 181)).otherwise("a").alias("attribute"), F.col("doc_id").cast("string").alias("value"), (F.col("doc_id") % 5 / 3).alias("confidence"), F.substring("text", 1, 40).alias("quote"))
    return VA.validate_facts(facts, pages).select(F.col("value").cast("long").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"))


@query(O.PROMPTS)
def question_prompts(spark, d):
    where = F.when(F.col("id") % 2 == 0, "Unspecified").otherwise("EU")
    return B.questions(spark, d).select("id", T.prompt_text(F.col("text"), where).alias("prompt"), T.stable_id(F.col("text")).alias("key"))


# The link graph and the audit over a derived crawl.


def _keyed(spark, d):
    return LI.keyed_pages(CR.crawled_pages(spark, d))


@query(OA.RESOLVED)
def resolved_links(spark, d):
    return LI.resolve_links(_keyed(spark, d))


def _edges(spark, d):
    pages = stored(_keyed(spark, d))
    return pages, LI.link_edges(LI.page_links(pages), LI.resolve_links(pages))


@query(OA.EDGES)
def link_edges(spark, d):
    return _edges(spark, d)[1]


@query(OA.INCOMING)
def incoming_links(spark, d):
    return LI.incoming_links(_edges(spark, d)[1])


@query(OA.ORPHANS)
def orphan_pages(spark, d):
    return LI.orphans(*_edges(spark, d))


@query(OA.BROKEN)
def broken_links(spark, d):
    pages = _keyed(spark, d)
    return LI.broken_links(LI.page_links(pages), LI.resolve_links(pages)).withColumn("broken", F.array_join("broken", " | "))


@query(OA.TARGETS)
def canonical_targets(spark, d):
    pages = _keyed(spark, d)
    return LI.canonical_targets(pages, LI.resolve_links(pages))


@query(OA.ROBOTS)
def robots_verdicts(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1)
    at = CR.crawled_pages(spark, d).select("crawl_run_id", F.col("id").alias("page_id"), F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), path.alias("path"))
    return LI.robots_verdicts(at, CR.robots_rows(spark, d), ["anybot", "gptbot"]).select("crawl_run_id", "page_id", "agent", "allowed")


@query(OA.COUNTERS)
def crawl_progress(spark, d):
    return L.crawl_counters(CR.crawled_pages(spark, d), CR.crawl_rows(spark, d))


@query(OA.INVENTORY)
def page_inventory(spark, d):
    latest = CR.crawl_rows(spark, d).select("id").filter("id < 'c3'")
    return L.page_inventory(CR.crawled_pages(spark, d), latest, status="fetched", words="shared").select("crawl_run_id", "id", "url", "title")


def _audited(spark, d):
    return CR.crawl_rows(spark, d), CR.crawled_pages(spark, d), CR.robots_rows(spark, d)


@query(OA.PAGE_RULES)
def audit_page_rules(spark, d):
    return A.page_outcomes(*_audited(spark, d)).drop("evidence")


@query(OA.SITE_RULES)
def audit_site_rules(spark, d):
    return A.site_outcomes(*_audited(spark, d)).drop("evidence")


@query(OA.COVERAGE)
def audit_rule_coverage(spark, d):
    return A.audit(*_audited(spark, d))["coverage"].drop("scope")


@query(OA.FINDINGS)
def audit_rule_findings(spark, d):
    return A.audit(*_audited(spark, d))["findings"].drop("evidence", "title")


@query(OA.RUNS)
def audit_run_rows(spark, d):
    crawls, pages, _ = _audited(spark, d)
    runs = A.audit_runs(crawls, pages)
    return A.unsaved(runs, runs.filter("crawl_run_id = 'c0'")).select("crawl_run_id", "rule_version", "pages_analyzed", F.size("warnings").alias("n_warnings"))


# What SQL can't say: HTML is parsed, URLs are resolved, JSON-LD is walked.


@query(O.EXTRACTED)
def extracted_pages(spark, d):
    return B.crawl(spark, d)[1].select("id", "crawl_run_id", "title", "word_count", "language", "text_hash", F.size("internal_links").alias("internal_links"))


@query()
def link_graph(spark, d):
    pages = LI.keyed_pages(B.crawl(spark, d)[1])
    return LI.link_edges(LI.page_links(pages), LI.resolve_links(pages))


@query()
def audit_coverage(spark, d):
    return A.audit(*B.crawl(spark, d))["coverage"]


@query()
def audit_findings(spark, d):
    return A.audit(*B.crawl(spark, d))["findings"]


@query()
def page_readiness(spark, d):
    crawls, pages = B.crawl(spark, d)
    brands = crawls.select("brand_id", F.array(F.lit("the")).alias("aliases"))
    out = C.readiness(C.content_sample(pages), brands).withColumns({c: F.lit(None).cast("double") for c in ("direct_answer", "specificity", "commercial")})
    return C.score(out)


@query()
def fetch_states(spark, d):
    log = B.read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("crawl_run_id"), F.col("page_id").alias("seq"), "url", F.col("url").alias("final_url"), (F.col("page_id") % 7 != 0).alias("allowed"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"))
    return P.classify_fetches(log).select("seq", "status", "error")
