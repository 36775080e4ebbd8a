"""More registered queries: validated model output, action plan, imports, exports and overviews, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import text as T
from ..functions import urls as U
from ..functions.jsonld import jsonld_summary
from ..operators import content as C
from ..operators import facts as FA
from ..operators import ledger as L
from ..operators import questions as Q
from ..operators import validate as VA
from ..operators import visibility as V
from ..sources import pages as P
from ..storage import shared_folder, stored
from . import crawls as CR
from . import frames as B
from . import oracle as O
from . import oracle_audit as OA
from .catalog import _content, _issues, _mentions, query


def _joined(name: str):
    return F.array_join(name, ",").alias(name)


# Validation of model output.


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id END AS k, CASE event_id % 4 WHEN 2 THEN 'json' WHEN 3 THEN 'whole,json' ELSE '' END AS reasons FROM events""")
def parsed_responses(spark, d):
    body = F.concat(F.lit('{"k": '), F.col("event_id"), F.when(F.col("event_id") % 4 == 2, "").otherwise("}"))
    rows = B.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("response"), F.when(F.col("event_id") % 4 == 3, "length").otherwise("stop").alias("finish_reason"))
    return VA.parse_model_json(rows, "k bigint").select("event_id", "parsed.k", _joined("reasons"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'criteria' END, CASE WHEN s_suppkey % 4 = 0 THEN 'sophistication' END, CASE WHEN s_suppkey % 6 > 4 THEN 'importance' END,
  CASE WHEN count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 10) > 1 THEN 'distinct' END], lambda x: x IS NOT NULL), ',') AS reasons FROM supplier""")
def valid_personas(spark, d):
    k = F.col("s_suppkey")
    rows = B.read(spark, d, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("project_id"), F.concat(F.when(k % 2 == 0, " Role ").otherwise("role "), k % 10).alias("role"), F.lit("firm").alias("company_type"), F.lit("pain").alias("primary_pain"),
        F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("c"))).alias("criteria"), F.array(F.lit("o")).alias("objections"), F.when(k % 4 == 0, "expert").otherwise("low").alias("sophistication"), (k % 6 + 1).alias("importance"))
    return VA.validate_personas(rows).select("s_suppkey", _joined("reasons"))


@query(f"""WITH {O._QUESTIONS} SELECT id, array_to_string(list_filter([CASE WHEN NOT length(trim(text)) BETWEEN 12 AND 600 THEN 'text' END, CASE WHEN persona_id = 'p3' THEN 'persona' END, CASE WHEN id % 7 = 0 THEN 'type' END, CASE WHEN id % 6 > 4 THEN 'brands' END,
  CASE WHEN id % 4 = 0 THEN 'needs' END], lambda x: x IS NOT NULL), ',') AS reasons FROM questions""")
def valid_questions(spark, d):
    k = F.col("id")
    brands = F.slice(F.array(*(F.lit(f"b{n}") for n in range(5))), F.lit(1), (k % 6).cast("int"))
    rows = B.questions(spark, d).withColumns({"type": F.when(k % 7 == 0, "odd").otherwise("pricing"), "expected_brand_ids": brands, "target_fact_ids": F.array(F.lit("f")), "target_fact_needs": F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("why")))})
    personas = B.questions(spark, d).select(F.col("persona_id").alias("id")).distinct().filter("id <> 'p3'")
    return VA.validate_questions(rows, personas, ["pricing"]).select("id", _joined("reasons"))


@query(rf"""WITH {O._ANSWERS}, a AS (SELECT *, conv_id % 5 AS c, regexp_matches(raw[1:60], '(?i)(^|[^\p{{L}}\p{{N}}])(the|of)($|[^\p{{L}}\p{{N}}])') AS named FROM answers)
SELECT answer_id, array_to_string(list_filter([CASE WHEN c = 1 THEN 'unique_brands' END, CASE WHEN c = 2 THEN 'entities' END, CASE WHEN NOT named OR c = 1 THEN 'brands' END, CASE WHEN c = 3 THEN 'claims' END, CASE WHEN c = 4 THEN 'evidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a""")
def valid_analyses(spark, d):
    """Answers by their first words: brands twice, an entity that isn't named, an unknown fact, a judgment without one, by the conversation's number."""
    c = F.split("answer_id", "-")[0].cast("long") % 5
    quote = F.substring("raw", 1, 60)
    brand = lambda id: F.struct(F.lit(id).alias("brand_id"), quote.alias("quote"))
    brands = F.when(c == 1, F.array(brand("b1"), brand("b1"), brand("zz"))).otherwise(F.array(brand("b1")))
    ids = F.when(c == 3, F.array(F.lit("f1"), F.lit("zz"))).when(c == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("f1")))
    claims = F.array(F.struct(quote.alias("quote"), F.when(c == 0, "unverifiable").otherwise("supported").alias("classification"), ids.alias("fact_ids")))
    entities = F.array(F.struct(quote.alias("quote"), F.when(c == 2, "no such name").otherwise(F.substring("raw", 1, 1)).alias("name")))
    answers = B.answers(spark, d).select("experiment_id", "answer_id", "raw", F.struct(brands.alias("brands"), claims.alias("claims"), entities.alias("entities")).alias("analysis"))
    facts = B.brands(spark).select("experiment_id").distinct().withColumn("fact_id", F.lit("f1"))
    return VA.validate_analysis(answers, B.brands(spark), facts).select("answer_id", _joined("reasons"))


@query("""SELECT doc_id AS page_id, array_to_string(list_filter([CASE WHEN doc_id % 6 = 1 THEN 'unique_matches' END, CASE WHEN doc_id % 6 = 2 THEN 'matches' END, CASE WHEN doc_id % 6 = 3 THEN 'products' END, CASE WHEN doc_id % 6 = 4 THEN 'gaps' END,
  CASE WHEN doc_id % 6 = 5 THEN 'ratings' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents WHERE text <> ''""")
def valid_semantics(spark, d):
    docs, k = B.read(spark, d, "documents").filter("text <> ''"), F.col("doc_id") % 6
    quote, absent = F.substring("text", 1, 30), F.lit("\u0001 no such words")
    match = lambda q: F.struct(q.alias("question_id"), quote.alias("quote"))
    matches = F.when(k == 1, F.array(match(F.lit("q0")), match(F.lit("q0")))).when(k == 2, F.array(match(F.lit("zz")))).otherwise(F.array(match(F.lit("q0")), match(F.lit("q1"))))
    products = F.array(F.struct(quote.alias("quote"), F.when(k == 3, absent).otherwise(F.substring("text", 1, 1)).alias("name")))
    gaps = F.array(F.struct(F.when(k == 4, absent).otherwise(quote).alias("quote")))
    rated = lambda r, q: F.struct(F.lit(r).alias("rating"), q.alias("quote"))
    ratings = docs.select(F.col("doc_id").alias("page_id"), matches.alias("matches"), products.alias("products"), gaps.alias("evidence_gaps"), rated(0.5, F.when(k == 5, F.lit("")).otherwise(quote)).alias("direct_answer"), rated(0.0, F.lit("")).alias("specificity"), rated(1.0, quote).alias("commercial"))
    questions = docs.select(F.concat(F.lit("q"), k).alias("id")).distinct()
    return VA.validate_semantics(ratings, docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("excerpt")), questions).select("page_id", _joined("reasons"))


@query(f"""WITH {O._ANSWERS}, f AS (SELECT *, split_part(answer_id, '-', 1)::BIGINT AS c FROM mentions)
SELECT experiment_id, answer_id, brand_id, first_position, c % 3 = 0 AND c % 4 < 2 AND c % 5 > 0 AS recommended, CASE WHEN c % 3 = 0 AND c % 4 < 2 AND c % 5 > 0 THEN 2 END AS recommendation_position,
  CASE WHEN c % 5 = 0 THEN 'neutral' ELSE (['strong', 'moderate', 'weak', 'neutral'])[c % 4 + 1] END AS strength FROM f""")
def guarded_mentions(spark, d):
    found = stored(V.find_mentions(B.answers(spark, d), B.brands(spark)))
    c = F.split("answer_id", "-")[0].cast("long")
    strength = F.get(F.array(*map(F.lit, ("strong", "moderate", "weak", "neutral"))), c % 4)
    judged = found.filter(c % 5 > 0).select("experiment_id", "answer_id", "brand_id", (c % 3 == 0).alias("recommended"), F.lit(2).alias("recommendation_position"), strength.alias("strength"))
    return V.guarded_mentions(found, judged)


@query("""SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 > 0 THEN floor(20 * (s_suppkey % 5 / 4::DOUBLE) * 10 + 0.5) / 10 END AS direct_answer, CASE WHEN s_suppkey % 3 > 0 THEN floor(15 * 0.5::DOUBLE * 10 + 0.5) / 10 END AS specificity, NULL::DOUBLE AS commercial,
  CASE WHEN s_suppkey % 3 > 0 THEN 'completed' ELSE 'partial' END AS status, CASE WHEN s_suppkey % 3 > 0 THEN 'p' || (s_suppkey % 4) END AS persona_ids, CASE WHEN s_suppkey % 3 > 0 THEN 's' || (s_suppkey % 2) END AS stages FROM supplier""")
def merged_ratings(spark, d):
    pages, k = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id")), F.col("page_id")
    rated = lambda c: F.struct(c.cast("double").alias("rating"))
    ratings = pages.filter(k % 3 > 0).select("page_id", F.array(F.struct(k.alias("question_id"))).alias("matches"), rated(k % 5 / 4).alias("direct_answer"), rated(F.lit(0.5)).alias("specificity"), rated(F.lit(None)).alias("commercial"), F.array().cast("array<string>").alias("evidence_gaps"))
    questions = pages.select(k.alias("id"), F.concat(F.lit("p"), k % 4).alias("persona_id"), F.concat(F.lit("s"), k % 2).alias("stage"))
    return C.merge_ratings(pages, ratings, questions).select("page_id", "direct_answer", "specificity", "commercial", "status", _joined("persona_ids"), _joined("stages"))


# The action plan, by kinds of actions and as a whole.


def _claims(spark, d):
    rows = B.read(spark, d, "lineitem").filter("l_linenumber <= 2").select(
        F.lit("p").alias("project_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("answer_id"), F.lit("a claim").alias("text"), F.concat(F.lit("quote "), "l_orderkey").alias("quote"), F.lit(0.8).alias("confidence"),
        F.when(F.col("l_linenumber") == 1, "contradicted").otherwise("supported").alias("classification"), F.array("l_partkey", F.lit(-1).cast("long")).alias("fact_ids"))
    facts = B.read(spark, d, "part").filter("p_partkey % 5 = 0").select(F.lit("p").alias("project_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return C.claim_actions(rows, facts)


_TARGETS = "p"


def _evidence(spark, d):
    pages = B.read(spark, d, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("brand_id"), F.concat(F.lit("https://a.com/"), F.col("doc_id")).alias("url"), F.array(F.struct(F.substring("text", 1, 12).alias("quote")), F.struct(F.lit("fastest").alias("quote"))).alias("evidence_gaps"))
    return C.evidence_actions(pages, pages.select(F.lit("p").alias("project_id"), "brand_id", F.when(F.col("brand_id") == "en", "target").otherwise("competitor").alias("kind")).distinct())


def _details(spark, d):
    facts = B.facts(spark, d).withColumn("project_id", F.lit("p"))
    return C.detail_actions(facts, facts.select("brand_id", F.when(F.col("brand_id").endswith("1"), "target").otherwise("competitor").alias("kind")).distinct())


def _sources(spark, d):
    cited = B.read(spark, d, "pages").select(F.lit("p").alias("project_id"), F.col("page_id").alias("ordinal"), F.lit(0).alias("pos"), "url", U.domain_key(F.col("url")).alias("domain"))
    brands = cited.filter("domain LIKE '%.org'").select("project_id", F.concat(F.lit("https://"), "domain").alias("domain"))
    return C.source_actions(C.third_party_sources(cited, brands))


def _shown(actions):
    return actions.select("project_id", "id", "title", "category", "priority", F.round("confidence", 9).alias("confidence"), "effort", "month", F.array_join("urls", " ").alias("urls"), F.array_join("evidence", " | ").alias("evidence"))


_PRIORITY = "floor({impact} * 0.35::DOUBLE + {gap} * 0.25::DOUBLE + {confidence} * 100 * 0.15::DOUBLE + 80 * 0.15::DOUBLE + {ease} * 0.1::DOUBLE + 0.5::DOUBLE)::INTEGER"


def _action(source: str, id: str, title: str, category: str, impact, gap, confidence, effort: str, month, urls: str, evidence: str, step: int) -> str:
    ease = {"small": 100, "medium": 60}.get(effort.strip("'"), "(CASE effort WHEN 'small' THEN 100 WHEN 'medium' THEN 60 ELSE 20 END)")
    return f"SELECT 'p' AS project_id, {id} AS id, {title} AS title, '{category}' AS category, {_PRIORITY.format(impact=impact, gap=gap, confidence=f'{confidence}::DOUBLE', ease=ease)} AS priority, {confidence}::DOUBLE AS confidence, {effort} AS effort, {month}::INTEGER AS month, {urls} AS urls, {evidence} AS evidence, {step} AS step FROM {source}"


_ID = "sha256({})[1:20]"
_CLAIMS = _action(
    "(SELECT l_orderkey || '-' || l_linenumber AS answer_id, 'quote ' || l_orderkey AS quote, array_to_string(list_sort(list(DISTINCT p_name)), ' | ') AS names FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND p_partkey % 5 = 0 GROUP BY ALL)",
    _ID.format("answer_id || 'a claim'"), "'Clarify a conflicting product claim'", "Product facts", 90, 85, 0.8, "'small'", 1, "''", "quote || ' | ' || names", 3)
_EVIDENCE = _action("(SELECT doc_id, unnest([text[1:12], 'fastest']) AS quote FROM documents WHERE doc_id % 4 = 0 AND lang = 'en')", _ID.format("doc_id || quote"), "'Add support for a performance claim'", "Evidence and original research", 80, 65, 0.6, "'medium'", 2, "'https://a.com/' || doc_id", "quote", 4)
_DETAILS = _action(
    f"(WITH {O._FACTS} SELECT subject, list_sort(list(DISTINCT value)) AS v FROM facts WHERE ends_with(brand_id, '1') GROUP BY subject HAVING count(DISTINCT value) > 1)",
    _ID.format("concat_ws('|', 'product', subject, 'size')"), "'Clarify differing company details'", "Entity and message consistency", 85, 70, 0.65, "'small'", 1, "''", "array_to_string(v, ' | ')", 5)
_SOURCES = _action(
    f"(SELECT list(url ORDER BY first, url) AS u FROM (SELECT url, min(page_id) AS first FROM pages WHERE NOT ends_with({O._HOST}, '.org') GROUP BY url ORDER BY first, url LIMIT 5))",
    _ID.format("'authority' || array_to_string(u, ',')"), "'Review sources appearing in the saved answers'", "Third-party authority", 60, 50, 0.5, "'medium'", 3, "array_to_string(u, ' ')", "array_to_string(u, ' | ')", 6)
_TECHNICAL = _action(
    f"(WITH {O._ISSUES} SELECT * FROM i WHERE severity <> 'observation' ORDER BY severity <> 'error', rule_id, url LIMIT 40)",
    _ID.format("rule_id || url"), "'Resolve: ' || rule_id", "Technical accessibility", 70, "(CASE severity WHEN 'error' THEN 90 ELSE 55 END)", 0.9, "'small'", 1, "url", "rule_id", 1)
_GAP = _action(
    f"(WITH {O._GAPS}, u AS (SELECT l_partkey AS q, list_sort(list(DISTINCT 'https://a.com/' || l_suppkey) FILTER (s_nationkey % 2 = 0))[1:20] AS a, list_sort(list(DISTINCT 'https://a.com/' || l_suppkey) FILTER (s_nationkey % 2 = 1))[1:20] AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) "
    "SELECT gaps.*, p_name, coalesce(a, []) || coalesce(b, []) AS u FROM gaps JOIN part ON p_partkey = question_id LEFT JOIN u ON q = question_id)",
    _ID.format("'p|' || question_id"), "CASE action WHEN 'create' THEN 'Answer: ' ELSE 'Improve the answer to: ' END || p_name", "Commercial content", "impact", "(CASE WHEN rivals > 0 THEN 80 ELSE 60 END)", "confidence", "effort",
    "(CASE effort WHEN 'small' THEN 1 ELSE 2 END)", "array_to_string(u, ' ')", "array_to_string(u, ' | ')", 2)
_REPEAT = _action("(SELECT 1)", "'repeat-measurement'", "'Repeat the same buyer questions after changes'", "Monitoring", 70, 30, 1.0, "'small'", 3, "''", "'5'", 7)
_ALL = " UNION ALL ".join((_TECHNICAL, _GAP, _CLAIMS, _EVIDENCE, _DETAILS, _SOURCES, _REPEAT))
_PLAN = f"""WITH a AS ({_ALL}), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY project_id, id ORDER BY step DESC, priority DESC, title) = 1),
plan AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, step, id)::INTEGER AS place FROM l)"""


@query(f"SELECT * EXCLUDE step FROM ({_CLAIMS})")
def claim_actions(spark, d):
    return _shown(_claims(spark, d))


@query(f"SELECT * EXCLUDE step FROM ({_EVIDENCE})")
def evidence_actions(spark, d):
    return _shown(_evidence(spark, d))


@query(f"SELECT * EXCLUDE step FROM ({_DETAILS})")
def detail_actions(spark, d):
    return _shown(_details(spark, d))


@query(f"SELECT * EXCLUDE step FROM ({_SOURCES})")
def source_actions(spark, d):
    return _shown(_sources(spark, d))


def _plan(spark, d):
    issues = _issues(spark, d).withColumn("project_id", F.lit("p"))
    projects = spark.createDataFrame([("p", 5)], "project_id string, answers int")
    gaps = C.content_gaps(*_content(spark, d))
    return C.action_plan(C.technical_actions(issues), C.gap_actions(gaps), _claims(spark, d), _evidence(spark, d), _details(spark, d), _sources(spark, d), C.repeat_actions(projects))


@query(f"{_PLAN} SELECT place, id, title, category, priority, month FROM plan")
def action_plan_rows(spark, d):
    return _plan(spark, d).select("place", "id", "title", "category", "priority", "month")


def _report(spark, d):
    empty = spark.createDataFrame([], "project_id string, page_id string, url string, score double, evaluated_weight int, rank int")
    return sinks.report_tables(empty, empty, empty, empty, empty, _plan(spark, d))


@query(f"{_PLAN} SELECT project_id, month, count(*) AS actions, max(priority) AS priority FROM plan GROUP BY ALL")
def report_actions_by_month(spark, d):
    return _report(spark, d)["actions_by_month"]


@query(f"{_PLAN} SELECT id, title, top AS place FROM (SELECT id, title, row_number() OVER (ORDER BY priority DESC, id)::INTEGER AS top FROM plan) WHERE top <= 5")
def report_top_actions(spark, d):
    return _report(spark, d)["top_actions"].select("id", "title", "place")


# Imports and exports.


@query("SELECT '\"' || event_id || '\",\"' || CASE WHEN event_id % 3 = 0 THEN '''=say \"\"' || event_type || '\"\"' ELSE event_type END || '\"' AS value FROM events")
def csv_file_lines(spark, d):
    """Written as CSV files and read as text, but for the header of each."""
    rows, folder = B.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('=say "'), "event_type", F.lit('"'))).otherwise(F.col("event_type")).alias("kind")), shared_folder(spark)
    sinks.write_csv(rows, folder)
    return spark.read.option("lineSep", "\r\n").text(folder).filter(~F.col("value").endswith('"event_id","kind"'))


@query("SELECT (user_id)::VARCHAR AS project_id, event_id AS id, value AS cost, NULL::VARCHAR AS settings FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def project_backup(spark, d):
    """The first project's ledger, written as JSON and read again."""
    usage = B.usage(spark, d).select(F.col("project_id").cast("string"), "id", "cost", F.lit("secret").alias("settings"), F.lit("w").alias("worker_id"))
    first, folder = usage.agg(F.min(F.col("project_id").cast("long")).cast("string")).first()[0], shared_folder(spark)
    sinks.export_project({"usage": usage}, first, folder)
    return spark.read.schema("id long, cost double, settings string, project_id string").json(f"{folder}/usage").select("project_id", "id", "cost", "settings")


def _imported(spark, d):
    """Turns of conversations as an imported CSV file, and its rows read again."""
    k, folder = F.col("conv_id"), shared_folder(spark)
    rows = B.read(spark, d, "conversations").filter("role = 'assistant'").select(
        F.concat(F.lit("prov"), k % 2).alias("provider"), F.concat(F.when(k % 2 == 0, " Question ").otherwise("question "), k % 8).alias("question"), F.when(k % 9 == 0, " ").otherwise(F.concat(k, F.lit('-"'), "turn", F.lit('"\n'), "text")).alias("answer"),
        F.when(k % 7 == 0, "never").when(k % 5 == 0, "2999-01-01").otherwise("2025-01-01").alias("observed_at"), F.when(k % 3 == 0, "https://a.com; https://b.com").otherwise("").alias("citation_urls"))
    sinks.write_csv(rows, folder)
    good, _ = P.read_answer_csv(spark, folder)
    library = B.read(spark, d, "conversations").select((k % 8).alias("n")).distinct().filter("n < 4").select(F.concat(F.lit("q"), "n").alias("id"), F.concat(F.lit("QUESTION "), "n").alias("text"), F.lit("vendor_comparison").alias("stage"), F.lit("pricing").alias("type"), F.lit("p1").alias("persona_id"), F.lit("EU").alias("geography"), F.lit(5).alias("intent"))
    return P.normalize_imports(good, library, "2026-01-01")


_SEEN = "CASE WHEN conv_id % 7 = 0 THEN 'unreadable time' WHEN conv_id % 5 = 0 THEN 'time in the future' END"
_WHY = f"CASE WHEN conv_id % 9 = 0 THEN 'empty answer' ELSE {_SEEN} END"


@query(f"""SELECT 'prov' || (conv_id % 2) AS provider, conv_id || '-"' || turn || '"' || chr(10) || text AS raw, CASE WHEN conv_id % 8 < 4 THEN 'q' || (conv_id % 8) END AS question_id, CASE WHEN conv_id % 8 < 4 THEN 'vendor_comparison' ELSE 'solution_research' END AS stage,
  CASE WHEN conv_id % 8 < 4 THEN 'pricing' ELSE 'category_recommendation' END AS type, CASE WHEN conv_id % 8 < 4 THEN 'EU' ELSE 'Unspecified' END AS geography, CASE WHEN conv_id % 8 < 4 THEN 5 ELSE 3 END AS intent, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS n_urls
  FROM conversations WHERE role = 'assistant' AND {_WHY} IS NULL""")
def imported_answers(spark, d):
    return _imported(spark, d)[0].select("provider", "raw", "question_id", "stage", "type", "geography", "intent", F.size("supplied").alias("n_urls"))


@query(f"SELECT {_WHY} AS reason, count(*) AS n FROM conversations WHERE role = 'assistant' AND {_WHY} IS NOT NULL GROUP BY 1")
def rejected_imports(spark, d):
    return _imported(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT page_id % 3 AS c, {O._PLAIN} AS url, page_id % 2 = 0 AS is_index FROM pages WHERE page_id % 5 > 0)
SELECT DISTINCT 'c' || c AS crawl_run_id, url, is_index FROM u WHERE ends_with({O._HOST}, '.org') AND {O._HOST} = (SELECT min({O._HOST}) FROM pages WHERE ends_with({O._HOST}, '.org')) AND (is_index OR NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '\\.(txt|xml|json|pdf|zip)$'))""")
def sitemap_urls(spark, d):
    """A sitemap text for each page: indexes, namespaces, CDATA, and DTDs that are left out."""
    k, safe = F.col("page_id"), F.replace("url", F.lit("&"), F.lit("&amp;"))
    loc = F.when(k % 3 == 0, F.concat(F.lit("<![CDATA["), "url", F.lit("]]>"))).otherwise(safe)
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), loc, F.lit("</loc></sitemap></sitemapindex>"))
    pages = F.concat(F.lit('<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url n="1"><s:loc> '), loc, F.lit(" </s:loc></s:url></s:urlset>"))
    host = U.domain_key(F.col("url"))
    home = B.read(spark, d, "pages").select(host.alias("h")).filter("h LIKE '%.org'").agg(F.concat(F.lit("https://"), F.min("h")).alias("home"))
    files = B.read(spark, d, "pages").select(F.concat(F.lit("c"), k % 3).alias("crawl_run_id"), F.concat(F.when(k % 5 == 0, "<!DOCTYPE x>").otherwise(""), F.when(k % 2 == 0, index).otherwise(pages)).alias("xml"))
    return P.read_sitemaps(files.join(F.broadcast(home)))  # home: one row


@query("""WITH RECURSIVE reach(k) AS (SELECT unnest([0, 1, 2]) UNION SELECT unnest([6 * (r.k // 3) + 3 + r.k % 3, 6 * (r.k // 3) + 6 + r.k % 3]) FROM reach r JOIN pages ON page_id = r.k WHERE r.k % 7 <> 6)
SELECT 'c' || k % 3 AS crawl_run_id, 'https://a.example.com/' || k || '.xml' AS url, EXISTS (FROM pages WHERE page_id = k) AND k % 7 <> 6 AS read FROM reach""")
def followed_sitemaps(spark, d):
    """A sitemap index for each page, but for every seventh: those of a crawl name two others each, and themselves."""
    k = F.col("page_id")
    at = lambda n: F.concat(F.lit("https://a.example.com/"), n.cast("string"), F.lit(".xml"))
    row, crawl = F.floor(k / 3), k % 3
    named = F.concat(*(x for n in (6 * row + 3 + crawl, 6 * row + 6 + crawl, k) for x in (F.lit("<sitemap><loc>"), at(n), F.lit("</loc></sitemap>"))))
    own = F.concat(F.lit("c"), crawl.cast("string")).alias("crawl_run_id")
    files = B.read(spark, d, "pages").filter(k % 7 != 6).select(own, at(k).alias("url"), F.concat(F.lit("<sitemapindex>"), named, F.lit("</sitemapindex>")).alias("xml"))
    starts = spark.range(3).select(F.concat(F.lit("c"), "id").alias("crawl_run_id"), at(F.col("id")).alias("url"), F.lit(0).alias("seen"), F.lit("https://a.example.com").alias("home"))
    return P.follow_sitemaps(files, starts, most_files=1_000_000)[1].drop("place")


@query("SELECT event_id, event_type, (props->>'$.k')::INTEGER AS k FROM events")
def stored_tables(spark, d):
    """A stored table whose column of JSON text is parsed."""
    return P.read_tables(spark, d, {"events": {"props": "struct<k:int>"}})["events"].select("event_id", "event_type", "props.k")


@query("""SELECT s_suppkey::VARCHAR AS crawl_run_id, unnest(['*', '*', 'A', 'B']) AS agent, unnest([false, true, false, false]) AS allow, unnest(['^/x' || s_suppkey, '^', '^/y.*z$', '^/y.*z$']) AS pattern, unnest([2 + length(s_suppkey::VARCHAR), 0, 5, 5])::INTEGER AS length FROM supplier""")
def robots_rule_rows(spark, d):
    text = F.concat(F.lit("# c\nUser-agent: *\nDisallow: /x"), "s_suppkey", F.lit(" # why\nDisallow:\n\nUser-agent: A\nuser-agent: B\nDisallow: /y*z$\n"))
    return P.parse_robots(B.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("crawl_run_id"), F.lit("o").alias("origin"), text.alias("text"))).drop("origin")


_LOG = """l AS (SELECT page_id AS k, page_id % 7 AS c, 'https://a.com/p' || page_id AS url, 'https://a.com/p' || (CASE WHEN page_id % 5 = 0 THEN page_id + 7 WHEN page_id % 11 = 0 THEN page_id - 7 ELSE page_id END) AS final,
  CASE WHEN page_id % 13 = 0 THEN 'robots' WHEN page_id % 17 = 0 THEN 'none' WHEN page_id % 19 = 0 THEN '404' WHEN page_id % 23 = 0 THEN 'pdf' ELSE 'ok' END AS s FROM pages),
m AS (SELECT *, row_number() OVER (PARTITION BY c, final, s ORDER BY k) AS n FROM l),
t AS (SELECT m.*, (m.s = 'ok' AND m.n > 1) OR (m.s <> 'robots' AND EXISTS (FROM m f WHERE f.c = m.c AND f.s = 'ok' AND f.n = 1 AND f.final = m.url AND f.k < m.k)) AS again FROM m)"""


@query(f"""WITH {_LOG} SELECT k AS seq, CASE WHEN again THEN 'skipped' ELSE CASE s WHEN 'robots' THEN 'skipped' WHEN 'none' THEN 'failed' WHEN '404' THEN 'failed' WHEN 'pdf' THEN 'skipped' ELSE 'fetched' END END AS status,
  CASE WHEN again THEN 'Already fetched' ELSE CASE s WHEN 'robots' THEN 'Disallowed by robots.txt' WHEN 'none' THEN 'No response' WHEN '404' THEN 'HTTP 404' WHEN 'pdf' THEN 'Not HTML' END END AS error FROM t""")
def fetch_log_states(spark, d):
    k, at = F.col("page_id"), lambda n: F.concat(F.lit("https://a.com/p"), n)
    log = B.read(spark, d, "pages").select(
        (k % 7).alias("crawl_run_id"), k.alias("seq"), at(k).alias("url"), at(F.when(k % 5 == 0, k + 7).when(k % 11 == 0, k - 7).otherwise(k)).alias("final_url"), (k % 13 != 0).alias("allowed"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, 404).otherwise(200).alias("status_code"), F.when(k % 23 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("string").alias("error"))
    return P.classify_fetches(log).select("seq", "status", "error")


# Content, facts and overviews.

_POINTS = "floor({w} * ({n}) / {d}::DOUBLE * 10 + 0.5) / 10"
_EXCERPT_SAMPLE = f"""{OA._PAGES}, good AS (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY {OA._PATH} IN ('', '/') DESC, url) AS place FROM pk WHERE status_code = 200 AND length(trim(t)) > 0)"""


def _sampled(spark, d):
    return C.content_sample(CR.crawled_pages(spark, d))


@query(f"WITH {_EXCERPT_SAMPLE} SELECT crawl_run_id, id, place::INTEGER AS place, length(t[1:12000])::INTEGER AS n_excerpt FROM good WHERE place <= 12")
def content_samples(spark, d):
    return _sampled(spark, d).select("crawl_run_id", "id", "place", F.length("excerpt").alias("n_excerpt"))


@query(rf"""WITH {_EXCERPT_SAMPLE}, s AS (SELECT * FROM good WHERE place <= 12),
c AS (SELECT id AS page_id, CASE WHEN has_signals THEN {_POINTS.format(w=15, d=3, n=r"(k % 4 > 0)::INT + (k % 4 = 0)::INT + regexp_matches(t, '(?i)\b(?:case study|methodology|research|customer story)\b')::INT")} END AS evidence,
  {_POINTS.format(w=15, d=3, n="(k % 6 IN (1, 2, 5))::INT + (k % 6 IN (3, 4, 5))::INT + coalesce(title <> '' AND meta_description <> '', false)::INT")} AS structure,
  {_POINTS.format(w=15, d=3, n=f"contains(lower(t), 'the')::INT + coalesce(has_signals AND k % {CR.CRAWLS} IN (2, 3), false)::INT + coalesce(has_signals AND k % {CR.CRAWLS} = 1 AND k % 4 = 1, false)::INT")} AS entity,
  {_POINTS.format(w=10, d=5, n="1 + (k % 12 <> 0)::INT + (coalesce(canonical_url, '') <> '')::INT + (length(t) >= 100)::INT + (k % 10 NOT IN (0, 1))::INT")} AS technical,
  CASE WHEN has_signals AND (k % 5 > 1 OR k % 3 < 2) THEN CASE WHEN k % 3 = 0 AND k % 5 < 2 THEN 2.5 WHEN k % 3 = 1 THEN 2.5 ELSE 2.5 END END AS freshness FROM s)
SELECT *, (15 + CASE WHEN evidence IS NULL THEN 0 ELSE 15 END + 15 + 10 + CASE WHEN freshness IS NULL THEN 0 ELSE 5 END)::INTEGER AS evaluated_weight, floor(coalesce(evidence, 0) + structure + entity + technical + coalesce(freshness, 0) + 0.5)::BIGINT AS score FROM c""")
def readiness_scores(spark, d):
    brands = CR.crawl_rows(spark, d).select("brand_id", F.array(F.lit("the")).alias("aliases"))
    out = C.readiness(_sampled(spark, d), brands).withColumns({c: F.lit(None).cast("double") for c in ("direct_answer", "specificity", "commercial")})
    return C.score(out).select("page_id", "evidence", "structure", "entity", "technical", "freshness", "evaluated_weight", F.col("score").cast("long").alias("score"))


@query(f"""WITH {OA._PAGES} SELECT id, CASE WHEN {OA._PATH} = '/' THEN 'home' WHEN regexp_matches({OA._PATH}, '/blog/.') THEN 'editorial' WHEN starts_with({OA._PATH}, '/products/') THEN 'product' WHEN starts_with({OA._PATH}, '/faq/') THEN 'faq' ELSE 'other' END AS kind,
  CASE k % 12 WHEN 0 THEN 'robots: noindex, follow' WHEN 1 THEN 'googlebot: NONE' ELSE '' END AS noindex, (['', '', 'Organization', 'Product', 'FAQPage,Question', 'FAQPage,Organization,Question', 'BreadcrumbList', 'FAQPage', 'Organization', 'BreadcrumbList,Product'])[k % 10 + 1] AS types,
  (['', '', '', '', 'the,of', 'der,die', '', '', '', ''])[k % 10 + 1] AS faq_texts FROM pk""")
def page_traits(spark, d):
    valid = F.transform(F.filter("structured_data", lambda b: b["valid"]), lambda b: b["value"])
    path = U.url_path(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))
    rows = CR.crawled_pages(spark, d).withColumns({"ld": jsonld_summary(valid), "kind": U.page_kind(path, F.lit(False))})
    return rows.select("id", "kind", F.array_join(T.noindex_directives(F.col("robots_directives")), ",").alias("noindex"), F.array_join("ld.types", ",").alias("types"), F.array_join("ld.faq_texts", ",").alias("faq_texts"))


@query(f"WITH {O._QUESTIONS} SELECT id FROM questions WHERE status = 'active' AND persona_id = 'p1' AND NOT selected AND contains(lower(text), 'de')")
def filtered_questions(spark, d):
    return Q.filter_questions(B.questions(spark, d), status="active", persona="p1", selected=False, words="DE").select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 9 <> 0 AND contains(lower(p_type || ' ' || 'size' || ' ' || p_size), 'small')")
def filtered_facts(spark, d):
    return FA.filter_facts(B.facts(spark, d), category="product", words="SMALL").select("id")


@query(f"""WITH {O._QUESTIONS}, u AS (SELECT id AS question_id, unnest([id % 50, id % 50 + 1]) AS fact_id FROM questions)
SELECT question_id, fact_id, CASE WHEN fact_id % 2 = 0 AND question_id % 3 = 0 THEN 'then' ELSE p_name END AS value FROM u LEFT JOIN part ON p_partkey = fact_id""")
def question_evidence(spark, d):
    questions = B.questions(spark, d).select("id", F.array(F.col("id") % 50, F.col("id") % 50 + 1).alias("target_fact_ids"))
    snapshot = questions.filter("id % 3 = 0").select(F.col("id").alias("question_id"), F.explode("target_fact_ids").alias("fact_id"), F.lit("then").alias("value")).filter("fact_id % 2 = 0")
    return Q.question_evidence(questions, snapshot, B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value")))


@query("SELECT l_partkey AS fact_id, l_orderkey * 10 + l_linenumber AS id, row_number() OVER w::INTEGER AS revision, lag(l_quantity) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber)")
def fact_history(spark, d):
    rows = B.read(spark, d, "lineitem").select(F.col("l_partkey").alias("fact_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("created_at"))
    return L.fact_history(rows).select("fact_id", "id", "revision", "before")


@query(f"WITH {O._QUESTIONS}, e AS (SELECT project_id, ceil(sum(length(text) / 4 + 5000) * 3)::BIGINT + count(*) * 12000 AS used FROM questions WHERE selected GROUP BY 1) SELECT project_id AS experiment_id, greatest(0, 1000000 * (project_id::BIGINT + 1) - used) AS remaining FROM e")
def run_allowance(spark, d):
    asked = B.questions(spark, d).filter("selected").withColumnRenamed("project_id", "experiment_id")
    allowance = asked.select("experiment_id").distinct().withColumn("tokens", (F.col("experiment_id").cast("long") + 1) * 1_000_000)
    return V.run_estimate(asked, 3, 2000, allowance=allowance).select("experiment_id", "remaining")


@query(f"""WITH {O._ANSWERS}, {O._QUESTIONS}, {O._FACTS}, {O._ISSUES}, hits AS (SELECT DISTINCT experiment_id, answer_id FROM mentions JOIN brands USING (experiment_id, brand_id) WHERE kind = 'target'),
p AS (SELECT DISTINCT project_id FROM q0), run AS (SELECT project_id, CASE WHEN project_id::INT < 2 THEN (project_id::INT + 5)::VARCHAR ELSE project_id END AS last_run FROM p),
x AS (SELECT brand_id, subject FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT project_id, last_run, (SELECT count(*) FROM good WHERE experiment_id = last_run) AS eligible_answers, (SELECT count(*) FROM good JOIN hits USING (experiment_id, answer_id) WHERE experiment_id = last_run) AS target_mentions,
  1::BIGINT AS actions, 'Repeat the same buyer questions after changes' AS first_action, (SELECT count(*) FROM i WHERE crawl_run_id::VARCHAR = project_id AND severity <> 'observation') AS attention, (SELECT count(*) FROM i WHERE crawl_run_id::VARCHAR = project_id AND severity = 'observation') AS observations,
  (SELECT count(*) FROM x WHERE right(brand_id, 1) = project_id) AS conflicts, (SELECT count(*) FROM facts WHERE right(brand_id, 1) = project_id) AS facts,
  (SELECT count(*) FROM questions q WHERE q.project_id = run.project_id) AS questions, (SELECT count(*) FROM questions q WHERE q.project_id = run.project_id AND selected) AS selected FROM run""")
def project_overview(spark, d):
    projects = B.questions(spark, d).select("project_id").distinct()
    runs = B.brands(spark).select("experiment_id").distinct().select((F.col("experiment_id").cast("int") % 5).cast("string").alias("project_id"), "experiment_id", F.col("experiment_id").alias("created_at"))
    plan = C.action_plan(C.repeat_actions(projects.withColumn("answers", F.lit(5))))
    issues = _issues(spark, d).withColumn("project_id", F.col("crawl_run_id").cast("string"))
    facts = B.facts(spark, d).withColumn("project_id", F.substring("brand_id", -1, 1))
    return L.project_overview(projects, B.answers(spark, d), B.brands(spark), _mentions(spark, d), runs, plan, issues, facts, B.questions(spark, d))
