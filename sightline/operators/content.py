"""Content readiness of pages, gaps in coverage, and the ranked action plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, half_up, stable_id
from ..functions.urls import domain_key
from .facts import contradictions
from .ranking import placed

#: Components of a page's score and their weights (fixed values).
WEIGHTS = {"direct_answer": 20, "specificity": 15, "evidence": 15, "structure": 15, "entity": 15, "technical": 10, "freshness": 5, "commercial": 5}
#: Kind of a gap by the question's type (fixed values); others are "Question coverage".
GAP_KINDS = {
    "pricing": "Pricing clarity", "security_compliance": "Security evidence", "integration": "Integration coverage", "product_comparison": "Comparison coverage", "alternatives": "Comparison coverage",
    "evidence_proof": "Customer proof", "best_for_industry": "Use-case coverage", "best_for_use_case": "Use-case coverage",
}


def _points(weight: int, ratio: Column) -> Column:
    return half_up(weight * ratio * 10) / 10


def content_sample(pages: DataFrame, limit: int = 12, characters: int = 12_000) -> DataFrame:
    """Each crawl's pages with HTTP 200 and text: the home page first, then by URL; with the excerpt that is looked at."""
    text = F.coalesce(F.nullif(F.col("technical_signals.main_text"), F.lit("")), F.col("visible_text"))
    rows = pages.filter((F.col("status_code") == 200) & (F.length(F.trim(text)) > 0))
    home = F.coalesce(F.try_parse_url(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")), F.lit("PATH")), F.lit("")).isin("", "/")
    rank = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc(home), "url"))
    return rows.withColumn("place", rank).filter(F.col("place") <= limit).withColumn("excerpt", F.substring(text, 1, characters))


def identical_pages(pages: DataFrame, listed: int = 20) -> DataFrame:
    """(brand_id, id, text_hash, first, n, similar): pages of a brand with the same text.

    All n pages of a group have its text_hash and its smallest id ``first``; ``similar`` is a sample of up to ``listed`` others.
    """
    rows = pages.filter("text_hash IS NOT NULL").select("brand_id", "text_hash", "id")
    near = rows.withColumn("_k", F.row_number().over(Window.partitionBy("brand_id", "text_hash").orderBy("id"))).filter(F.col("_k") <= listed + 1)
    samples = near.groupBy("brand_id", "text_hash").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    sizes = rows.groupBy("brand_id", "text_hash").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = samples.join(sizes, ["brand_id", "text_hash"])
    return rows.join(groups, ["brand_id", "text_hash"]).select("brand_id", "id", "text_hash", "first", "n", F.slice(F.array_except("ids", F.array("id")), 1, listed).alias("similar"))


def readiness(pages: DataFrame, brands: DataFrame) -> DataFrame:
    """Points of the five components that rules judge; null where there is no evidence. brands: brand_id, aliases."""
    s = F.col("technical_signals")
    text = F.coalesce(F.nullif(s["main_text"], F.lit("")), F.col("visible_text"), F.lit(""))
    p = pages.join(brands.select("brand_id", "aliases"), "brand_id", "left")
    one = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    level = lambda k: F.size(F.filter("headings", lambda h: h["level"] == k))
    evidence = one(F.size(s["authors"]) > 0) + one(F.size("external_links") > 0) + one(text.rlike(r"(?i)\b(?:case study|methodology|research|customer story)\b"))
    structure = one(level(1) == 1) + one(level(2) > 0) + one((F.col("title") != "") & (F.col("meta_description") != ""))
    named = F.exists("aliases", lambda a: F.contains(comparable(text), comparable(a)))
    entity = one(named) + one(F.size(s["identity_signals"]) > 0) + one(F.size(s["contact_signals"]) > 0)
    open_ = ~F.exists("robots_directives", lambda d: d.rlike(r"(?i)\bnoindex\b"))
    technical = one(F.col("status_code") == 200) + one(open_) + one(F.coalesce("canonical_url", F.lit("")) != "") + one(F.length(text) >= 100) + one(F.exists("structured_data", lambda b: b["valid"]))
    dated = F.array_max(F.filter(F.transform(F.concat(s["published_dates"], s["modified_dates"]), lambda d: F.try_to_timestamp(d)), lambda d: d.isNotNull()))
    age = (F.unix_micros(F.col("fetched_at").cast("timestamp")) - F.unix_micros(dated)) / 86_400_000_000
    return p.select(
        F.col("id").alias("page_id"), "crawl_run_id", "brand_id", F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("url"), "title",
        F.when(s.isNotNull(), _points(15, evidence / 3)).alias("evidence"), _points(15, structure / 3).alias("structure"),
        F.when(F.col("aliases").isNotNull() & (text != ""), _points(15, entity / 3)).alias("entity"), _points(10, technical / 5).alias("technical"),
        F.when(age >= 0, _points(5, F.when(age <= 365, 1.0).otherwise(0.5))).alias("freshness"),
    )


def merge_ratings(pages: DataFrame, ratings: DataFrame, questions: DataFrame) -> DataFrame:
    """Pages with the points of the three rated components, their matches' personas and stages, and a status. ratings: by page_id."""
    used = ratings.select("page_id", F.explode("matches").alias("m")).join(questions.select(F.col("id").alias("_q"), "persona_id", "stage"), F.col("m.question_id") == F.col("_q"))
    served = used.groupBy("page_id").agg(F.array_sort(F.collect_set("persona_id")).alias("persona_ids"), F.array_sort(F.collect_set("stage")).alias("stages"))
    rated = [F.when(F.col(f"{c}.rating").isNotNull(), _points(WEIGHTS[c], F.col(f"{c}.rating"))).alias(c) for c in ("direct_answer", "specificity", "commercial")]
    r = ratings.select("page_id", *rated, "matches", "evidence_gaps", F.lit("completed").alias("status"))
    out = pages.join(r, "page_id", "left").join(served, "page_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("partial")))


def score(pages: DataFrame) -> DataFrame:
    """pages with score, the rounded sum of known points, and evaluated_weight; a partial score isn't scaled up."""
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in WEIGHTS.items()), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in WEIGHTS), F.lit(0.0))
    return pages.withColumn("evaluated_weight", weight).withColumn("score", F.when(weight > 0, half_up(total)))


def site_averages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("brand_id").agg(F.avg("score").alias("score"), F.avg("evaluated_weight").alias("evaluated_weight"), F.count("*").alias("pages"))


def coverage_matrix(matches: DataFrame, brands: list[str]) -> DataFrame:
    """Matched pages of each question by brand, a column for each brand. matches: question_id, brand_id, page_id."""
    return matches.select("question_id", "brand_id", "page_id").distinct().groupBy("question_id").pivot("brand_id", brands).agg(F.count("page_id")).fillna(0)


def _matches(pages: DataFrame, brands: DataFrame) -> DataFrame:
    """Completed pages with their project and kind of brand, a row for each question that they match.

    Most pages may be of one or two brands, so that a shuffle by brand would have them in as many tasks, each with all its matches. A few short
    words for each brand of a project are sent to the pages instead.
    """
    p = pages.filter("status = 'completed'").join(F.broadcast(brands.select("project_id", "brand_id", "kind")), "brand_id")
    return p.select("project_id", "page_id", "kind", "url", "direct_answer", F.explode("matches.question_id").alias("id"))


def gap_pages(gaps: DataFrame, pages: DataFrame, brands: DataFrame) -> DataFrame:
    """(project_id, question_id, kind, page_id, url): all pages that match the questions of gaps, a row each; the lists of ``content_gaps`` are samples."""
    own = gaps.select("project_id", "question_id")
    return _matches(pages, brands).withColumnRenamed("id", "question_id").join(own, ["project_id", "question_id"], "left_semi").select("project_id", "question_id", "kind", "page_id", "url")


def content_gaps(questions: DataFrame, pages: DataFrame, brands: DataFrame, listed: int = 20) -> DataFrame:
    """Questions that no completed target page matches (create), or that all which do answer weakly (update).

    questions: project_id, id, text, type, intent. brands: project_id, brand_id, kind. Nothing for projects without a completed target page.
    Only exploded matches are joined, never questions with pages. target_urls and rival_urls are the first ``listed`` in order of spelling;
    ``gap_pages`` has all.
    """
    owners = pages.filter("status = 'completed'").select("brand_id").distinct()
    ready = owners.join(brands.filter("kind = 'target'").select("project_id", "brand_id"), "brand_id").select("project_id").distinct()
    target = F.col("kind") == "target"
    matched = _matches(pages, brands)
    m = matched.groupBy("project_id", "id").agg(F.count_if(target).alias("own"), F.count_if(~target).alias("rivals"), F.max(F.when(target, F.coalesce("direct_answer", F.lit(0.0)))).alias("best"))
    first = matched.select("project_id", "id", target.alias("own_page"), "url").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("project_id", "id", "own_page").orderBy("url"))).filter(F.col("_k") <= listed)
    urls = first.groupBy("project_id", "id").agg(F.array_sort(F.collect_list(F.when(F.col("own_page"), F.col("url")))).alias("target_urls"), F.array_sort(F.collect_list(F.when(~F.col("own_page"), F.col("url")))).alias("rival_urls"))
    m = m.join(urls, ["project_id", "id"])
    q = questions.join(F.broadcast(ready), "project_id", "left_semi").join(m, ["project_id", "id"], "left").fillna(0, ["own", "rivals"])
    missing = F.col("own") == 0
    kind = F.lit("Question coverage")
    for type_, label in GAP_KINDS.items():
        kind = F.when(F.col("type") == type_, label).otherwise(kind)
    q = q.filter(missing | (F.col("best") < 10))
    return q.select(
        "project_id", F.col("id").alias("question_id"), F.col("text").alias("question"), stable_id(F.concat("project_id", F.lit("|"), F.col("id"))).alias("id"), F.when(missing, kind).otherwise("Weak direct answer").alias("type"),
        F.when(missing, "create").otherwise("update").alias("action"), F.when(missing, "medium").otherwise("small").alias("effort"), (F.col("intent") * 20).alias("impact"), F.when(missing, 0.55).otherwise(0.65).alias("confidence"), "rivals", "target_urls", "rival_urls",
    )


def priority(impact: Column, gap: Column, confidence: Column, effort: Column, relevance: int = 80) -> Column:
    ease = F.when(effort == "small", 100).when(effort == "medium", 60).otherwise(20)
    return half_up(impact * 0.35 + gap * 0.25 + confidence * 100 * 0.15 + relevance * 0.15 + ease * 0.1).cast("int")


def _actions(df: DataFrame, id: Column, title: Column, category: str, impact, gap, confidence, effort, month, urls: Column, evidence: Column, order: int) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("project_id", id.alias("id"), title.alias("title"), F.lit(category).alias("category"), priority(as_col(impact), as_col(gap), as_col(confidence), as_col(effort)).alias("priority"), as_col(confidence).cast("double").alias("confidence"), as_col(effort).alias("effort"), as_col(month).cast("int").alias("month"), urls.alias("urls"), evidence.alias("evidence"), F.lit(order).alias("step"))


def technical_actions(issues: DataFrame, limit: int = 40) -> DataFrame:
    """From a project's first 40 issues that aren't observations. issues: project_id, rule_id, severity, url, title."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "rule_id", "url"))
    rows = issues.filter("severity <> 'observation'").withColumn("_k", rank).filter(F.col("_k") <= limit)
    return _actions(rows, stable_id(F.concat("rule_id", "url")), F.concat(F.lit("Resolve: "), F.col("rule_id")), "Technical accessibility", 70, F.when(F.col("severity") == "error", 90).otherwise(55), 0.9, "small", 1, F.array("url"), F.array("rule_id"), 1)


def gap_actions(gaps: DataFrame) -> DataFrame:
    verb = F.when(F.col("action") == "create", "Answer: ").otherwise("Improve the answer to: ")
    urls = F.array_distinct(F.concat("target_urls", "rival_urls"))
    return _actions(gaps, F.col("id"), F.concat(verb, F.col("question")), "Commercial content", F.col("impact"), F.when(F.col("rivals") > 0, 80).otherwise(60), F.col("confidence"), F.col("effort"), F.when(F.col("effort") == "small", 1).otherwise(2), urls, urls, 2)


def claim_actions(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """From contradicted claims with known facts in completed, whole answers. claims: project_id, answer_id, text, quote, confidence, fact_ids."""
    used = claims.filter("classification = 'contradicted'").withColumn("fact_id", F.explode("fact_ids")).join(facts.select("project_id", F.col("id").alias("fact_id"), "value"), ["project_id", "fact_id"])
    rows = used.groupBy("project_id", "answer_id", "text", "quote", "confidence").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return _actions(rows, stable_id(F.concat("answer_id", "text")), F.lit("Clarify a conflicting product claim"), "Product facts", 90, 85, F.col("confidence"), "small", 1, F.array().cast("array<string>"), F.concat(F.array("quote"), F.col("values")), 3)


def evidence_actions(pages: DataFrame, brands: DataFrame) -> DataFrame:
    """From claims on target pages that nothing supports."""
    rows = pages.join(brands.filter("kind = 'target'").select("project_id", "brand_id"), "brand_id").select("project_id", "page_id", "url", F.explode("evidence_gaps").alias("g"))
    return _actions(rows, stable_id(F.concat("page_id", "g.quote")), F.lit("Add support for a performance claim"), "Evidence and original research", 80, 65, 0.6, "medium", 2, F.array("url"), F.array("g.quote"), 4)


def detail_actions(facts: DataFrame, brands: DataFrame) -> DataFrame:
    """From target facts that differ."""
    rows = contradictions(facts.join(brands.filter("kind = 'target'").select("brand_id"), "brand_id", "left_semi"), ("project_id",))
    return _actions(rows, stable_id(F.concat_ws("|", "category", "subject", "attribute")), F.lit("Clarify differing company details"), "Entity and message consistency", 85, 70, 0.65, "small", 1, F.array().cast("array<string>"), F.col("values"), 5)


def third_party_sources(citations: DataFrame, brands: DataFrame, limit: int = 5) -> DataFrame:
    """(project_id, url, place): the first cited URLs whose host is no brand's. citations: project_id, ordinal, pos, url, domain."""
    hosts = brands.select("project_id", domain_key(F.col("domain")).alias("domain")).distinct()
    rows = citations.join(hosts, ["project_id", "domain"], "left_anti").groupBy("project_id", "url").agg(F.min(F.struct("ordinal", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("first", "url"))
    return rows.withColumn("place", rank).filter(F.col("place") <= limit).select("project_id", "url", "place")


def source_actions(sources: DataFrame) -> DataFrame:
    rows = sources.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda s: s["url"]).alias("urls"))
    return _actions(rows, stable_id(F.concat(F.lit("authority"), F.array_join("urls", ","))), F.lit("Review sources appearing in the saved answers"), "Third-party authority", 60, 50, 0.5, "medium", 3, F.col("urls"), F.col("urls"), 6)


def repeat_actions(projects: DataFrame) -> DataFrame:
    """One for each project: measure again. projects: project_id, answers (how many are saved)."""
    some = F.col("answers") > 0
    title = F.when(some, "Repeat the same buyer questions after changes").otherwise("Establish a first saved visibility check")
    return _actions(projects, F.lit("repeat-measurement"), title, "Monitoring", 70, F.when(some, 30).otherwise(90), 1.0, "small", F.when(some, 3).otherwise(1), F.array().cast("array<string>"), F.array(F.col("answers").cast("string")), 7)


def action_plan(*actions: DataFrame) -> DataFrame:
    """All actions of each project, the last of an id kept, with their place by priority; ties in order of making."""
    rows = actions[0]
    for other in actions[1:]:
        rows = rows.unionByName(other)
    last = F.row_number().over(Window.partitionBy("project_id", "id").orderBy(F.desc("step"), F.desc("priority"), "title"))
    rows = rows.withColumn("_k", last).filter("_k = 1").drop("_k")
    return placed(rows, "project_id", [F.desc("priority"), F.col("step").asc(), F.col("id").asc()])
