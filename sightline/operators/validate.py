"""Validation of model output and input rows: each operator returns its rows with ``reasons``, empty where the row is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, fold_nfkc, mention_position, quote_supported
from .visibility import STAGE_WEIGHTS

#: Categories of facts (fixed values).
CATEGORIES = (
    "company_name", "brand_alias", "domain", "summary", "description", "product", "category", "target_customer", "use_case", "feature", "integration", "pricing", "region",
    "security_compliance", "differentiator", "limitation", "customer_proof", "competitor", "other_claim",
)


def _reasons(**tests: Column) -> Column:
    """Names of the tests that don't hold; an unknown test doesn't."""
    return F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), name) for name, t in tests.items())), lambda r: r.isNotNull())


def _length(c: str | Column, low: int, high: int) -> Column:
    return F.length(F.trim(c)).between(low, high)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows."""
    return df.filter(F.size("reasons") == 0).drop("reasons"), df.filter(F.size("reasons") > 0)


def parse_model_json(df: DataFrame, schema: str, text: str = "response", finish: str = "finish_reason") -> DataFrame:
    """df with ``parsed``: the response without code fences, read by the schema; null with a reason if it was cut off or isn't JSON."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    parsed = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    cut = F.coalesce(F.col(finish) == "length", F.lit(False))
    return df.withColumn("parsed", F.when(~cut & F.try_parse_json(bare).isNotNull(), parsed)).withColumn("reasons", _reasons(whole=~cut, json=F.col("parsed").isNotNull()))


def validate_facts(facts: DataFrame, pages: DataFrame, most: int = 12) -> DataFrame:
    """facts: page_id, category, subject, attribute, value, confidence, quote. A quote must stand in the page's first 8,000 characters."""
    rows = facts.join(pages.select(F.col("id").alias("page_id"), F.col("visible_text").alias("_text")), "page_id", "left")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("subject", "attribute", "value"))
    tests = dict(
        category=F.col("category").isin(*CATEGORIES), subject=_length("subject", 1, 180), attribute=_length("attribute", 1, 180), value=_length("value", 1, 2000), confidence=F.col("confidence").between(0, 1),
        quote=_length("quote", 16, 1000) & quote_supported(F.col("_text"), F.col("quote"), lambda c: fold_nfkc(c, lower=False), 16, 8000), count=F.col("_k") <= most,
    )
    return rows.withColumn("_k", place).withColumn("reasons", _reasons(**tests)).drop("_k", "_text")


def validate_questions(questions: DataFrame, personas: DataFrame, types: list[str]) -> DataFrame:
    rows = questions.join(personas.select(F.col("id").alias("persona_id"), F.lit(True).alias("_known")).distinct(), "persona_id", "left")
    tests = dict(
        text=_length("text", 12, 600), persona=F.col("_known"), stage=F.col("stage").isin(*STAGE_WEIGHTS), type=F.col("type").isin(*types), geography=_length("geography", 1, 160), intent=F.col("intent").between(1, 5),
        brands=F.size("expected_brand_ids") <= 4, facts=F.size("target_fact_ids") <= 8, needs=F.size("target_fact_needs").between(1, 5) & F.forall("target_fact_needs", lambda n: F.length(F.trim(n)).between(1, 240)),
    )
    return rows.withColumn("reasons", _reasons(**tests)).drop("_known")


def validate_personas(personas: DataFrame) -> DataFrame:
    listed = lambda c: F.size(c).between(1, 5) & F.forall(c, lambda x: F.length(F.trim(x)).between(1, 240))
    roles = F.count("*").over(Window.partitionBy("project_id", F.lower(F.trim("role"))))
    tests = dict(role=_length("role", 1, 240), company=_length("company_type", 1, 240), pain=_length("primary_pain", 1, 600), criteria=listed("criteria"), objections=listed("objections"), sophistication=F.col("sophistication").isin("low", "medium", "high"), importance=F.col("importance").between(1, 5), distinct=F.col("_n") == 1)
    return personas.withColumn("_n", roles).withColumn("reasons", _reasons(**tests)).drop("_n")


def _unknown(rows: DataFrame, id: str, ids: Column, known: DataFrame, keys: list[str]) -> DataFrame:
    """(id): rows with an id in ``ids`` that isn't among the known ones."""
    used = rows.select(id, *keys[:-1], F.explode(ids).alias(keys[-1]))
    return used.join(known.select(*keys).distinct(), keys, "left_anti").select(id).distinct().withColumn("_unknown", F.lit(True))


def validate_analysis(answers: DataFrame, brands: DataFrame, facts: DataFrame) -> DataFrame:
    """answers: experiment_id, answer_id, raw, analysis. Quotes must stand in the answer, and name what they are for; ids must be known.

    An experiment's brands are a handful and are joined as a map; fact ids are exploded and met with the known ones.
    """
    named = brands.groupBy("experiment_id").agg(F.map_from_entries(F.collect_list(F.struct("brand_id", "aliases"))).alias("_brands"))
    unknown = _unknown(answers, "answer_id", F.flatten(F.transform("analysis.claims", lambda x: x["fact_ids"])), facts, ["experiment_id", "fact_id"])
    rows = answers.join(named, "experiment_id", "left").join(unknown, "answer_id", "left")
    said = lambda q: F.contains(comparable(F.col("raw")), comparable(q))
    b, c, e = F.col("analysis.brands"), F.col("analysis.claims"), F.col("analysis.entities")
    none = F.array().cast("array<string>")
    tests = dict(
        unique_brands=F.size(F.array_distinct(b["brand_id"])) == F.size(b),
        entities=F.forall(e, lambda x: said(x["quote"]) & F.contains(comparable(x["quote"]), comparable(x["name"]))),
        brands=F.forall(b, lambda x: said(x["quote"]) & (mention_position(x["quote"], F.coalesce(F.element_at("_brands", x["brand_id"]), none)) >= 0)),
        claims=F.forall(c, lambda x: said(x["quote"])) & F.col("_unknown").isNull(),
        evidence=F.forall(c, lambda x: ~x["classification"].isin("supported", "contradicted") | (F.size(x["fact_ids"]) > 0)),
    )
    return rows.withColumn("reasons", _reasons(**tests)).drop("_brands", "_unknown")


def validate_semantics(ratings: DataFrame, excerpts: DataFrame, questions: DataFrame) -> DataFrame:
    """ratings by page_id: matches name known questions once, quotes stand in the excerpt, a positive rating has one, a product is named in its own."""
    unknown = _unknown(ratings, "page_id", F.col("matches.question_id"), questions.select(F.col("id").alias("question_id")), ["question_id"])
    rows = ratings.join(excerpts.select("page_id", F.col("excerpt").alias("_text")), "page_id", "left").join(unknown, "page_id", "left")
    said = lambda q: F.contains(comparable(F.col("_text")), comparable(q))
    m = F.col("matches")
    rated = [((F.col(f"{k}.rating") == 0) & (F.coalesce(f"{k}.quote", F.lit("")) == "")) | ((F.coalesce(f"{k}.quote", F.lit("")) != "") & said(F.col(f"{k}.quote"))) for k in ("direct_answer", "specificity", "commercial")]
    tests = dict(
        unique_matches=F.size(F.array_distinct(m["question_id"])) == F.size(m),
        matches=F.forall(m, lambda x: said(x["quote"])) & F.col("_unknown").isNull(),
        products=F.forall("products", lambda x: said(x["quote"]) & F.contains(comparable(x["quote"]), comparable(x["name"]))),
        gaps=F.forall("evidence_gaps", lambda x: said(x["quote"])),
        ratings=rated[0] & rated[1] & rated[2],
    )
    return rows.withColumn("reasons", _reasons(**tests)).drop("_text", "_unknown")
