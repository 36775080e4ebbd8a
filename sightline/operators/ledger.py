"""Usage ledger, crawls and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import contradictions
from .visibility import eligible_answers


def usage_totals(usage: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Attempts, tokens and cost of each project, how many have none, and what is left of its budget."""
    out = usage.groupBy("project_id").agg(F.count("*").alias("attempts"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost")), F.count_if(F.col("cost").isNull()).alias("without_cost"))
    if budgets is None:
        return out
    return out.join(budgets, "project_id", "left").withColumn("remaining", F.greatest(F.lit(0.0), F.col("budget") - F.coalesce("cost", F.lit(0.0))))


def latest_usage(usage: DataFrame, limit: int = 100) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id")))
    return usage.withColumn("place", rank).filter(F.col("place") <= limit)


def fact_history(revisions: DataFrame) -> DataFrame:
    """A fact's revisions in order of making, with their place and the value before. revisions: fact_id, id, value, created_at."""
    order = Window.partitionBy("fact_id").orderBy("created_at", "id")
    return revisions.withColumns({"revision": F.row_number().over(order), "before": F.lag("value").over(order)})


def latest_responses(usage: DataFrame) -> DataFrame:
    """The newest validated response of each project and cache key; one aggregate with a map-side part, no sort."""
    return usage.filter("status = 'validated'").groupBy("project_id", "cache_key").agg(F.max(F.struct("created_at", "id")).alias("l")).select("project_id", "cache_key", "l.id", "l.created_at")


def latest_crawls(crawls: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """The newest crawl of each active brand."""
    rows = crawls if brands is None else crawls.join(brands.filter("active").select("brand_id"), "brand_id", "left_semi")
    newest = rows.groupBy("brand_id").agg(F.max(F.struct("created_at", "id")).alias("l"))
    return newest.select("brand_id", "l.id", "l.created_at")


def page_inventory(pages: DataFrame, latest: DataFrame, brand=None, status=None, words: str | None = None) -> DataFrame:
    """Pages of the latest crawls, the newest first."""
    rows = pages.join(latest.select(F.col("id").alias("crawl_run_id")), "crawl_run_id", "left_semi")
    for name, value in (("brand_id", brand), ("status", status)):
        rows = rows.filter(F.col(name) == value) if value else rows
    rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "url", "title")), F.lower(F.lit(words)))) if words else rows
    return rows.orderBy(F.desc("fetched_at"), "url")


def crawl_counters(pages: DataFrame, crawls: DataFrame | None = None) -> DataFrame:
    """Pages of each crawl by state, and with ``crawls`` how many were discovered; crawls without a page are zeros then."""
    s = F.col("status")
    out = pages.groupBy("crawl_run_id").agg(F.count("*").alias("processed"), *(F.count_if(s == k).alias(k) for k in ("fetched", "failed", "skipped")))
    if crawls is None:
        return out
    found = crawls.select(F.col("id").alias("crawl_run_id"), F.col("pages_discovered").alias("discovered"))
    return found.join(out, "crawl_run_id", "left").fillna(0, ["processed", "fetched", "failed", "skipped"])


def project_overview(projects: DataFrame, answers: DataFrame, brands: DataFrame, mentions: DataFrame, runs: DataFrame, plan: DataFrame, issues: DataFrame, facts: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each project: eligible answers and target mentions of its last run, actions and the first one's title, issues that need
    attention and observations, conflicting and known facts, questions and selected ones.

    runs: project_id, experiment_id, created_at. plan: project_id, place, title. issues, facts, questions: with project_id.
    """
    last = runs.groupBy("project_id").agg(F.max(F.struct("created_at", "experiment_id")).alias("l")).select("project_id", F.col("l.experiment_id").alias("experiment_id"))
    good = eligible_answers(answers).select("experiment_id", "answer_id")
    target = brands.filter("kind = 'target'").select("experiment_id", "brand_id")
    hits = mentions.join(target, ["experiment_id", "brand_id"]).select("experiment_id", "answer_id").distinct().withColumn("hit", F.lit(1))
    run = good.join(hits, ["experiment_id", "answer_id"], "left").groupBy("experiment_id").agg(F.count("*").alias("eligible_answers"), F.count("hit").alias("target_mentions"))
    known = facts.filter("status <> 'rejected'")
    parts = [
        last.join(run, "experiment_id", "left").select("project_id", F.col("experiment_id").alias("last_run"), "eligible_answers", "target_mentions"),
        plan.groupBy("project_id").agg(F.count("*").alias("actions"), F.min(F.struct("place", "title"))["title"].alias("first_action")),
        issues.groupBy("project_id").agg(F.count_if(F.col("severity") != "observation").alias("attention"), F.count_if(F.col("severity") == "observation").alias("observations")),
        contradictions(known, ("project_id", "brand_id")).groupBy("project_id").agg(F.count("*").alias("conflicts")),
        known.groupBy("project_id").agg(F.count("*").alias("facts")),
        questions.groupBy("project_id").agg(F.count("*").alias("questions"), F.count_if("selected").alias("selected")),
    ]
    out = projects.select("project_id")
    for part in parts:
        out = out.join(part, "project_id", "left")
    return out.fillna(0)
