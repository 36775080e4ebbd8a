"""Company facts: contradictions, merging, sources, reference lists and summaries.

Facts: id, project_id, brand_id, category, subject, attribute, value, confidence, sources, origin, status, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, fold_nfkc
from ..functions.urls import domain_key


def contradictions(facts: DataFrame, keys: tuple[str, ...] = ("brand_id",), listed: int = 100) -> DataFrame:
    """Groups of facts, not rejected, of one subject and attribute with more than one value: size, and the first values and ids.

    ``contradicting_facts`` has all facts of the groups.
    """
    f = facts.filter("status <> 'rejected'").select(*keys, "category", "id", "value", fold_nfkc(F.col("subject")).alias("subject"), fold_nfkc(F.col("attribute")).alias("attribute"), fold_nfkc(F.col("value")).alias("_v"))
    by = [*keys, "category", "subject", "attribute"]
    groups = f.groupBy(*by).agg(F.count_distinct("_v").alias("n_values"), F.count("*").alias("n_facts")).filter("n_values > 1")
    rows = f.join(groups, by)
    ids = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_k") <= listed).groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("fact_ids"))
    values = rows.select(*by, "value").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("value"))).filter(F.col("_k") <= listed).groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("values"))
    return groups.join(values, by).join(ids, by).select(*by, "n_values", "n_facts", "values", "fact_ids")


def contradicting_facts(facts: DataFrame, keys: tuple[str, ...] = ("brand_id",)) -> DataFrame:
    """All facts that ``contradictions`` counts, a row each: the group's keys, category, subject and attribute, then id and value."""
    f = facts.filter("status <> 'rejected'").select(*keys, "category", "id", "value", fold_nfkc(F.col("subject")).alias("subject"), fold_nfkc(F.col("attribute")).alias("attribute"), fold_nfkc(F.col("value")).alias("_v"))
    by = [*keys, "category", "subject", "attribute"]
    groups = f.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")).filter("_low <> _high").select(*by)
    return f.join(groups, by).select(*by, "id", "value")


def merge_facts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New facts that no existing one repeats: same brand, category, folded words and one same source (URL, text hash and quote)."""
    folded = ["subject", "attribute", "value"]

    def keyed(facts: DataFrame) -> DataFrame:
        source = F.explode("sources").alias("s")
        hashed = F.xxhash64("brand_id", "category", *(fold_nfkc(F.col(c)) for c in folded)).alias("_fact")
        return facts.select("id", hashed, source).select("id", "_fact", F.xxhash64("s.url", "s.text_hash", "s.quote").alias("_source"))

    n = keyed(new)
    repeated = n.join(keyed(existing).select("_fact", "_source").distinct(), ["_fact", "_source"], "left_semi").select("id")
    first = F.row_number().over(Window.partitionBy("_fact", "_source").orderBy("id"))
    again = n.withColumn("_k", first).filter("_k > 1").select("id")
    return new.join(repeated.union(again).distinct(), "id", "left_anti")


def profile_sources(pages: DataFrame, limit: int) -> DataFrame:
    """Pages to read a company's profile from: home, about, products, others; then by URL, in binary order."""
    path = F.lower(F.coalesce(F.try_parse_url(F.coalesce("final_url", "url"), F.lit("PATH")), F.lit("")))
    level = F.when(path.isin("", "/"), 0).when(path.rlike("/(?:about|company)"), 1).when(path.rlike("/(?:product|pricing|security|integration)"), 2).otherwise(3)
    rows = pages.filter((F.col("status") == "fetched") & (F.length(F.trim("visible_text")) >= 16)).withColumn("level", level)
    rank = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("level", "url"))
    return rows.withColumn("place", rank).filter(F.col("place") <= limit)


def reference_facts(facts: DataFrame, brands: DataFrame, target: int = 60, rival: int = 12) -> DataFrame:
    """Each brand's newest facts that aren't rejected: 60 of a target, 12 of a competitor."""
    rows = facts.filter("status <> 'rejected'").join(brands.select("brand_id", "kind"), "brand_id")
    rank = F.row_number().over(Window.partitionBy("brand_id").orderBy(F.desc("updated_at"), "id"))
    return rows.withColumn("place", rank).filter(F.col("place") <= F.when(F.col("kind") == "target", target).otherwise(rival))


def context_facts(facts: DataFrame, limit: int = 40, by: str = "project_id") -> DataFrame:
    """A project's newest distinct facts, by normalised subject, attribute and value."""
    words = [comparable(F.col(c)) for c in ("subject", "attribute", "value")]
    rows = facts.filter("status <> 'rejected'").withColumn("_k", F.row_number().over(Window.partitionBy(by, *words).orderBy(F.desc("updated_at"), "id"))).filter("_k = 1")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("updated_at"), "id"))
    return rows.withColumn("place", rank).filter(F.col("place") <= limit).drop("_k")


def company_summary(projects: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each project: summary and two customers, its own words first and the newest facts else, and three products, features and uses."""
    good = facts.filter("status <> 'rejected'")
    kind = F.when(F.col("category").isin("summary", "description"), "summary").when(F.col("category") == "target_customer", "customers").when(F.col("category").isin("product", "feature", "use_case"), "offers")
    place = F.row_number().over(Window.partitionBy("project_id", "_kind").orderBy(F.desc("updated_at"), F.desc("id"), F.desc("value")))
    rows = good.withColumn("_kind", kind).filter("_kind IS NOT NULL").withColumn("_k", place).filter("_k <= 3")  # all that is ever shown
    listed = lambda kind, n: F.transform(F.array_sort(F.collect_list(F.when((F.col("_kind") == kind) & (F.col("_k") <= n), F.struct("_k", "value")))), lambda r: r["value"])
    out = rows.groupBy("project_id").agg(F.get(listed("summary", 1), F.lit(0)).alias("_s"), listed("customers", 2).alias("_c"), listed("offers", 3).alias("offers"))
    out = projects.join(out, "project_id", "left")
    own = F.when(F.coalesce("target_customer", F.lit("")) != "", F.array("target_customer"))
    return out.select("project_id", F.coalesce(F.nullif(F.trim("description"), F.lit("")), "_s").alias("summary"), F.coalesce(own, "_c").alias("customers"), "offers")


def sync_brands(desired: DataFrame, previous: DataFrame) -> DataFrame:
    """Brands of a project after a change: matched by domain and kind they keep their id and are active, new ones have none yet, the rest sleep."""
    a = desired.select("project_id", "name", "domain", "kind", domain_key(F.col("domain")).alias("key"))
    b = previous.select("project_id", F.col("name").alias("_n"), F.col("domain").alias("_d"), "kind", domain_key(F.col("domain")).alias("key"), "id")
    out = a.join(b, ["project_id", "kind", "key"], "full")
    return out.select("project_id", "id", F.coalesce("name", "_n").alias("name"), F.coalesce("domain", "_d").alias("domain"), "kind", F.col("domain").isNotNull().alias("active"), F.when(F.col("domain").isNull(), "deactivate").when(F.col("id").isNull(), "insert").otherwise("keep").alias("change"))


def repeated_domains(brands: DataFrame) -> DataFrame:
    """Domains that a project tracks more than once."""
    return brands.select("project_id", domain_key(F.col("domain")).alias("domain")).groupBy("project_id", "domain").agg(F.count("*").alias("n")).filter("n > 1")


def brand_aliases(brands: DataFrame, facts: DataFrame) -> DataFrame:
    """(brand_id, aliases): name, host, own aliases and products, and the facts that name the company, distinct, of two characters or more."""
    named = facts.filter(F.col("category").isin("company_name", "brand_alias", "product") & (F.col("status") != "rejected")).groupBy("brand_id").agg(F.collect_set("value").alias("_facts"))
    none = F.array().cast("array<string>")
    every = F.concat(F.array("name", domain_key(F.col("domain"))), F.coalesce("brand_aliases", none), F.coalesce("product_names", none), F.coalesce("_facts", none))
    return brands.join(named, "brand_id", "left").select("brand_id", F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda a: F.trim(a)), lambda a: F.length(a) >= 2))).alias("aliases"))


def filter_facts(facts: DataFrame, category: str | None = None, words: str | None = None) -> DataFrame:
    facts = facts.filter("status <> 'rejected'")
    facts = facts.filter(F.col("category") == category) if category else facts
    return facts.filter(F.contains(F.lower(F.concat_ws(" ", "subject", "attribute", "value")), F.lower(F.lit(words)))) if words else facts
