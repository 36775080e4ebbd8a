"""Visibility metrics from saved answers: mentions, recommendations, citations, claims, at any grain.

Answers: experiment_id, answer_id, ordinal, status, raw, truncated, analyzed, refused, stage, type, persona_id, provider, model.
Brands (frozen with the experiment): experiment_id, brand_id, name, host, kind, aliases.
Mentions: experiment_id, answer_id, brand_id, recommended, recommendation_position. Citations: experiment_id, answer_id, pos, url, domain, source.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.mentions import Names
from ..functions.text import wilson
from ..functions.urls import domain_key, host_matches, safe_citation

#: Weight of an answer by its question's stage (fixed values, in the stages' order); other stages weigh 1.
STAGE_WEIGHTS = {"problem_discovery": 1, "category_education": 1, "solution_research": 2, "vendor_comparison": 3, "validation_risk": 2, "purchase_decision": 3}


def share(num: str, den: str, prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}_{k}") for k, c in wilson(F.col(num), F.col(den)).items()]


def stage_weight(stage: Column) -> Column:
    weight = F.lit(1)
    for name, w in STAGE_WEIGHTS.items():
        weight = F.when(stage == name, w).otherwise(weight)
    return weight


def eligible_answers(answers: DataFrame) -> DataFrame:
    """Completed, analysed, whole answers with text. Refusals stay."""
    return answers.filter((F.col("status") == "completed") & F.col("analyzed") & ~F.coalesce("truncated", F.lit(False)) & F.coalesce(F.col("raw").rlike(r"(?U)\S"), F.lit(False)))


def answer_counts(answers: DataFrame) -> DataFrame:
    """eligible, excluded and refusals of each experiment."""
    good = eligible_answers(answers).groupBy("experiment_id").agg(F.count("*").alias("eligible"), F.count_if(F.coalesce("refused", F.lit(False))).alias("refusals"))
    every = answers.groupBy("experiment_id").agg(F.count("*").alias("n"))
    out = every.join(good, "experiment_id", "left").fillna(0, ["eligible", "refusals"])
    return out.select("experiment_id", "eligible", (F.col("n") - F.col("eligible")).alias("excluded"), "refusals")


def filter_answers(answers: DataFrame, experiment=None, start=None, end=None, stage=None, type=None, persona=None, source=None, question=None) -> DataFrame:
    """Answers by exact values, by day of observation, and by words of the question whatever their case."""
    day = F.substring(F.col("observed_at").cast("string"), 1, 10)
    for value, test in (
        (experiment, F.col("experiment_id") == experiment), (start, day >= F.lit(start)), (end, day <= F.lit(end)), (stage, F.col("stage") == stage), (type, F.col("type") == type),
        (persona, F.col("persona_id") == persona), (source, F.concat_ws(" / ", "provider", "model") == source), (question, F.contains(F.lower("question"), F.lower(F.lit(question)))),
    ):
        answers = answers.filter(test) if value is not None else answers
    return answers


#: Bytes of names up to which they go to every worker as they are.
NAMES_BYTES = 8 << 20
#: Rows of mentions that a worker gives back at once.
BATCH_ROWS = 8192


def find_mentions(answers: DataFrame, brands: DataFrame, names_bytes: int = NAMES_BYTES) -> DataFrame:
    """experiment_id, answer_id, brand_id, at, first_position: brands named in an answer, in order of their first place.

    The names of an experiment's brands make one automaton, which reads each answer once for all of them. Names up to ``names_bytes`` in all
    go to the workers, and texts aren't shuffled; more names meet their experiment's answers in one shuffle, where an experiment with many
    answers is dealt to many tasks. A task holds the names of one experiment. Null and empty names and answers name nothing; of a brand
    that stands there several times all names count; equal places are ordered by brand_id.
    """
    names = brands.select("experiment_id", "brand_id", F.explode("aliases").alias("name")).filter("experiment_id IS NOT NULL AND name <> ''").distinct()
    texts = answers.select("experiment_id", "answer_id", F.col("raw").alias("name")).filter("experiment_id IS NOT NULL AND name <> ''")
    size = names.agg(F.sum(F.octet_length("name") + 32)).first()[0] or 0
    kinds = {**dict(texts.dtypes), **{"brand_id": dict(names.dtypes)["brand_id"]}}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("experiment_id", "answer_id", "brand_id")) + ", at int"
    if size <= names_bytes:
        known: dict = defaultdict(list)
        for r in names.collect():  # at most names_bytes
            known[r["experiment_id"]].append((r["brand_id"], r["name"]))
        found = texts.mapInArrow(_reader(schema, dict(known)), schema)
    else:
        found = _dealt(texts, names).mapInArrow(_reader(schema, None), schema)
    order = Window.partitionBy("experiment_id", "answer_id").orderBy("at", "brand_id")
    return found.withColumn("first_position", F.row_number().over(order))


def _dealt(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Names and texts of an experiment in one partition, names first; an experiment with more than its share of texts has several, each with all its names."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = texts.groupBy("experiment_id").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    large = counts.filter(F.col("count") * n > total).select("experiment_id", F.ceil(F.col("count") * n / max(total, 1)).cast("int").alias("parts"))  # fewer than n
    large = F.broadcast(large)
    rows = texts.join(large, "experiment_id", "left").withColumn("part", F.pmod(F.xxhash64("answer_id", "name"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = names.join(large, "experiment_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = copies.withColumn("is_text", F.lit(False)).unionByName(rows.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    return both.repartition("experiment_id", "part").sortWithinPartitions("experiment_id", "part", "is_text")


def _reader(schema: str, known: dict | None):
    """Reads batches of texts with the names that are known by experiment, or that stand before the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        own, names, rows = None, None, []
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                experiment = columns["experiment_id"][i].as_py()
                if known is not None:
                    if experiment not in made:
                        made[experiment] = Names(known.get(experiment, ()))
                    names = made[experiment]
                else:
                    part = (experiment, columns["part"][i].as_py())
                    if part != own:
                        own, names = part, []
                    if not columns["is_text"][i].as_py():
                        names.append((columns["brand_id"][i].as_py(), columns["name"][i].as_py()))
                        continue
                    names = Names(names) if isinstance(names, list) else names
                answer = columns["answer_id"][i].as_py()
                rows += [(experiment, answer, brand, at) for brand, at in names.first_places(columns["name"][i].as_py()).items()]
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), form.types, strict=True)], form.names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), form.types, strict=True)], form.names)

    form = to_arrow_schema(StructType.fromDDL(schema))
    return work


def guarded_mentions(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Mentions with the model's judgment where it has one, else neutral; only a strong or moderate one recommends."""
    strong = F.coalesce(F.col("recommended") & F.col("strength").isin("strong", "moderate"), F.lit(False))
    out = found.join(judged.select("experiment_id", "answer_id", "brand_id", "recommended", "recommendation_position", "strength"), ["experiment_id", "answer_id", "brand_id"], "left")
    return out.select("experiment_id", "answer_id", "brand_id", "first_position", strong.alias("recommended"), F.when(strong, F.col("recommendation_position")).alias("recommendation_position"), F.coalesce("strength", F.lit("neutral")).alias("strength"))


def extract_citations(answers: DataFrame, limit: int = 100) -> DataFrame:
    """experiment_id, answer_id, pos, url, domain, source: supplied URLs, then those in the text; each once, the first origin wins.

    answers: also ``supplied`` (array of URLs) and ``supplied_source``.
    """
    bare = lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")
    listed = lambda urls, source: F.transform(urls, lambda u: F.struct(bare(u).alias("url"), source.alias("source")))
    given = listed(F.coalesce("supplied", F.array().cast("array<string>")), F.col("supplied_source"))
    written = listed(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(r'(?i)https?://[^\s<>"\])]+'), 0), F.lit("answer_text"))
    rows = answers.select("experiment_id", "answer_id", F.posexplode(F.concat(given, written)).alias("pos", "c"))
    rows = rows.select("experiment_id", "answer_id", "pos", safe_citation("c.url").alias("url"), "c.source").filter("url IS NOT NULL")
    rows = rows.groupBy("experiment_id", "answer_id", "url").agg(F.min(F.struct("pos", "source")).alias("f")).select("experiment_id", "answer_id", "f.pos", "url", "f.source")
    rank = F.row_number().over(Window.partitionBy("experiment_id", "answer_id").orderBy("pos"))
    return rows.withColumn("_k", rank).filter(F.col("_k") <= limit).select("experiment_id", "answer_id", "pos", "url", domain_key(F.col("url")).alias("domain"), "source")


def brand_metrics(answers: DataFrame, brands: DataFrame, mentions: DataFrame, citations: DataFrame | None = None, grain: tuple[str, ...] = ()) -> DataFrame:
    """One row for each brand of each experiment, and of each value of ``grain`` if given: rates with intervals, position and share.

    Brands that no answer names keep a row of zeros. An answer counts once for a brand, with the weight of its stage.
    """
    keys = ["experiment_id", *grain]
    good = eligible_answers(answers).select("experiment_id", "answer_id", *(g for g in grain if g != "stage"), "stage")
    totals = good.groupBy(*keys).agg(F.count("*").alias("eligible"))
    once = mentions.groupBy("experiment_id", "answer_id", "brand_id").agg(F.max(F.coalesce("recommended", F.lit(False))).alias("recommended"), F.sum(F.when(F.col("recommended"), F.col("recommendation_position"))).alias("positions"), F.count(F.when(F.col("recommended"), F.col("recommendation_position"))).alias("position_samples"))
    counts = once.join(good, ["experiment_id", "answer_id"]).groupBy(*keys, "brand_id").agg(
        F.count("*").alias("mentioned"), F.count_if("recommended").alias("recommended"), F.sum(stage_weight(F.col("stage"))).alias("weighted"), F.sum("positions").alias("_p"), F.sum("position_samples").alias("position_samples"))
    out = totals.join(brands.select("experiment_id", "brand_id", "name", "kind", "host"), "experiment_id").join(counts, [*keys, "brand_id"], "left")
    cited = ["cited", "with_citations"]
    if citations is not None:
        sources = citations.join(good, ["experiment_id", "answer_id"]).select(*keys, "answer_id", "domain").distinct()
        answered = sources.groupBy(*keys).agg(F.count_distinct("answer_id").alias("with_citations"))
        hits = sources.join(brands.select("experiment_id", "brand_id", "host"), "experiment_id").filter(host_matches(F.col("domain"), F.col("host")))
        out = out.join(answered, keys, "left").join(hits.groupBy(*keys, "brand_id").agg(F.count_distinct("answer_id").alias("cited")), [*keys, "brand_id"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("long") for c in cited})
    out = out.fillna(0, ["mentioned", "recommended", "weighted", "position_samples", *cited])
    total = F.sum("weighted").over(Window.partitionBy(*keys))
    return out.select(
        *keys, "brand_id", "name", "kind", "eligible", "mentioned", *share("mentioned", "eligible", "mention"), "recommended", *share("recommended", "eligible", "recommendation"),
        "cited", "with_citations", *share("cited", "with_citations", "citation"), "weighted", F.when(total > 0, F.col("weighted") / total).alias("share"), total.alias("share_denominator"),
        F.when(F.col("position_samples") > 0, F.col("_p") / F.col("position_samples")).alias("position"), "position_samples", (F.col("eligible") - F.col("mentioned")).alias("absent"),
    )


def _target_answers(answers: DataFrame, brands: DataFrame, mentions: DataFrame) -> DataFrame:
    """Eligible answers and whether they name their experiment's target."""
    target = brands.filter("kind = 'target'").select("experiment_id", "brand_id")
    hit = mentions.join(target, ["experiment_id", "brand_id"]).select("experiment_id", "answer_id").distinct().withColumn("hit", F.lit(1))
    return eligible_answers(answers).join(hit, ["experiment_id", "answer_id"], "left").fillna(0, ["hit"])


def stage_metrics(answers: DataFrame, brands: DataFrame, mentions: DataFrame) -> DataFrame:
    """Target mention rate by stage: six rows for each experiment, whatever it asked."""
    stages = F.explode(F.array(*map(F.lit, STAGE_WEIGHTS))).alias("stage")
    grid = brands.select("experiment_id").distinct().select("experiment_id", stages)
    counts = _target_answers(answers, brands, mentions).groupBy("experiment_id", "stage").agg(F.sum("hit").alias("mentioned"), F.count("*").alias("eligible"))
    out = grid.join(counts, ["experiment_id", "stage"], "left").fillna(0, ["mentioned", "eligible"])
    return out.select("experiment_id", "stage", "mentioned", "eligible", *share("mentioned", "eligible", "mention"))


def source_metrics(answers: DataFrame, brands: DataFrame, mentions: DataFrame) -> DataFrame:
    """Target mention rate by provider and model."""
    rows = _target_answers(answers, brands, mentions).withColumn("source", F.concat_ws(" / ", "provider", "model"))
    out = rows.groupBy("experiment_id", "source").agg(F.sum("hit").alias("mentioned"), F.count("*").alias("eligible"))
    return out.select("experiment_id", "source", "mentioned", "eligible", *share("mentioned", "eligible", "mention"))


def sliced_metrics(answers: DataFrame, brands: DataFrame, mentions: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """``brand_metrics`` of each experiment as a whole (dimension all) and by each stage, type, persona and source.

    Answers are given their five slices once, and one pass of aggregates counts all measures by slice.
    """
    slices = [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"))]
    for name, value in (("stage", F.col("stage")), ("type", F.col("type")), ("persona_id", F.col("persona_id")), ("source", F.concat_ws(" / ", "provider", "model"))):
        slices.append(F.struct(F.lit(name).alias("dimension"), F.coalesce(value.cast("string"), F.lit("")).alias("value")))
    return brand_metrics(answers.select("*", F.inline(F.array(*slices))), brands, mentions, citations, ("dimension", "value"))


def citation_urls(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(experiment_id, domain, url, citations, n_answers): every URL that eligible answers cite, a row each."""
    rows = citations.join(eligible_answers(answers).select("experiment_id", "answer_id"), ["experiment_id", "answer_id"])
    once = rows.groupBy("experiment_id", "domain", "url", "answer_id").agg(F.count("*").alias("n"))
    return once.groupBy("experiment_id", "domain", "url").agg(F.sum("n").alias("citations"), F.count("*").alias("n_answers"))


def citation_domains(answers: DataFrame, brands: DataFrame, citations: DataFrame, urls: int = 100) -> DataFrame:
    """Domains cited in eligible answers: citations, distinct URLs and answers, kinds of source, and whether it is the target's.

    ``rank`` orders by count, then by first place. Counted by URL first, so a popular domain is no hot key; of its URLs the first
    ``urls`` in order of spelling are listed, and ``citation_urls`` has all.
    """
    good = eligible_answers(answers).select("experiment_id", "answer_id", "ordinal")
    rows = citations.join(good, ["experiment_id", "answer_id"])
    by_url = rows.groupBy("experiment_id", "domain", "url").agg(F.count("*").alias("n"), F.collect_set("source").alias("kinds"), F.min(F.struct("ordinal", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("experiment_id", "domain").orderBy("url"))
    by_url = by_url.withColumn("url", F.when(place <= urls, F.col("url")))
    by_domain = by_url.groupBy("experiment_id", "domain").agg(F.sum("n").alias("citations"), F.count("*").alias("n_urls"), F.array_sort(F.collect_list("url")).alias("urls"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("source_kinds"), F.min("first").alias("first"))
    n_answers = rows.select("experiment_id", "domain", "answer_id").distinct().groupBy("experiment_id", "domain").agg(F.count("*").alias("n_answers"))
    target = brands.filter("kind = 'target'").groupBy("experiment_id").agg(F.min("host").alias("host"))
    out = by_domain.join(n_answers, ["experiment_id", "domain"]).join(target, "experiment_id", "left")
    rank = F.row_number().over(Window.partitionBy("experiment_id").orderBy(F.desc("citations"), "first", "domain"))
    return out.select("experiment_id", "domain", "citations", "n_urls", "n_answers", "urls", "source_kinds", host_matches(F.col("domain"), F.col("host")).alias("target"), rank.alias("rank"))


def citation_concentration(domains: DataFrame, top: int = 5) -> DataFrame:
    """Share of an experiment's citations that go to its most cited domains."""
    out = domains.groupBy("experiment_id").agg(F.sum(F.when(F.col("rank") <= top, F.col("citations")).otherwise(0)).alias("top"), F.sum("citations").alias("citations"))
    return out.select("experiment_id", "top", "citations", *share("top", "citations", "concentration"))


def claim_agreement(claims: DataFrame) -> DataFrame:
    """Supported of all supported and contradicted claims; others are counted apart. claims: of eligible answers."""
    kind = F.col("classification")
    out = claims.groupBy("experiment_id").agg(F.count_if(kind == "supported").alias("supported"), F.count_if(kind.isin("supported", "contradicted")).alias("judged"), F.count_if(kind == "unverifiable").alias("unverifiable"), F.count_if(kind == "time_sensitive").alias("time_sensitive"))
    return out.select("experiment_id", "supported", "judged", *share("supported", "judged", "agreement"), "unverifiable", "time_sensitive")


#: What answers are sliced by, besides taken as a whole.
DIMENSIONS = ("stage", "type", "persona_id", "source")


def _dimensions(answers: DataFrame) -> DataFrame:
    """Eligible answers with their value in each dimension, '' where there is none."""
    source = F.concat_ws(" / ", "provider", "model")
    values = (F.coalesce((source if d == "source" else F.col(d)).cast("string"), F.lit("")).alias(d) for d in DIMENSIONS)
    return eligible_answers(answers).select("experiment_id", "answer_id", "ordinal", *values)


def _by_slice(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """(keys.., dimension, value, sums): rows, aggregated by all dimensions before, as a whole and by each dimension alone, in one pass of grouping sets."""
    sets = [[F.col(k) for k in keys], *([F.col(k) for k in (*keys, d)] for d in DIMENSIONS)]
    dimension = F.lit("all")
    for d in DIMENSIONS:
        dimension = F.when(F.grouping(d) == 0, d).otherwise(dimension)
    out = rows.groupingSets(sets, *(F.col(c) for c in (*keys, *DIMENSIONS))).agg(dimension.alias("dimension"), *sums)
    return out.withColumn("value", F.coalesce(*DIMENSIONS, F.lit(""))).drop(*DIMENSIONS)


def sliced_citations(answers: DataFrame, brands: DataFrame, citations: DataFrame) -> DataFrame:
    """``citation_domains`` without lists, of each experiment as a whole (dimension all) and by each stage, type, persona and source.

    An answer has one value in a dimension, so rows of (domain, answer) are counted once by all dimensions together, and the counts of
    slices are sums of these; only URLs, which several answers may cite, are told apart by slice.
    """
    keys = ["experiment_id", "domain"]
    rows = citations.select("experiment_id", "answer_id", "pos", "url", "domain").join(_dimensions(answers), ["experiment_id", "answer_id"])
    once = rows.groupBy(*keys, *DIMENSIONS, "answer_id").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "pos")).alias("first"))
    counts = once.groupBy(*keys, *DIMENSIONS).agg(F.sum("n").alias("n"), F.count("*").alias("answers"), F.min("first").alias("first"))
    out = _by_slice(counts, keys, F.sum("n").alias("citations"), F.sum("answers").alias("n_answers"), F.min("first").alias("first"))
    urls = _by_slice(rows.select(*keys, "url", *DIMENSIONS).distinct(), [*keys, "url"]).groupBy(*keys, "dimension", "value").agg(F.count("*").alias("n_urls"))
    target = brands.filter("kind = 'target'").groupBy("experiment_id").agg(F.min("host").alias("host"))
    out = out.join(urls, [*keys, "dimension", "value"]).join(target, "experiment_id", "left")
    rank = F.row_number().over(Window.partitionBy("experiment_id", "dimension", "value").orderBy(F.desc("citations"), "first", "domain"))
    return out.select("experiment_id", "dimension", "value", "domain", "citations", "n_urls", "n_answers", host_matches(F.col("domain"), F.col("host")).alias("target"), rank.alias("rank"))


def sliced_concentration(domains: DataFrame, top: int = 5) -> DataFrame:
    """``citation_concentration`` by slice. domains: of ``sliced_citations``."""
    keys = ["experiment_id", "dimension", "value"]
    out = domains.groupBy(*keys).agg(F.sum(F.when(F.col("rank") <= top, F.col("citations")).otherwise(0)).alias("top"), F.sum("citations").alias("citations"))
    return out.select(*keys, "top", "citations", *share("top", "citations", "concentration"))


def sliced_agreement(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """``claim_agreement`` by slice. claims: experiment_id, answer_id, classification."""
    kinds = ("supported", "contradicted", "unverifiable", "time_sensitive")
    counts = claims.select("experiment_id", "answer_id", "classification").join(_dimensions(answers), ["experiment_id", "answer_id"]).groupBy("experiment_id", *DIMENSIONS).agg(*(F.count_if(F.col("classification") == k).alias(k) for k in kinds))
    out = _by_slice(counts, ["experiment_id"], *(F.sum(k).alias(k) for k in kinds)).withColumn("judged", F.col("supported") + F.col("contradicted"))
    return out.select("experiment_id", "dimension", "value", "supported", "judged", *share("supported", "judged", "agreement"), "unverifiable", "time_sensitive")


def adjudicate_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims with the classification that the experiment's facts allow.

    A claim whose facts disagree with others of the same subject and attribute is unverifiable; one on prices, or whose words tie
    it to a time, is time sensitive. claims: experiment_id, claim_id, text, classification, fact_ids. facts: experiment_id, fact_id,
    category, subject, attribute, value. Disagreement is a count by subject and attribute, not a self-join.
    """
    from ..functions.text import comparable

    group = Window.partitionBy("experiment_id", comparable(F.col("subject")), comparable(F.col("attribute")))
    value = comparable(F.col("value"))
    facts = facts.select("experiment_id", "fact_id", (F.col("category") == "pricing").alias("priced"), (F.min(value).over(group) != F.max(value).over(group)).alias("conflict"))
    used = claims.select("experiment_id", "claim_id", F.explode("fact_ids").alias("fact_id")).join(facts, ["experiment_id", "fact_id"])
    used = used.groupBy("experiment_id", "claim_id").agg(F.max("conflict").alias("conflict"), F.max("priced").alias("priced"))
    dated = F.col("text").rlike(r"(?i)\b(?:currently|today|as of|per month|per year)\b")
    kind = F.when(F.coalesce("conflict", F.lit(False)), "unverifiable").when(F.coalesce("priced", F.lit(False)) | dated, "time_sensitive").otherwise(F.col("classification"))
    return claims.join(used, ["experiment_id", "claim_id"], "left").withColumn("classification", kind).drop("conflict", "priced")


def answer_grid(questions: DataFrame, samples: int) -> DataFrame:
    """A row for each question and sample, with a dense ordinal from 0 in order of sample and place. Questions of a run are few."""
    rows = questions.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("experiment_id").orderBy("sample", "place")) - 1)


def previous_run(runs: DataFrame, setup: list[str]) -> DataFrame:
    """Runs with the latest strictly earlier run of the same project and setup, or null: an as-of look-back."""
    before = Window.partitionBy("project_id", *setup).orderBy(F.unix_micros(F.col("created_at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct("created_at", "run_id")).over(before)
    return runs.withColumn("previous_run_id", latest["run_id"])


def run_history(metrics: DataFrame, runs: DataFrame, latest: int = 20) -> DataFrame:
    """Brand metrics of each project's latest runs."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("experiment_id")))
    return metrics.join(runs.withColumn("_k", rank).filter(F.col("_k") <= latest).select("project_id", "experiment_id", "created_at"), "experiment_id")


def run_progress(answers: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """total, answered and completed answers of each run; completed only if all are, else partial, or cancelled if it was."""
    out = answers.groupBy("experiment_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("answered", "completed")).alias("answered"), F.count_if(F.col("status") == "completed").alias("completed"))
    stopped = F.lit(False)
    if cancelled is not None:
        out, stopped = out.join(cancelled.select("experiment_id", F.lit(True).alias("_stop")).distinct(), "experiment_id", "left"), F.coalesce("_stop", F.lit(False))
    return out.withColumn("status", F.when(F.col("total") == F.col("completed"), "completed").when(stopped, "cancelled").otherwise("partial")).drop("_stop")


def run_estimate(questions: DataFrame, samples: int, output_tokens: int, overhead: int = 5000, allowance: DataFrame | None = None) -> DataFrame:
    """Requests and tokens that a run may use: two requests for each answer. allowance: experiment_id and tokens, of which ``remaining`` tells what would be left."""
    out = questions.groupBy("experiment_id").agg(F.count("*").alias("questions"), F.sum(F.length("text") / 4 + overhead).alias("_tokens"))
    n = F.col("questions") * samples
    out = out.select("experiment_id", "questions", n.alias("answers"), (n * 2).alias("requests"), F.ceil(F.col("_tokens") * samples).alias("input_tokens"), (n * 2 * output_tokens).alias("output_ceiling"))
    if allowance is None:
        return out
    used = F.col("input_tokens") + F.col("output_ceiling")
    return out.join(allowance, "experiment_id", "left").withColumn("remaining", F.greatest(F.lit(0), F.col("tokens") - used)).drop("tokens")
