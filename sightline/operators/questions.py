"""Buyer questions: repeats, recommended selection, checks of the library, evidence.

Questions: id, project_id, persona_id, text, stage, type, geography, intent, branded, status, selected, created_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_question, question_key
from .visibility import STAGE_WEIGHTS

STAGES = tuple(STAGE_WEIGHTS)


def dedupe_questions(questions: DataFrame, by: str = "project_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The first of each project's questions that are the same but for filler words and punctuation; archived ones count.

    An equivalence by one key, so it is one shuffle and no comparison of pairs.
    """
    rows = questions.withColumn("normalized_text", normalized_question(F.col("text")))
    rows = rows.withColumn("_key", question_key(F.col("normalized_text")))
    first = F.row_number().over(Window.partitionBy(by, "_key").orderBy(*order))
    return rows.withColumn("_k", first).filter("_k = 1").drop("_k", "_key")


def recommended_questions(questions: DataFrame, limit: int = 20, by: str = "project_id") -> DataFrame:
    """Up to 20 active questions of each project, with their place: breadth first, then the strongest intent.

    The first of each stage in order, of each persona, the first branded one, the first that isn't, the first of low intent; then
    all by intent and id.
    """
    rank = Window.partitionBy(by).orderBy(F.desc("intent"), "id")
    rows = questions.filter("status = 'active'").withColumn("_r", F.row_number().over(rank))
    first = lambda *keys: F.row_number().over(Window.partitionBy(by, *keys).orderBy("_r")) == 1
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    low = F.col("intent") <= 2
    seats = F.array(
        F.when(first("stage") & (stage > 0), F.struct(F.lit(0).alias("level"), stage.alias("at"))),
        F.when(first("persona_id"), F.struct(F.lit(1).alias("level"), F.col("_r").alias("at"))),
        F.when(first("branded") & F.col("branded"), F.struct(F.lit(2).alias("level"), F.lit(0).alias("at"))),
        F.when(first("branded") & ~F.col("branded"), F.struct(F.lit(3).alias("level"), F.lit(0).alias("at"))),
        F.when(first(low) & low, F.struct(F.lit(4).alias("level"), F.lit(0).alias("at"))),
        F.struct(F.lit(5).alias("level"), F.col("_r").alias("at")),
    )
    rows = rows.withColumn("_seat", F.array_min(F.filter(seats, lambda s: s.isNotNull())))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_seat"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("_r", "_seat")


def library_check(questions: DataFrame, by: str = "project_id", least: int = 30) -> DataFrame:
    """Whether a project has 30 active questions or more, of low and high intent, with brands and without."""
    rows = questions.filter("status = 'active'")
    out = rows.groupBy(by).agg(F.count("*").alias("active"), F.max(F.col("intent") <= 2).alias("low"), F.max(F.col("intent") >= 4).alias("high"), F.max("branded").alias("branded"), F.max(~F.col("branded")).alias("unbranded"))
    return out.withColumn("complete", (F.col("active") >= least) & F.col("low") & F.col("high") & F.col("branded") & F.col("unbranded"))


def stage_shortage(questions: DataFrame, by: str = "project_id") -> DataFrame:
    """The stage with the fewest active questions, the earlier one on ties."""
    counts = [F.struct(F.count_if((F.col("stage") == s) & (F.col("status") == "active")).alias("n"), F.lit(k).alias("k"), F.lit(s).alias("stage")) for k, s in enumerate(STAGES)]
    return questions.groupBy(by).agg(F.least(*counts).alias("s")).select(by, "s.stage", "s.n")


#: Selected questions of a block of the fingerprint.
BLOCK = 1000


def selection_fingerprint(questions: DataFrame, by: str = "project_id") -> DataFrame:
    """SHA-256 over a project's selected questions in order of id: over the digests of blocks of BLOCK of them."""
    line = F.concat_ws("|", "id", "text", "geography")
    rows = questions.filter("selected").select(by, "id", F.sha2(line, 256).alias("line"), (F.row_number().over(Window.partitionBy(by).orderBy("id", line)) - 1).alias("_k"))
    joined = lambda place, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda r: r[value]), "\n"), 256)
    blocks = rows.groupBy(by, F.floor(F.col("_k") / BLOCK).alias("_block")).agg(joined("_k", "line").alias("digest"))
    return blocks.groupBy(by).agg(joined("_block", "digest").alias("fingerprint"))


def filter_questions(questions: DataFrame, status=None, stage=None, persona=None, selected=None, words: str | None = None) -> DataFrame:
    for name, value in (("status", status), ("stage", stage), ("persona_id", persona), ("selected", selected)):
        questions = questions.filter(F.col(name) == F.lit(value)) if value is not None else questions
    return questions.filter(F.contains(F.lower("text"), F.lower(F.lit(words)))) if words else questions


def question_evidence(questions: DataFrame, snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """(question_id, fact_id, value) of a question's facts, as they were when it was made, else as they are."""
    used = questions.select(F.col("id").alias("question_id"), F.explode("target_fact_ids").alias("fact_id"))
    then = snapshot.select("question_id", "fact_id", F.col("value").alias("_then"))
    now = live.select(F.col("id").alias("fact_id"), F.col("value").alias("_now"))
    return used.join(then, ["question_id", "fact_id"], "left").join(now, "fact_id", "left").select("question_id", "fact_id", F.coalesce("_then", "_now").alias("value"))
