"""Quality rules: a base rule for each document and a verdict for each host, joined back to its documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted_left_join, table

SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Words of a window whose repetition counts against a text.
REPEAT_WIDTH = 5


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null has none of them."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at the six ASCII spaces only
    lines = [x for x in (text or "").split("\n") if HAS_WORD.search(x)]
    windows = list(zip(*(words[k:] for k in range(REPEAT_WIDTH)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, upto = Counter(windows), 0
        for k, window in enumerate(windows):
            if often[window] > 1:
                repeated += k + REPEAT_WIDTH - max(k, upto)
                upto = k + REPEAT_WIDTH
    spaces, symbols = len(raw) - len(raw.translate(None, SPACES)), len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = zip(*(measure(x.as_py()) for x in batch.column(2)), strict=True) if batch.num_rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "host", *MEASURES])


def rules() -> dict[str, Column]:
    """The base rule's parts, whose failures are counted by host each: too few words, too many of them in repeated windows."""
    return {"short": F.col("n_words") < 10, "repetitive": 100 * F.col("n_repeat_words") > 20 * F.col("n_words")}


def quality_rules(docs: DataFrame, host: Column | None = None, host_limit: float = 0.5, strength: float = 1000.0) -> DataFrame:
    """One row for each document: its measures, ``base_failed``, its host's shrunken failure rate by rule and ``kept``.

    A document fails the base rule with fewer than 10 words, or when over 20 % of its words stand in repeated
    5-word windows. Failures are counted by host and rule; a beta prior for each rule, fitted to all hosts by moments, shrinks each host's
    rate, so that a host with few documents leans on the others. A host with a shrunken rate over ``host_limit``
    is rejected with all its documents. ``strength`` is the prior's largest weight, for a rule in which hosts don't differ.

    Null text has no words and fails; a null host counts as the host ''. A very long text is measured whole. Repeated rows count each,
    and doc_id is only handed on, so null and repeated ones don't matter; a rate that equals the limit is kept. An empty table
    gives no rows; other columns are ignored. The measures are cut to the checkpoint folder, as they are used twice.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("source") if host is None else host, F.lit("")).cast("string").alias("host"), "text")
    kinds = ", ".join(f"{c} long" for c in MEASURES)
    failed = F.greatest(*rules().values())
    rows = cut(rows.mapInArrow(_measured, f"doc_id {dict(docs.dtypes)['doc_id']}, host string, {kinds}").withColumn("base_failed", failed))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.count_if(test).alias(f"failed_{rule}") for rule, test in rules().items()))
    for rule, (a, b) in beta_priors(hosts, strength).items():
        hosts = hosts.withColumn(f"rate_{rule}", (F.col(f"failed_{rule}") + a) / (F.col("host_docs") + a + b))
    rates = [F.col(f"rate_{rule}") for rule in rules()]
    return salted_left_join(rows, hosts, ["host"], F.rand(1)).withColumn("kept", ~F.col("base_failed") & (F.greatest(*rates) <= host_limit))


def beta_priors(hosts: DataFrame, strength: float) -> dict[str, tuple[float, float]]:
    """Beta parameters by moments for each rule: the overall failure rate, and the spread of the hosts' rates about it.

    With a prior of weight w the rates of hosts with n documents spread by m (1 - m) (r + (1 - r) / n) about the mean m, where r is
    1 / (w + 1) and the second part is what the few documents of a host add by chance. The weighted mean of this, set equal to what is found, gives r.
    """
    n, failures = F.col("host_docs"), {rule: F.col(f"failed_{rule}") for rule in rules()}
    sums = [x for rule, f in failures.items() for x in (F.sum(f).alias(f"f_{rule}"), F.sum(f * f / n).alias(f"ff_{rule}"))]
    row, out = hosts.agg(F.sum(n).alias("n"), F.count("*").alias("hosts"), *sums).first(), {}
    for rule in failures:
        if not row["n"]:
            out[rule] = (1.0, 1.0)
            continue
        mean, chance = (row[f"f_{rule}"] + 0.5) / (row["n"] + 1), row["hosts"] / row["n"]
        spread = (row[f"ff_{rule}"] / row["n"] - (row[f"f_{rule}"] / row["n"]) ** 2) / (mean * (1 - mean))
        share = (spread - chance) / (1 - chance) if chance < 1 else 0.0
        weight = min(strength, max(2.0, 1 / share - 1)) if share > 0 else strength
        out[rule] = (mean * weight, (1 - mean) * weight)
    return out


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")
