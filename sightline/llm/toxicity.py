"""Toxicity of documents: a recurrent network scores all overlapping windows of a text, and a logistic model of these scores judges the text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .recurrent import Network, train, window_logits, words_of

#: What a fit may take: labelled documents of the rarer and of the other kind, bytes of their texts, and steps of the network.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES, FIT_STEPS = 1000, 2000, 12 << 20, 200
#: The model of scores is fitted to documents that the network has not learned from: one of so many folds, or, with fewer documents of a
#: label than FEW, all folds in turn, each with a network of its own.
FOLD, FEW = 4, 150
THRESHOLD = 0.7


class Scorer(NamedTuple):
    """The network and the weights of a text's features; without a network, the share of toxic documents among those it should learn from."""

    net: Network | None
    weights: np.ndarray | None
    share: float = 0.0


def features(logits: np.ndarray) -> list[float]:
    """Of a text's windows: mean logit, largest and mean of the three largest, share of likely ones, log of their number, and 1."""
    top = np.sort(logits)[-3:]
    return [float(logits.mean()), float(top[-1]), float(top.mean()), float((1 / (1 + np.exp(-np.clip(logits, -30, 30)))).mean()), float(np.log1p(len(logits))), 1.0]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
    return w


def fit_scorer(texts: list[str | None], labels: list[int], steps: int = FIT_STEPS) -> Scorer:
    """A scorer from whole texts with labels 0 and 1. Texts without words teach nothing; there must be one of both labels for each fold."""
    words = [words_of(t) for t in texts]
    rows = [k for k, w in enumerate(words) if w]
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    folds = [[k for kind in (0, 1) for k in [k for k in rows if labels[k] == kind][part::FOLD]] for part in range(FOLD)]
    if any({labels[k] for k in fold} != {0, 1} for fold in folds):
        return Scorer(None, None, share)
    few = min(sum(labels[k] == kind for k in rows) for kind in (0, 1)) < FEW
    judged, found, net = [], [], None
    for fold in folds if few else folds[:1]:
        others = sorted(set(rows) - set(fold))
        net = train([words[k] for k in others], y[others], steps)
        judged += fold
        found += [features(x) for x in window_logits(net, [texts[k] for k in fold])]
    net = train([words[k] for k in rows], y[rows], steps) if few else net
    return Scorer(net, logistic(np.array(found), y[judged]), share)


def fit_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, size: int) -> tuple[list[str], list[int]]:
    """Texts and labels for a fit: labelled ids of either kind with the smallest hashes, as many as asked for, while their texts fit in ``size``.

    An id with several labels is toxic if any is. The driver first gets ids and lengths, then whole texts.
    """
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    chosen = [told.filter(test).orderBy(place, "doc_id").limit(n) for test, n in (("toxic > 0", toxic), ("toxic <= 0", clean))]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").filter("text <> ''")
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.max("toxic").alias("toxic"), F.min(place).alias("place")).collect()
    taken, kinds, left = [], {}, size
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        if r["size"] <= left:
            left -= r["size"]
            taken.append(r["doc_id"])
            kinds[r["doc_id"]] = int(r["toxic"] > 0)
    found = texts.filter(F.col("doc_id").isin(taken)).collect() if taken else []
    order = {i: k for k, i in enumerate(taken)}
    found.sort(key=lambda r: (order[r["doc_id"]], r["text"]))
    return [r["text"] for r in found], [kinds[r["doc_id"]] for r in found]


def score_documents(docs: DataFrame, scorer: Scorer, id: str = "doc_id") -> DataFrame:
    """docs' id with score, the probability that the whole text is toxic; 0 for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if scorer.net is None:
                scores = [scorer.share if words_of(x.as_py()) else 0.0 for x in batch["text"]]
            else:
                found = window_logits(scorer.net, (x.as_py() for x in batch["text"]))
                scores = [1 / (1 + float(np.exp(-np.clip(np.dot(features(x), scorer.weights), -500, 500)))) if len(x) else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays([batch[id], pa.array(scores, pa.float64())], [id, "score"])

    rows = docs.select(id, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"{id} {dict(rows.dtypes)[id]}, score double")


def held_out(id: Column) -> Column:
    """Ids whose labels aren't learned from: every third by CRC-32. A row without an id isn't one of them."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, size: int = FIT_BYTES, steps: int = FIT_STEPS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    A network learns from windows of labelled documents that aren't held out, a bounded sample of them (``fit_rows``), what tells toxic
    ones; it knows words by themselves and by their character n-grams. It scores all overlapping windows of every whole text,
    and a logistic model of a text's window scores gives its probability. Only the text is scored.

    Null and empty texts, and those without a letter or digit, score 0. A very long text is scored in pieces that overlap as windows do. Rows
    repeat in the result as in docs; equal texts score the same. A null or repeated doc_id is handed on, and labels of ids that aren't
    there count for nothing. Without labels of both kinds all texts with words score the share of toxic ones among what
    there is to learn from, 0 if there is nothing. A score that equals the threshold is toxic. An empty table gives no rows; other columns
    are ignored.
    """
    texts, kinds = fit_rows(docs, labels.filter(~held_out(F.col("doc_id"))), toxic, clean, size)
    scored = score_documents(docs, fit_scorer(texts, kinds, steps))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
