"""Substring dedup of words: difference-cover anchors find repeated windows, which are then extended and counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .copies import COPY, with_roles
from .kernels import hashed_words, in_a_row, mix, ragged, row_of, runs, slices

#: Words of a window.
WIDTH = 35
#: Each difference modulo 21 is one of two members of the cover, so for any two positions some shift below 21 brings both
#: onto the cover at once. An anchor of 35 - 20 = 15 words at the shifted place lies wholly inside the repeated window.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WIDTH - PERIOD + 1


def _batch(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key.., row, place) where place holds the position and whether the key is repeated here for sure.

    Of the rows of a key that is repeated in the batch only the first keeps its key, for others to meet; the rest take a key of
    their own. So a key which thousands of documents share is shuffled once for each batch and not once for each document.
    """
    if not len(doc):
        return
    order = np.lexsort(tuple(keys[::-1]))
    same = np.all(keys[:, order[1:]] == keys[:, order[:-1]], axis=0)
    again, before = np.r_[False, same], np.r_[same, False]
    sure, alone = np.zeros(len(order), bool), np.zeros(len(order), bool)
    sure[order], alone[order] = again | before, again
    keys[:, alone] = mix(mix(doc[alone].astype(np.uint64)) + pos[alone].astype(np.uint64))
    place = pos.astype(np.int64) * 2 + sure
    for low in range(0, len(doc), 200_000):
        part = slice(low, low + 200_000)
        yield pa.RecordBatch.from_arrays([*(pa.array(k[part].view(np.int64)) for k in keys), pa.array(doc[part]), pa.array(place[part])], [*(f"k{i}" for i in range(len(keys))), "row", "place"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for batch in batches:
        for piece, _, _ in slices(batch, "text"):
            (hashes, _), first = hashed_words(piece.column("text"))
            row = row_of(first)
            pos = np.arange(len(row)) - first[row]
            here = np.flatnonzero(cover[pos % PERIOD] & (pos + ANCHOR <= np.diff(first)[row]) & (np.diff(first)[row] >= WIDTH))
            yield from _batch(in_a_row(hashes, ANCHOR)[here][None], np.asarray(piece.column(0))[row[here]], pos[here])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows that hold a repeated anchor, under 128 bits of hash."""
    for batch in batches:
        for piece, _, _ in slices(batch, "text"):
            hashes, first = hashed_words(piece.column("text"))
            n, marked = np.diff(first), piece.column("marks")
            row, pos = row_of(np.asarray(marked.offsets)), np.asarray(marked.flatten())
            low = np.maximum(pos - (PERIOD - 1), 0)
            high = np.minimum(pos, n[row] - WIDTH)
            start = np.unique(ragged(first[row] + low, np.maximum(high - low + 1, 0)))
            keys = np.array([in_a_row(lane, WIDTH)[start] for lane in hashes]).reshape(2, -1)
            row = np.searchsorted(first, start, "right") - 1
            yield from _batch(keys, np.asarray(piece.column(0))[row], start - first[row])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [])
        for doc, text, role, marks in zip(*(batch.column(k) for k in range(4)), strict=True):
            own, starts, ends = (text.as_py() or "").encode().split(), [], []
            if role.as_py() and len(own) >= WIDTH:
                starts, ends = [0], [len(own)]
            elif marks.is_valid:
                starts, ends = runs(np.asarray(marks.values), WIDTH, len(own))
            kept = [w for i, j in zip([0, *ends], [*starts, len(own)], strict=True) for w in own[i:j]]
            for column, value in zip(columns, (doc.as_py(), len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(row, marks): each document's positions whose key also stands elsewhere.

    A key has at most one row for each batch that holds it (see _batch), so no key is hot beyond the number of batches.
    """
    met = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    found = rows.withColumn("_met", met).filter((F.col("place") % 2 == 1) | (F.col("_met") > 1))
    return found.groupBy("row").agg(F.collect_list((F.col("place") / 2).cast("int")).alias("marks"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, role, marks): the start words of each document's windows of 35 words that also start anywhere else.

    1. Of exact copies of a text only the first is looked at; a document whose role isn't 0 is repeated as a whole.
    2. Anchors of 15 words are hashed at cover positions only, 5 of each 21. Two equal windows share an anchor, whatever
       their positions, so documents without a repeated anchor are done.
    3. Each repeated anchor extends to the windows around it, and these are counted under 128 bits of hash. Groups of any
       number of copies are counted, never paired.
    All steps read one shuffle of the texts by row, so they all take doc_id along.

    Null and empty texts have no words. Texts of fewer than 35 words have no window; a very long text is worked on alone, as a whole.
    Rows with equal doc_id and text are copies of each other; a doc_id with several texts, or a null one, is a document for each
    row. No order of rows matters, so there are no ties. An empty table gives no rows; other columns are ignored.
    """
    docs = with_roles(docs)
    anchors = docs.filter(F.col("role") < COPY).select("row", "doc_id", "text").mapInArrow(_anchors, "k0 long, row long, place long")
    marked = docs.filter(F.col("role") < COPY).join(repeated(anchors, ["k0"]), "row").select("row", "doc_id", "text", "marks")
    windows = marked.mapInArrow(_windows, "k0 long, k1 long, row long, place long")
    return docs.join(repeated(windows, ["k0", "k1"]), "row", "left").select("doc_id", "text", "role", "marks")


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document without the words that repeated windows cover; see repeated_windows."""
    return repeated_windows(docs).mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"))
