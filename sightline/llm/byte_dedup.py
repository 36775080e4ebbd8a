"""Suffix-array dedup of bytes: repeated strings are found in suffix arrays of shards whose contexts share an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .copies import COPY, with_roles
from .kernels import byte_grams, byte_spans, mix, ragged, row_of, runs, slices
from .suffixes import common_prefixes, suffix_array

#: Bytes of a string that counts.
WIDTH = 200
#: The anchor of a string is the least hash of its first REACH grams of GRAM bytes, so equal strings have equal anchors, and
#: the KEY bytes from the anchor on lie inside the string.
GRAM, REACH = 32, 128
KEY = WIDTH - REACH + 1
#: Bytes of contexts in one suffix array, and leading bits of a string's hash that set the range in which shards of an anchor are merged.
SHARD_BYTES, RANGE_BITS = 1 << 19, 8
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 19


def _least_before(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` (a power of two) values in a row."""
    shift = 1
    while shift < reach:
        values = np.minimum(values[:-shift], values[shift:])
        shift *= 2
    return values


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor: its key, 128 bits of hash of its context, and the starts of the strings that it is the anchor of.

    A context are the bytes of all these strings. Of equal contexts in a slice, which are repeated for sure, only the first
    keeps the key; the others take one of their own. So copies are shuffled to their key once for each slice.
    """
    for batch in batches:
        for piece, raw, at in slices(batch, "text", SLICE_BYTES):
            length = np.diff(at)
            count = np.maximum(length - WIDTH + 1, 0)
            start = ragged(at[:-1], count)
            if not len(start):
                continue
            grams = [byte_grams(raw, seed) for seed in (6, 7)]
            hashed = grams[0] & np.uint64(0xFFFFFFFF00000000) | np.arange(len(raw) - GRAM + 1, dtype=np.uint64)
            anchor = (_least_before(hashed, REACH)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            size = np.diff(np.r_[begin, len(start)])
            anchor, low = anchor[begin], start[begin]
            row = np.searchsorted(at, low, "right") - 1
            doc, pos = np.asarray(piece.column(0))[row], low - at[row]
            key = byte_spans(grams[0], anchor, np.full(len(anchor), KEY))
            content, more = (byte_spans(g, low, size + WIDTH - 1) ^ mix((anchor - low).astype(np.uint64)) for g in grams)
            order = np.lexsort((more, content, key))
            same = (key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
            sure, alone = np.zeros(len(key), bool), np.zeros(len(key), bool)
            sure[order], alone[order] = np.r_[False, same] | np.r_[same, False], np.r_[False, same]
            key[alone] = mix(mix(doc[alone].astype(np.uint64)) + pos[alone].astype(np.uint64))
            place = pos << 16 | size << 1 | sure
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(more.view(np.int64)), pa.array(doc), pa.array(place)], ["key", "content", "more", "row", "place"])


#: What a mark says of an anchor's strings: they are repeated for sure; they have to be compared with others of the key.
RESOLVED, COMPARED = 1, 2


def _unplaced(marks: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """First start and number of each mark's strings."""
    place = np.asarray(marks.field("place"))
    return place >> 16, place >> 1 & 0x7FFF


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, deal, parts, row, pos, size, context) of the contexts that have to be compared."""
    for batch in batches:
        for piece, raw, at in slices(batch, "text", SLICE_BYTES):
            marks = piece.column("marks")
            row, flat = row_of(np.asarray(marks.offsets)), marks.flatten()
            wanted = np.flatnonzero(np.asarray(flat.field("kind")) & COMPARED)
            if not len(wanted):
                continue
            flat, row = flat.take(pa.array(wanted)), row[wanted]
            pos, size = _unplaced(flat)
            low = at[row] + pos
            edge = np.r_[0, np.cumsum(size + WIDTH - 1)]
            for i in range(0, len(row), 2000):
                part = slice(i, i + 2000)
                data = raw[ragged(low[part], (size + WIDTH - 1)[part])]
                offsets = (edge[i : i + len(row[part]) + 1] - edge[i]).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(row[part]), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                own = [pa.array(np.asarray(piece.column(0))[row[part]]), pa.array(pos[part].astype(np.int32)), pa.array(size[part].astype(np.int32)), context]
                yield pa.RecordBatch.from_arrays([*(flat.field(k)[part] for k in ("key", "deal", "parts")), *own], _CONTEXT)


_CONTEXT = ["key", "deal", "parts", "row", "pos", "size", "context"]


def _shard(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Of a shard's contexts: row and start of each string in order, and which of these stand in the shard twice."""
    text = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    edge = np.r_[0, np.cumsum([len(r[6]) for r in rows])]
    valid = np.zeros(len(text), bool)
    valid[ragged(edge[:-1], np.array([r[5] for r in rows]))] = True
    suffix = suffix_array(text)
    shared = common_prefixes(text, suffix, WIDTH)
    slot = np.flatnonzero(valid[suffix])
    least = np.minimum.reduceat(shared[: slot[-1] + 1], np.r_[0, slot[:-1] + 1]) if len(slot) else shared[:0]
    same = least[1:] >= WIDTH
    twice = np.r_[False, same] | np.r_[same, False]
    here = suffix[slot]
    row = np.searchsorted(edge, here, "right") - 1
    return row, here, twice, text, edge


def _sharded(shard_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated strings (row, pos), and sorted strings of those anchors whose contexts fill more than one shard.

        Rows come sorted by deal. The first kind has no range; the second has lists of two hashes, rows and starts, cut at
        range bounds of the sorted hashes. An anchor dealt to more parts has finer ranges.
        """
        rows, size, carried = [], 0, None

        def build(open_key: int | None) -> Iterator[pa.RecordBatch]:
            at, here, twice, text, edge = _shard(rows)
            key, deal, parts, row, pos = (np.array([r[k] for r in rows], np.int64) for k in range(5))
            place = pos[at] + here - edge[at]
            yield _found(row[at[twice]], place[twice])
            grams = [byte_grams(text, seed) for seed in (10, 11)]
            for k in np.unique(key[(parts > 1) | (deal == carried) | (deal == open_key)]).tolist():
                own = np.flatnonzero(key[at] == k)
                if not len(own):
                    continue
                hashes = [byte_spans(g, here[own], np.full(len(own), WIDTH)) for g in grams]
                order = np.argsort(hashes[0], kind="stable")
                own, hashes = own[order], [h[order] for h in hashes]
                bits = RANGE_BITS + int(parts[at[own[0]]] - 1).bit_length()
                part = (hashes[0] >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                bounds, n = pa.array(np.r_[first, len(own)].astype(np.int32)), len(first)
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (hashes[0].view(np.int64), hashes[1].view(np.int64), row[at[own]], place[own])]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(np.full(n, k)), pa.array(part[first]), *lists], _NAMES)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and size >= shard_bytes:
                    open_key = rows[-1][1] if r[1] == rows[-1][1] else None
                    yield from build(open_key)
                    carried, rows, size = open_key, [], 0
                rows.append(r)
                size += len(r[6])
        if rows:
            yield from build(None)

    return work


_NAMES = ["row", "pos", "key", "part", "h0", "h1", "rows", "places"]
_KINDS = "row long, pos array<int>, key long, part long, h0 array<long>, h1 array<long>, rows array<long>, places array<long>"


def _found(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A row for each document, with the starts of its strings."""
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    starts = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array(pos.astype(np.int32)))
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), starts, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(4))], _NAMES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that stand in several shards of an anchor. Each shard's sorted hashes are searched for in those merged before.

    A string is told once, when it is first found, and those found are gathered over ranges before they are listed by document.
    """
    name, held, told, out = None, None, None, []
    for batch in batches:
        for key, part, h0, h1, docs, places in zip(*(batch.column(k).to_pylist() for k in ("key", "part", "h0", "h1", "rows", "places")), strict=True):
            new = [np.array(h0, np.int64).view(np.uint64), np.array(h1, np.int64).view(np.uint64), np.array(docs), np.array(places)]
            if (key, part) != name:
                name, held, told = (key, part), new, np.zeros(len(new[0]), bool)
                continue
            low, high = np.searchsorted(held[0], new[0], "left"), np.searchsorted(held[0], new[0], "right")
            mine = np.repeat(np.arange(len(low)), high - low)
            theirs = ragged(low, high - low)
            hit = new[1][mine] == held[1][theirs]
            mine, theirs = np.unique(mine[hit]), np.unique(theirs[hit])
            theirs = theirs[~told[theirs]]
            told[theirs] = True
            out.append((np.r_[new[2][mine], held[2][theirs]], np.r_[new[3][mine], held[3][theirs]]))
            if sum(len(o[0]) for o in out) >= 100_000:
                yield _found(*map(np.concatenate, zip(*out, strict=True)))
                out = []
            fresh = np.setdiff1d(np.arange(len(new[0])), mine)  # one of each string is enough to search in
            at = np.searchsorted(held[0], new[0][fresh])
            held, told = [np.insert(h, at, x[fresh]) for h, x in zip(held, new, strict=True)], np.insert(told, at, False)
    if out:
        yield _found(*map(np.concatenate, zip(*out, strict=True)))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, role, marks, more in zip(*(batch.column(k) for k in range(5)), strict=True):
            raw, starts, ends, pos = (text.as_py() or "").encode(), [], [], np.zeros(0, np.int64)
            if marks.is_valid:
                sure = np.flatnonzero(np.asarray(marks.values.field("kind")) & RESOLVED)
                pos = ragged(*(x[sure] for x in _unplaced(marks.values)))
            if more.is_valid:
                pos = np.r_[pos, np.asarray(more.values)]
            if role.as_py() and len(raw) >= WIDTH:
                starts, ends = [0], [len(raw)]
            elif len(pos):
                starts, ends = runs(pos, WIDTH, len(raw))
            kept = b"".join(raw[i:j] for i, j in zip([0, *ends], [*starts, len(raw)], strict=True))
            out.append((doc.as_py(), len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeated_strings(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each document without the bytes that repeated 200-byte strings cover.

    1. Of exact copies of a text only the first is looked at, and all are repeated as a whole. Each string belongs to an
       anchor near its start, chosen by content, so equal strings belong to anchors with equal keys. An anchor whose key is the
       only one of its kind is done. Contexts that are equal as a whole are repeated, and one of them stands for all.
    2. Differing contexts with equal keys are dealt by key to shards of about half a megabyte; a key with more contexts than fill
       one is dealt to several parts by content. A shard's suffix array (Larsson and Sadakane) and common prefixes (Kasai) show
       which strings stand in it twice.
    3. Contexts of one key that fill several shards: each shard's strings are sorted and cut into ranges, and each range is
       merged over the shards by binary search.
    Strings are judged on the input; a number of copies is counted and never paired. All steps read one shuffle of the texts,
    so they all take doc_id along.

    Null and empty texts have no bytes. Texts of under 200 bytes have no string; a very long text is worked on alone, as a whole. Rows
    with equal doc_id and text are copies of each other; a doc_id with several texts, or a null one, is a document for each row. No
    order of rows matters, so there are no ties. An empty table gives no rows; other columns are ignored.
    """
    docs = with_roles(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.filter(F.col("role") < COPY).select("row", "doc_id", "text").mapInArrow(_contexts, "key long, content long, more long, row long, place long").repartition(n, "key")
    equal, key = Window.partitionBy("key", "content", "more"), Window.partitionBy("key")  # in this order both read one sort
    rows = rows.select("*", F.max(F.col("place") % 2).over(equal).alias("sure"), F.count(F.lit(1)).over(equal).alias("n"), F.min("row").over(equal).alias("first"))
    differ = (F.min("content").over(key) != F.max("content").over(key)) | (F.min("more").over(key) != F.max("more").over(key))
    bytes_ = F.sum((F.shiftright("place", 1).bitwiseAND(F.lit(0x7FFF)) + WIDTH - 1) / F.col("n")).over(key)  # equal contexts count once
    rows = rows.select("*", differ.alias("several"), F.ceil(bytes_ / shard_bytes).cast("int").alias("parts"))
    resolved = (F.col("sure") == 1) | (F.col("n") > 1)
    compared = F.col("several") & (~resolved | (F.col("first") == F.col("row")))
    deal = F.when(F.col("parts") > 1, F.xxhash64("key", F.pmod("content", "parts"))).otherwise(F.col("key"))
    rows = rows.select("key", "row", "place", deal.alias("deal"), "parts", (F.when(resolved, RESOLVED).otherwise(0) + F.when(compared, COMPARED).otherwise(0)).alias("kind"))
    marks = rows.filter("kind > 0").groupBy("row").agg(F.collect_list(F.struct("key", "place", "deal", "parts", "kind")).alias("marks"))
    contexts = docs.filter(F.col("role") < COPY).join(marks, "row").select("row", "doc_id", "text", "marks").mapInArrow(_cut_out, "key long, deal long, parts int, row long, pos int, size int, context binary")
    shards = contexts.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(_sharded(shard_bytes), _KINDS)
    # one shuffle carries both kinds: found strings to their document, ranges to be merged to their own task
    placed = shards.withColumn("to", F.when(F.col("key").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("key", "part")))
    merged = placed.repartition(n, "to").sortWithinPartitions("key", "part").mapInArrow(_settled, "row long, pos array<int>")
    more = merged.groupBy("row").agg(F.flatten(F.collect_list("pos")).alias("more"))
    rows = docs.join(marks, "row", "left").join(more, "row", "left").select("doc_id", "text", "role", "marks", "more")
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Found strings as they come, then what merging finds."""

    def ranges() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).is_null()
            if found.true_count:
                done.append(batch.filter(found).select([0, 1]))
            if found.true_count < batch.num_rows:
                yield batch.filter(pa.compute.invert(found))

    done: list[pa.RecordBatch] = []
    for batch in _merged(ranges()):
        yield batch.select([0, 1])
        while done:
            yield done.pop()
    yield from done


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents"))
