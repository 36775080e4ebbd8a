"""MinHash near-dedup by tensored banding: table keys pair two smaller collections of hashes; links are confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted_left_join, table
from .components import components
from .copies import Keyed, keyed, own_id
from .kernels import hashed_words, in_a_row, mix, paired, ragged, slices

#: Words of a shingle; a link needs PERCENT of the union in common.
WIDTH, PERCENT = 5, 75
#: Two collections of SIDE keys, each key made of HALF minhashes: SIDE * SIDE tables of 2 * HALF minhashes from only
#: 2 * SIDE * HALF minhash functions. Two sets at 0.75 share no table with a probability of about 2 * (1 - 0.75**3)**18 = 0.0001.
SIDE, HALF = 18, 3
#: Candidates need this share of equal minhashes: five standard deviations below the threshold for 108 of them.
LEAST_SHARE = 0.55
#: Rows of a first-collection bucket up to which all its pairs are looked at; those of a larger one are dealt out to its tables.
PAIRED = 256
#: Tables of a larger bucket that a task holds; those of a still larger one are shuffled.
HELD = 1 << 20
#: Documents, and shingles, that are held against each other in one task; larger groups are dealt out to pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

def shingle_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Two hashes of each distinct shingle of each row, sorted by the first; a row of fewer than five words has its whole sequence as one."""
    lanes, first = hashed_words(texts, lower=True)
    five, out = [in_a_row(x, WIDTH) for x in lanes], []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= WIDTH:
            _, at = np.unique(five[0][i : j - WIDTH + 1], return_index=True)
            out.append(np.array([x[i : j - WIDTH + 1][at] for x in five]))
        else:
            whole = np.full((2, min(j - i, 1)), j - i, np.uint64)
            for k in range(i, j):
                whole = paired(whole, lanes[:, k : k + 1])
            out.append(whole)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, size and digest of the shingle set, the first collection's keys, and a byte of each minhash."""
    drawn = np.random.default_rng(20).integers(1, 1 << 63, (2, 2 * SIDE * HALF), dtype=np.uint64)
    for batch in batches:
        for piece, _, _ in slices(batch, "text"):
            sets = shingle_hashes(piece.column("text"))
            size = np.array([s.shape[1] for s in sets], np.int64)
            both, edge = np.concatenate(sets, axis=1), np.r_[0, np.cumsum(size)][:-1][size > 0]
            x = both[0]
            least = np.zeros((2 * SIDE * HALF, len(size)), np.uint64)
            digest = np.zeros((2, len(size)), np.uint64)
            if len(x):
                for k in range(2 * SIDE * HALF):
                    least[k, size > 0] = np.minimum.reduceat((x ^ drawn[0, k]) * (drawn[1, k] | np.uint64(1)), edge)
                for k in range(2):
                    digest[k, size > 0] = np.add.reduceat(mix(both[k] ^ drawn[1, k]), edge)
            bands = least[: SIDE * HALF].reshape(SIDE, HALF, -1)
            keys = np.arange(SIDE, dtype=np.uint64)[:, None] * np.ones(len(size), np.uint64)
            for k in range(HALF):
                keys = paired(keys, bands[:, k])
            small = np.ascontiguousarray((mix(least) & np.uint64(255)).astype(np.uint8).T)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * SIDE), pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel()))
            sketch = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.arange(len(size) + 1, dtype=np.int32) * small.shape[1]), pa.py_buffer(small)])
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(size), *(pa.array(d.view(np.int64)) for d in digest), lists, sketch], ["row", "doc_id", "n_shingles", "d1", "d2", "keys", "sketch"])


class _Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _colliding(paired: int, most: int = HELD):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidate pairs (a, b) of each first-collection bucket, and (table, a) of the buckets of over ``paired`` rows.

        Rows come sorted by the bucket's key. Rows of a bucket that share a key of the second collection too fall in one of
        the tables. In a bucket of up to ``paired`` rows all pairs are looked at; of all collisions, those that join two parts
        of the bucket are given, so a bucket of n rows gives fewer than n pairs. In a larger bucket each row is paired with the
        first of each of its tables. Once these are over ``most``, they and all later rows of the bucket are given with their
        tables. Memory is bounded by an Arrow batch, ``paired`` rows and ``most`` tables.
        """
        kept, wide = None, None  # the open bucket's rows, or its key if it is a larger one
        held, full = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), False  # its tables and their first rows, or that they were over ``most``

        def second(data: np.ndarray) -> np.ndarray:
            out = data[:, SIDE * HALF :].reshape(len(data), SIDE, HALF).astype(np.uint32)
            return out[:, :, 0] << 16 | out[:, :, 1] << 8 | out[:, :, 2]

        def pairs(key: np.ndarray, rep: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            place = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
            keys, forest, left, right = second(data), _Forest(len(key)), [], []
            i = np.arange(len(key))
            for back in range(1, int(place.max()) + 1):
                i = i[place[i] >= back]
                hit = i[(keys[i] == keys[i - back]).any(axis=1)]
                hit = hit[(data[hit] == data[hit - back]).mean(axis=1) >= LEAST_SHARE]
                for x in hit.tolist():
                    if rep[x] != rep[x - back] and forest.join(x, x - back):
                        left.append(rep[x])
                        right.append(rep[x - back])
            if left:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], _CANDIDATES)

        def tables(key: np.ndarray, rep: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            table = mix(key.view(np.uint64))[:, None] + np.arange(SIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return mix(mix(table) + second(data)).ravel(), np.repeat(rep, SIDE)

        def given(table: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(table.view(np.int64)), pa.array(rep), pa.nulls(len(table), pa.int64())], _CANDIDATES)

        def stars(table: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            """Pairs that join the rows of each table to its first."""
            _, at, which = np.unique(table, return_index=True, return_inverse=True)
            first = rep[at][which]
            far = np.flatnonzero(first != rep)
            node, ends = np.unique(np.r_[first[far], rep[far]], return_inverse=True)
            forest = _Forest(len(node))
            far = far[np.array([forest.join(x, y) for x, y in zip(*ends.reshape(2, -1).tolist(), strict=True)], bool)]
            return pa.RecordBatch.from_arrays([pa.nulls(len(far), pa.int64()), pa.array(rep[far]), pa.array(first[far])], _CANDIDATES)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            key = rows[0]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            large = count > paired
            if wide is not None:
                large |= key[start] == wide
            wider, opened = np.repeat(large, count), key == key[-1]
            more = wider & (key == wide) if full else np.zeros(len(key), bool)
            if more.any():
                yield given(*tables(*(x[more] for x in rows)))
            if (dealt := wider & ~more).any():
                yield stars(*map(np.concatenate, zip(held, tables(*(x[dealt] for x in rows)), strict=True)))
            full = full and key[-1] == wide
            if large[-1] and not full:
                table, rep = tables(*(x[opened] for x in rows))
                if wide is not None and key[-1] == wide:
                    table, rep = np.r_[held[0], table], np.r_[held[1], rep]
                table, at = np.unique(table, return_index=True)
                held = table, rep[at]
                if full := len(table) > most:
                    yield given(*held)
            if full or not large[-1]:
                held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if (whole := ~wider & ~opened).any():
                yield from pairs(*(x[whole] for x in rows))
            kept, wide = (None, key[-1]) if large[-1] else ([x[opened] for x in rows], None)
        if kept is not None:
            yield from pairs(*kept)

    return work


_CANDIDATES = ["table", "a", "b"]


def _candidates(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) that join what falls in a table together. keyed: key, rep, sketch.

    The rows of a larger bucket's table are each linked to one of them, whatever their sketches say: rows that are alike
    enough may both be unlike that one. Where a task can't hold the tables, it is the smallest, pre-aggregated and joined back salted.
    """
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(keyed.select("key", "rep", "sketch").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_colliding(PAIRED), "table long, a long, b long"))
    tabled = found.filter("table IS NOT NULL").select("table", "a")
    least = tabled.groupBy("table").agg(F.min("a").alias("b"), F.max("a").alias("most")).filter("b < most").drop("most")
    linked = salted_left_join(tabled, least, ["table"], F.col("a")).filter("a > b")
    return found.filter("table IS NULL").select("a", "b").union(linked.select("a", "b"))


def _links(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of all links among the sets, found by exact intersections over an inverted list."""
    n, size = len(sets), np.array([len(s) for s in sets])
    forest, found = _Forest(n), []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    lists, edge = holder[order], np.r_[0, np.cumsum(np.bincount(token))]
    bound = np.r_[0, np.cumsum(size)]
    roots, passed = np.arange(n), []

    def hold(y: int) -> None:
        t = token[bound[y] : bound[y + 1]]
        common = np.bincount(lists[ragged(edge[t], edge[t + 1] - edge[t])], minlength=n)
        for x in np.flatnonzero(100 * common >= PERCENT * (size + size[y] - common)).tolist():
            if forest.join(x, y):
                found.append((int(ids[x]), int(ids[y])))

    for y in range(n):
        if y >= 4 and y % 4 == 0:
            roots = np.array([forest.root(x) for x in range(n)])
        if y >= 4 and n > 8 and roots[y] == np.bincount(roots).argmax():
            passed.append(y)  # all that links to the largest part is found from the other side
        else:
            hold(y)
    # the largest part may have been another one then: in the end only rows of one and the same part go without
    largest = int(np.bincount([forest.root(x) for x in range(n)]).argmax())
    for y in passed:
        if forest.root(y) != forest.root(largest):
            hold(y)
    return found


def exact_shingles(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Each sequence's distinct shingles as numbers that are equal just where the shingles are; words are numbered from 1.

    Pairs, fours and fives of words are numbered in turn. A sequence of fewer than five words is filled up with zeros, none stays none.
    """
    long = [np.r_[s, np.zeros(max(0, WIDTH - len(s)), np.int64)] if len(s) else s for s in sequences]
    first, word = np.r_[0, np.cumsum([len(s) for s in long])], np.concatenate(long)
    number = lambda left, right: np.unique(left << 32 | right, return_inverse=True)[1]
    if len(word) < WIDTH:
        return [word[:0] for _ in long]
    two = number(word[:-1], word[1:])
    five = number(number(two[:-2], two[2:])[: len(word) - 4], word[4:])
    return [np.unique(five[i : max(i, j - WIDTH + 1)]) for i, j in zip(first[:-1], first[1:], strict=True)]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of blocks, confirmed on the full sets of the shingles themselves. Rows come sorted by group."""
    open_key, ids, texts, number = None, [], [], {}

    def close() -> Iterator[pa.RecordBatch]:
        if len(ids) > 1 and (found := _links(np.array(ids), exact_shingles(texts))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary())
        for *key, rep, text in zip(*(batch.column(k).to_pylist() for k in ("grp", "p", "q", "rep")), raw, strict=True):
            if key != open_key:
                yield from close()
                open_key, ids, texts, number = key, [], [], {}
            if not ids or ids[-1] != rep:
                ids.append(rep)
                texts.append(np.array([number.setdefault(w, len(number) + 1) for w in (text.as_py() or b"").lower().split()], np.int64))
    yield from close()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    A document's set are the distinct 5-word shingles of its whole text, A-Z lower-cased; with fewer words the whole
    sequence is one. Documents are linked where the intersection has at least 75 % of the union. component_id is the
    smallest doc_id reachable by links, and the document with it is kept.

    1. Equal sets become one representative with a pre-aggregated count, whatever their number. They are told by 128 bits of hash.
    2. Tensored banding finds candidate pairs in linear work: first-collection keys are shuffled with a sketch, and
       second-collection keys are paired with them inside the bucket. A bucket of over ``PAIRED`` rows is dealt out to its
       tables, and each row of a table is linked to one of its rows, so no collision is lost.
    3. The candidates' components, much looser than the links, are the groups in which all links are looked for by
       exact intersections of the shingles themselves. A large group is dealt out to pairs of blocks.

    Null and empty texts have no shingles, are linked with nothing and kept. A very long text is one set, worked on alone. Rows without a
    doc_id come after all others and have a null component_id where no linked document has one. Repeated rows are equal documents with
    the same verdict; a doc_id with several texts is a document for each. The smallest doc_id settles all ties. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = verdicts(keyed(docs.select(F.col("doc_id").cast("long"), "text")))
    return rows.select("doc_id", "n_shingles", own_id("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("row") == F.col("component_id")).alias("kept"))


def verdicts(keyed_docs: Keyed) -> DataFrame:
    """row (see ``keyed``), doc_id, n_shingles, component_id (a row's key where no member has an id) and chosen.

    One text of each group is chosen; only repeated rows share a verdict.
    """
    docs = keyed_docs.rows.select("row", F.col("doc_id").cast("long"), "text")
    sketches = cut(docs.select("row", "doc_id", "text").mapInArrow(_sketched, "row long, doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch binary"))
    same = ["d1", "d2", "n_shingles"]
    classes = sketches.filter("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("rep"), F.count("*").alias("n"), F.any_value(F.struct("keys", "sketch")).alias("s"))
    candidates = classes.select("rep", F.explode("s.keys").alias("key"), F.col("s.sketch").alias("sketch"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loose = components(_candidates(candidates)).join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sizes = loose.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = salted_left_join(loose, sizes, ["component"], F.col("node")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("p"), F.greatest(k, "own").alias("q")))
    placed = placed.select(F.col("node").alias("rep"), F.col("component").alias("grp"), F.inline(others))
    texts = docs.join(placed, docs.row == placed.rep).select("grp", "p", "q", "rep", "text")
    links = texts.repartition(n, "grp", "p", "q").sortWithinPartitions("grp", "p", "q", "rep").mapInArrow(_confirmed, "a long, b long")
    linked = components(links)
    several = classes.filter("n > 1").select(*same, "rep")
    rows = salted_left_join(sketches.select("row", "doc_id", *same), several, same, F.col("row")).select("row", "doc_id", "n_shingles", F.coalesce("rep", "row").alias("rep"))
    rows = salted_left_join(rows, linked.withColumnRenamed("node", "rep"), ["rep"], F.col("row"))
    rows = rows.select("row", "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("chosen", F.col("row") == F.col("component_id"))
    if keyed_docs.clash:  # keys of such ids are above all ids: the smallest id is another row's, or none that is a key
        least = rows.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        rows = salted_left_join(rows, least, ["component_id"], F.col("row")).withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    return rows


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
