"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups' roots, with a proof for each row.

Only every few levels are stored, as blocks: all descendants, so many levels down, of one node. A proof's siblings in the levels
between are made again from the block below, given out and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Nodes of a run, which become one node a level up, and levels from a stored one to the next.
WIDTH, EVERY = 8, 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range partition when the session asks for fewer partitions than this gives.
PART_ROWS = 2_000_000
#: Rows that a worker gives back at once.
BATCH_ROWS = 4096


def leaf_hash(columns: list[Column]) -> Column:
    """Hex SHA-256 of the values one after the other, each as ``bytes:value`` in UTF-8, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def node_hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], first: bool, width: int, every: int) -> list[list[str]]:
    """A block's nodes and the levels made of them, up to the block's one node.

    first: the block is its tree's first. Where such a block isn't full it is all of its tree, whose levels end as soon as one node is
    left; other blocks always give ``every`` levels.
    """
    out = [nodes]
    while len(out[-1]) > 1 or (not first and len(out) <= every):
        out.append([node_hash(out[-1][k : k + width]) for k in range(0, len(out[-1]), width)])
    return out


def siblings(made: list[list[str]], k: int, width: int) -> list[tuple[str, str]]:
    """For each level below the top: the k-th node's siblings before and after it."""
    out = []
    for level in made[:-1]:
        low = k - k % width
        out.append(("".join(level[low:k]), "".join(level[k + 1 : low + width])))
        k //= width
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = sha256(f"{before}{node}{after}".encode()).hexdigest()
    return node


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``pos``, their place in their ``tree`` from 0 without gaps. order: columns, the tree first.

    Rows are sorted over range partitions, so a tree of any size is dealt to many tasks. Of each partition only the places at which
    trees begin are added up, in rows of (tree, partition).
    """
    rows = cut(rows)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS)
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    starts = rows.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(starts.select("tree", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("start")).alias("shift")))
    return rows.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks(nodes: DataFrame, width: int, every: int) -> DataFrame:
    """(tree, block, nodes): the nodes of each block in order, stored. A block has ``width ** every`` nodes at most."""
    own = F.struct("pos", *(c for c in nodes.columns if c not in ("tree", "pos")))
    return cut(nodes.groupBy("tree", F.floor(F.col("pos") / width**every).alias("block")).agg(F.array_sort(F.collect_list(own)).alias("nodes")))


def forest(nodes: DataFrame, width: int = WIDTH, every: int = EVERY) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees, each as blocks, and the roots (tree, pos, node). nodes: (tree, pos, node, ..), pos from ``numbered``.

    A pass makes ``every`` levels, so there are as many passes as the largest tree needs; smaller ones go through with their root.
    """

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [levels([x["node"] for x in nodes.as_py()], not block.as_py(), width, every)[-1][0] for block, nodes in zip(batch["block"], batch["nodes"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["block"], pa.array(found, pa.string())], ["tree", "pos", "node"])

    stored = []
    while True:
        stored.append(blocks(nodes, width, every))
        nodes = cut(stored[-1].mapInArrow(tops, "tree string, pos long, node string"))
        if nodes.filter("pos > 0").isEmpty():
            return stored, nodes


def _parts(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def paths(stored: list[DataFrame], roots: DataFrame, width: int = WIDTH, every: int = EVERY) -> DataFrame:
    """Blocks of the lowest stored level with ``path``, the siblings from their own node up, and ``subroot``. roots: (tree, pos, path, subroot)."""

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, block, nodes, path, subroot in zip(*(batch[c] for c in ("tree", "block", "nodes", "path", "subroot")), strict=True):
                nodes, above = nodes.as_py(), [(x["before"], x["after"]) for x in path.as_py()]
                made = levels([x["node"] for x in nodes], not block.as_py(), width, every)
                for k, x in enumerate(nodes):
                    rows.append((tree.as_py(), x["pos"], siblings(made, k, width) + above, subroot.as_py()))
                if len(rows) >= BATCH_ROWS:
                    yield _parts(rows, ["tree", "pos", "path", "subroot"], [pa.string(), pa.int64(), PATH, pa.string()])
                    rows = []
            yield _parts(rows, ["tree", "pos", "path", "subroot"], [pa.string(), pa.int64(), PATH, pa.string()])

    for level in reversed(stored):
        joined = level.join(roots.withColumnRenamed("pos", "block"), ["tree", "block"])
        if level is stored[0]:
            return joined
        roots = joined.mapInArrow(below, "tree string, pos long, path array<struct<before string, after string>>, subroot string")


def merkle_manifest(docs: DataFrame, altered: Column | None = None, columns: tuple[str, ...] = LEAF_COLUMNS, group: str = "lang", width: int = WIDTH, every: int = EVERY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    A leaf is the hash of the row's ``columns`` (see ``leaf_hash``). Leaves of a group ascend by doc_id, and every ``width`` consecutive
    nodes become one while several are left; the groups' roots, in order of the group's bytes with null first, likewise become ``root``.
    proof_sha256 is the hash of a row's siblings from its leaf up. ``altered`` is the text as found at checking: folded_root is made of
    the leaf with it, and the siblings as they were, so ``verified`` tells whether the row is still what was listed.

    ``every`` levels lie between stored ones. Blocks have ``width ** every`` nodes at most and each row gives one small output row, so
    neither a large group nor a large table meets in one task.

    Nulls in any column have their own mark, so a null is not an empty text. Rows without doc_id come first; equal doc_ids go by the leaf's
    hash, so repeated rows are neighbours with leaves of their own. A very long text is hashed whole. An empty table gives no rows; other
    columns are ignored and may have any name.
    """

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, nodes, path, subroot in zip(*(batch[c] for c in ("block", "nodes", "path", "subroot")), strict=True):
                nodes, subroot, above = nodes.as_py(), subroot.as_py(), [(x["before"], x["after"]) for x in path.as_py()]
                made = levels([x["node"] for x in nodes], not block.as_py(), width, every)
                upper = "".join(x + y for x, y in above)
                for k, x in enumerate(nodes):
                    own = siblings(made, k, width)
                    proof = sha256(("".join(a + b for a, b in own) + upper).encode()).hexdigest()
                    rows.append((x["doc_id"], x["node"], subroot, proof, fold(fold(x["altered"] or x["node"], own), above)))
                if len(rows) >= BATCH_ROWS:
                    yield _parts(rows, names, kinds)
                    rows = []
            yield _parts(rows, names, kinds)

    names, kinds = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"], [pa.int64(), *[pa.string()] * 4]
    values = lambda text: [F.col(c) if c != "text" else text for c in columns]
    new = F.col("text") if altered is None else altered
    # Null trees come first, as no other key is empty
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    changed = F.when(~F.col("text").eqNullSafe(new), leaf_hash(values(new)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_hash(values(F.col("text"))).alias("node"), changed.alias("altered"))
    stored, subroots = forest(numbered(rows, ["tree", "doc_id", "node", "altered"]), width, every)

    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")
    top, root = forest(numbered(groups, ["tree", "group"]), width, every)
    whole = root.first()
    whole = whole["node"] if whole else None
    ends = paths(top, root.select("tree", "pos", F.array().cast("array<struct<before string, after string>>").alias("path"), F.col("node").alias("subroot")), width, every)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, nodes, path in zip(*(batch[c] for c in ("block", "nodes", "path")), strict=True):
                nodes, above = nodes.as_py(), [(x["before"], x["after"]) for x in path.as_py()]
                made = levels([x["node"] for x in nodes], not block.as_py(), width, every)
                rows += [(x["group"], 0, siblings(made, k, width) + above, x["node"]) for k, x in enumerate(nodes)]
            yield _parts(rows, ["tree", "pos", "path", "subroot"], [pa.string(), pa.int64(), PATH, pa.string()])

    ends = cut(ends.mapInArrow(tops, "tree string, pos long, path array<struct<before string, after string>>, subroot string"))
    out = paths(stored, ends, width, every).mapInArrow(proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(whole).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(whole)).alias("verified"))


#: Letters that the query's tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, of which every third by the CRC-32 of its id has had its capitals lower-cased since."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
