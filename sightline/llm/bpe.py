"""Byte-level BPE over a global shuffle of distinct words: pre-tokens are encoded once each and joined back by position."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .kernels import ragged

#: Bytes of text whose distinct words are asked for together, and blocks of a task that puts documents together.
BLOCK_BYTES, TASK_BLOCKS = 24 << 20, 4
#: Words that a task remembers the ids of; beyond, it forgets them and encodes anew.
KNOWN_WORDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank in each line. A fixed vocabulary, not data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pack(values: np.ndarray) -> bytes:
    """Small integers, byte plane by byte plane, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _blocks(pattern: str, parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of documents: ids, each document's words by their number, and the distinct words to ask for.

        Words are numbered by frequency. Those of one part of the hash range are asked for together, sorted and compressed; ``turn``
        leads from the order of asking to the numbers.
        """
        import regex

        split, task, serial = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            number: dict[str, int] = {}
            order, counts, ids = array("I"), [], []
            for doc, text in held:
                found = split(text or "")
                ids.append(doc)
                counts.append(len(found))
                order.extend([number.setdefault(w, len(number)) for w in found])
            places = np.frombuffer(order, np.uint32)
            rank = np.empty(len(number), np.int64)
            rank[np.argsort(-np.bincount(places, minlength=len(number)), kind="stable")] = np.arange(len(number))
            words = [w.encode() for w in number]
            asked = sorted((crc32(w) % parts, w, k) for k, w in enumerate(words))
            bounds = np.searchsorted([a[0] for a in asked], np.arange(parts + 1))
            questions = [{"part": int(p), "words": _pack_words([a[1] for a in asked[bounds[p] : bounds[p + 1]]])} for p in np.flatnonzero(np.diff(bounds))]
            # the block's name holds the content, so a block that was recomputed otherwise can't take another's answers
            name = hashlib.blake2b(repr((task, serial, ids[:1], len(order))).encode(), digest_size=8)
            for q in questions:
                name.update(q["words"])
            columns = [[int.from_bytes(name.digest(), "little", signed=True)], [ids], [counts], [_pack(rank[places])], [_pack(rank[[a[2] for a in asked]])], [questions]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _BLOCK, strict=True)], ["block", "ids", "counts", "places", "turn", "questions"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((doc, text))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return cut


_BLOCK = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())]))]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, part, words) of each block's questions. Not explode(), for which Spark would prune columns and shuffle the blocks twice."""
    for batch in batches:
        for block, questions in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(questions), pa.int64()), pa.array([q["part"] for q in questions], pa.int32()), pa.array([q["words"] for q in questions], pa.binary())], ["block", "part", "words"])


def _pack_words(words: list[bytes]) -> bytes:
    lengths = _pack(np.array([len(w) for w in words], np.int64))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 6)


def _unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    joined, edge = zstandard.decompress(data[4 + n :]), np.cumsum(np.r_[0, _unpack(data[4 : 4 + n])]).tolist()
    return [joined[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _encoded(ranks_path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers for one part of the hash range, where all questions for a word meet: each distinct word is encoded once."""
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        part, known = None, {}
        for batch in batches:
            for block, here, words in zip(*(batch.column(k).to_pylist() for k in ("block", "part", "words")), strict=True):
                if here != part:  # rows come sorted by part
                    part, known = here, {}
                if len(known) > KNOWN_WORDS:
                    known = {}
                answers = []
                for word in _unpack_words(words):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = coder._encode_single_piece(word)
                    answers.append(ids)
                sizes, tokens = _pack(np.array([len(a) for a in answers], np.int64)), _pack(np.array([k for a in answers for k in a], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([here], pa.int32()), pa.array([sizes]), pa.array([tokens])], ["asker", "part", "sizes", "tokens"])

    return encode


def _reassembled(ranks_path: str):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ids by position, and the bytes they decode to by the table of token bytes."""
        ranks = read_ranks(ranks_path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            for ids, counts, places, turn, answers in zip(*(batch.column(k).to_pylist() for k in ("ids", "counts", "places", "turn", "answers")), strict=True):
                answers = sorted(answers or [], key=lambda a: a["part"])
                sizes, tokens = (np.concatenate([np.zeros(0, np.int64), *(_unpack(a[k]) for a in answers)]) for k in ("sizes", "tokens"))
                turn, places, at = _unpack(turn), _unpack(places), 0
                start, size = np.zeros(len(turn), np.int64), np.zeros(len(turn), np.int64)
                start[turn], size[turn] = np.cumsum(sizes) - sizes, sizes
                rows: list[tuple] = []
                for doc, count in zip(ids, counts, strict=True):
                    here = places[at : at + count]
                    at += count
                    own = tokens[ragged(start[here], size[here])]
                    rows.append((doc, own.astype(np.int32), b"".join([table[k] for k in own.tolist()])))
                    if len(rows) == 200:
                        yield _documents(rows)
                        rows = []
                yield _documents(rows)

    return join


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    doc, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of every document's whole text.

    Pre-tokens are cut by the pattern and numbered in blocks of some megabytes of text. Each block asks for each of its
    distinct words once; the words are shuffled so that all blocks' questions for a word meet, each distinct word is encoded
    once there, and its ids go back to the blocks, which put them together by position. No word can be asked for more often
    than there are blocks, so a frequent word is no hot key. Positions stay with the block as packed numbers, as a row for each of
    them would be several times the text. Decoding joins ids with the table of token bytes, which is as large as the vocabulary.

    Null text is empty and has no ids. A very long text is cut and put together as a whole. doc_id is only handed on: null and repeated
    ones, and repeated rows, give a row each. No order of rows matters, so there are no ties. An empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(n, blocks // TASK_BLOCKS)  # tasks that put documents together grow in number with the input
    kinds = "block long, ids array<long>, counts array<int>, places binary, turn binary, questions array<struct<part: int, words: binary>>"
    blocks = rows.mapInArrow(_blocks(pattern, n), kinds).repartition(most, "block")
    asked = blocks.mapInArrow(_asked, "block long, part int, words binary").repartition(n, "part").sortWithinPartitions("part")
    answers = asked.mapInArrow(_encoded(ranks_path, pattern), "asker long, part int, sizes binary, tokens binary")
    answers = answers.groupBy("asker").agg(F.collect_list(F.struct("part", "sizes", "tokens")).alias("answers"))  # one for each part at most
    both = blocks.join(answers, F.col("block") == F.col("asker"), "left")  # with all columns, so that the blocks' shuffle is read again
    return both.mapInArrow(_reassembled(ranks_path), "doc_id long, ids array<int>, decoded binary")


def digest_encoding(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids joined by a space and of the decoded bytes."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_encoding(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
