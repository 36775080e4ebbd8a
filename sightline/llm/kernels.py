"""Small numpy helpers that run inside tasks: words of an Arrow batch and hashes of their windows."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is worked on alone.
SLICE = 2 << 20
MASK = (1 << 64) - 1


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, end to end, and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in pieces of about ``limit`` bytes of text: (piece, bytes, offsets)."""
    raw, at = column_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in a row; their order matters."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def in_a_row(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` hashes in a row: a tree of pairs, so that no pattern of the sequence can cancel out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size = None, 0, 1
    while size <= width:
        if width & size:
            part = hashes[at : at + n]
            out, at = part if out is None else paired(out, part), at + size
        size *= 2
        if size <= width:
            hashes = paired(hashes[: -(size // 2)], hashes[size // 2 :])
    return out


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word ``[^\\x20\\x09-\\x0D]+``, and the n + 1 offsets of each row's words.

    They are halves of a BLAKE2 digest, which is worked out once for each distinct word of the batch.
    """
    number: dict[bytes, int] = {}
    order, counts = array("I"), []
    for text in texts.cast(pa.large_binary()).to_pylist():
        own = (text or b"").lower().split() if lower else (text or b"").split()  # bytes know ASCII only
        counts.append(len(own))
        order.extend([number.setdefault(w, len(number)) for w in own])
    digests = np.frombuffer(b"".join([blake2b(w, digest_size=16).digest() for w in number]), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(digests[np.frombuffer(order, np.uint32)].T), np.r_[0, np.cumsum(counts, dtype=np.int64)]


def byte_grams(raw: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the 32 bytes from each byte on."""
    if len(raw) < 32:
        return np.zeros(0, np.uint64)
    eight = raw.astype(np.uint64)
    for width in (1, 2, 4):
        eight = eight[:-width] | eight[width:] << np.uint64(8 * width)
    eight = mix(eight ^ np.uint64(0xA0761D6478BD642F * (2 * seed + 1) & MASK))
    sixteen = paired(eight[:-8], eight[8:])
    return paired(sixteen[:-16], sixteen[16:])


def byte_spans(grams: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the ``lengths`` bytes, 32 or more, from each start: their length and all grams that lie end to end in them, the last one at the end."""
    out = mix(lengths.astype(np.uint64))
    for k in range(0, int(lengths.max(initial=0)) - 31, 32):
        here = np.flatnonzero(lengths >= k + 32)
        out[here] = paired(out[here], grams[starts[here] + k])
    return paired(out, grams[starts + lengths - 32])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each item, from the n + 1 offsets of the rows."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def runs(positions: np.ndarray, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of 0..total that windows of ``width`` at the positions cover: starts and ends."""
    edge = np.zeros(total + 1, np.int64)
    positions = np.unique(positions)
    np.add.at(edge, positions, 1)
    np.add.at(edge, np.minimum(positions + width, total), -1)
    covered = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0]
    step = np.diff(covered)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
