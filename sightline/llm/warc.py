"""WARC archives with a Zstandard dictionary in a leading skippable frame, and each record in a frame of its own."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_left_join, shared_folder, table

#: Payloads of this many bytes or more are archived once and revisited.
REVISIT_BYTES = 100
#: The dictionary: its size, and the records of its archive that it is built from, a bounded sample from all over the buffer.
DICTIONARY_BYTES, DICTIONARY_RECORDS, BUFFER_BYTES = 64 << 10, 400, 8 << 20
#: Fixed values of the formats: the skippable frame that holds a dictionary, and one that holds nothing. Spark's text writer ends each
#: row with the latter, so the files are sound Zstandard streams.
DICTIONARY_MAGIC, EMPTY_FRAME = b"\x5d\x2a\x4d\x18", "\x50\x2a\x4d\x18\x00\x00\x00\x00"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to: the response that a page with an equal payload revisits, else null.

    Only digests are grouped. Payloads are shuffled once at most, by page_id and digest. Pages with repeated page_ids are written each; of
    those with equal payloads too none revisits another, and all refer to the same response of a smaller page_id. A page without a
    page_id is a response. Null html is an empty payload; a very long one is one record. Other columns are ignored, whatever their names.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("html"))
    hashed = rows.select("page_id", F.octet_length("html").alias("size"), F.unhex(F.sha2("html", 256)).alias("digest")).filter(F.col("size") >= REVISIT_BYTES)
    several = hashed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = salted_left_join(hashed.drop("size"), several, ["digest"], F.col("page_id")).filter(F.col("first") < F.col("page_id"))
    later = later.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    told = rows.withColumn("digest", F.unhex(F.sha2("html", 256))).join(later, ["page_id", "digest"], "left")
    return told.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), "refers_to")


def record(page_id: int, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    payload = html.encode()
    block = b"" if refers_to is not None else payload
    # a line of a header can't hold other characters than visible ones
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    sample = records[:: max(1, len(records) // DICTIONARY_RECORDS)]
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 8)
        return zstandard.train_dictionary(size, sample) if len(sample) >= 8 and size >= 1024 else None
    except zstandard.ZstdError:  # too little to learn from: plain frames are as sound
        return None


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of one archive in order, as rows: first the dictionary, then each record."""
    coder, buffer, size = None, [], 0

    def begin() -> Iterator[pa.RecordBatch]:
        nonlocal coder
        learnt = _dictionary(buffer)
        coder = zstandard.ZstdCompressor(level=6, dict_data=learnt, write_checksum=True)
        data = learnt.as_bytes() if learnt else b""
        frames = [DICTIONARY_MAGIC + struct.pack("<I", len(data)) + data] if data else []
        yield pa.RecordBatch.from_arrays([pa.array(frames + [coder.compress(x) for x in buffer], pa.binary())], ["frame"])
        buffer.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buffer.append(record(*row))
            size += len(buffer[-1])
            if size >= BUFFER_BYTES if coder is None else len(buffer) >= 500:
                if coder is None:
                    yield from begin()
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([coder.compress(x) for x in buffer], pa.binary())], ["frame"])
                    buffer.clear()
    if coder is None and buffer:
        yield from begin()
    elif buffer:
        yield pa.RecordBatch.from_arrays([pa.array([coder.compress(x) for x in buffer], pa.binary())], ["frame"])


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record for each page to archives in a new folder of any file system, one for each of Spark's partitions.

    Spark writes the files, so a lost executor's archives are written again. An archive holds a partition of the plan, which Spark
    coalesces by compressed bytes and never splits: its size has no bound of its own. Each starts with a dictionary that is built from a bounded sample of its own first records.
    """
    frames = plan_records(pages).mapInArrow(_written, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(folder)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    view, at, learnt = memoryview(data), 0, None
    while at < len(data):
        magic, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if 0x184D2A50 <= struct.unpack("<I", magic)[0] <= 0x184D2A5F:
            if magic == DICTIONARY_MAGIC:
                learnt = zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(dict_data=learnt).decompressobj()
        parts, step = [], 1 << 16
        while not reader.eof:
            chunk = view[at : at + step]
            parts.append(reader.decompress(chunk))
            at += len(chunk)
        at -= len(reader.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            rows = []
            for headers, block in read_records(archive.as_py()):
                own, other = (int(x[10:-1]) if (x := headers.get(k, "")) and x != "<urn:page:None>" else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                kind = headers["WARC-Type"]
                size, digest = (len(block), hashlib.sha256(block).hexdigest()) if kind == "response" else (int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"][7:])
                rows.append((own, size, digest, kind, other))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in the archives of a folder.

    A response's size and digest are worked out from its block, a revisit's are those in its headers.
    """
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read them back. A page without a page_id has a record without one. Null html is an empty payload; an empty table gives no record."""
    folder = shared_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


OP7_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
