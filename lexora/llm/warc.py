"""WARC archives of Zstandard frames that share a dictionary, written, deduplicated and read back.

A Zstandard dictionary is trained on a bounded sample of the records to be archived, smaller for small
tables; where there is too little to train on, records themselves are its content. Every archive
begins with a skippable frame that holds the dictionary; after it, each record is a frame of its own,
so any record can be read alone and none is larger in memory than itself. Archives go to the folder
that the cluster shares, under names of their own for each attempt of a task; only names that
finished attempts report are ever read, so a lost executor leaves at most a file without readers.

Records with equal payloads of at least ``least`` bytes are one response, that of the smallest
page_id, and revisits that refer to it. Which pages are revisits is found on (page_id, digest) rows
alone, combined before the shuffle; a payload that a third of the pages share is no hot spot.

Defined cases: a null html counts as an empty payload; a null url as an empty target. Line ends and
control characters of a url are percent-encoded. A row without a page_id is a response and is no
one's original. Rows that repeat a page_id and its payload are all responses if that page is the
original, else all revisits. An empty table gives no archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.session import bound_batches, cut, shared_dir

#: Fixed value: the magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 65_536
LEVEL, FILE_BYTES = 3, 256 << 20
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_MANIFEST = "file string, records long, bytes long"
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SUMMARY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root) if root.startswith("file:") else root)


def _record_id(page: int | None, sha: bytes) -> str:
    if page is None:  # no other record refers to it
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.UUID(bytes=sha[:8] + struct.pack('>Q', page & 0xFFFF_FFFF_FFFF_FFFF))}>"


def _page_of(record: str) -> int:
    return struct.unpack(">q", uuid.UUID(record.strip("<>").rpartition(":")[2]).bytes[8:])[0]


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit if refers_to is given."""
    sha = hashlib.sha1(payload, usedforsecurity=False).digest()
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page, sha)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, sha)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(root: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(root)
        store.create_dir(folder, recursive=True)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        out, name, records, size = None, "", 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                frame = press.compress(record(page, url, (html or "").encode(), refers))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= FILE_BYTES:
                    yield from close()
                    out = None
        yield from close()

    return run


def train_dictionary(pages: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most 2 * ``rows`` records, with the starts of their payloads; empty only if there is no record.

    Where the records are too few or too alike to train on, their own last bytes are the dictionary.
    """
    ranked = pages.withColumn("_rank", F.xxhash64("page_id", "html"))
    # The ranks alone are sorted; the texts of the few rows below the cut follow.
    last = ranked.select("_rank").orderBy("_rank").limit(rows).agg(F.max("_rank").alias("last")).first()["last"]
    if last is None:
        return b""
    start = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")
    sample = ranked.where(F.col("_rank") <= last).select("page_id", "url", start).limit(2 * rows).collect()
    records = sorted(record(r["page_id"], r["url"], r["html"].encode(), None) for r in sample)
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, records)) // 4)), records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def write_archives(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Write all pages under ``root``; returns a row (file, records, bytes) for each archive."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    payload = F.encode("html", "utf-8")
    keyed = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha2(payload, 256).alias("digest"))
    keyed = cut(keyed)
    originals = keyed.groupBy("digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last")).where("original < last")
    revisits = keyed.join(originals.select("digest", "original"), "digest").where("page_id != original")
    own = F.sha2(payload, 256)
    revisits = cut(revisits.select(F.col("page_id").alias("again"), F.col("digest").alias("seen"), "original").distinct())
    joined = rows
    if revisits.limit(1).count():
        joined = rows.join(revisits, (F.col("page_id") == F.col("again")) & (own == F.col("seen")), "left")
    else:
        joined = rows.withColumn("original", F.lit(None).cast("long"))
    return cut(joined.select("page_id", "url", "html", "original").mapInArrow(_writer(root, train_dictionary(pages)), _MANIFEST))


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = stream.read(length)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    with press.stream_reader(stream, read_across_frames=True) as plain:
        lines = io.BufferedReader(plain)
        while line := lines.readline():
            if not line.strip():
                continue
            headers = {}
            while line := lines.readline().strip():
                key, _, value = line.decode().partition(":")
                headers[key.lower()] = value.strip()
            yield headers, lines.read(int(headers["content-length"]))


def _reader(root: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(root)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        if whole:
            names[1:1], kinds[1:1] = ["url", "payload"], [pa.string(), pa.binary()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(posixpath.join(folder, name), compression=None) as raw:
                    for headers, block in read_records(raw):
                        kind = headers["warc-type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["warc-payload-digest"].rpartition(":")[2]
                        size = int(headers["x-payload-length"])
                        if payload is not None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page = int(headers["x-page-id"]) if "x-page-id" in headers else None
                        refers = _page_of(headers["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page, headers["warc-target-uri"], payload, size, digest, kind, refers) if whole else (page, size, digest, kind, refers))
                        held += len(block) if whole else 64
                        if len(rows) >= 4096 or held >= 1 << 22:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return run


def read_archives(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives named; every response's payload is checked against its digest."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(parts).mapInArrow(_reader(root, payloads), _READ if payloads else _SUMMARY)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back, without the payloads."""
    root = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, root, least), root, payloads=False)
