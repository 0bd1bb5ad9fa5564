"""Exact byte-pair encoding and decoding of whole texts by tree concatenation.

Texts up to ``spread`` characters are encoded where they lie. A longer one is cut at special tokens'
strings and then into leaves that tasks encode in parallel; the leaves' encodings meet again by document and are concatenated in a
tree, each join re-encoding a growing window until both sides agree (``ByteBpe.concatenate`` for
pieces, ``_Bpe.join`` inside one long piece). The same concatenation serves stretches without a
cut inside shorter texts. Memory is bounded by one text and its ids, and by the words remembered.

Defined cases: a null text counts as empty and has no ids; rows that repeat a doc_id, or have
none, are encoded on their own; a special token's string in a text is that token, as in the
library; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm._hashing import text_buffers
from lexora.llm.tokenizing import byte_bpe, highest_bytes
from lexora.session import bound_batches

VOCABULARY = "byte_bpe_50k.json"
SPREAD = 1 << 16
_OUT = "doc_id long, n_tokens long, ids binary, decoded string"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(column: pa.Array) -> Iterator[tuple[str, int]]:
    """Each text with its highest byte."""
    raw, edges = text_buffers(column)
    yield from zip((t or "" for t in column.to_pylist()), highest_bytes(raw, edges).tolist(), strict=True)


def _rows(ids: list, encoded: list[bytes], decode, digest: bool) -> pa.RecordBatch:
    size = pa.array([len(x) // 4 for x in encoded], pa.int64())
    texts = map(decode, encoded)
    if digest:
        hashed = [pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), size, *hashed], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), size, pa.array(encoded, pa.binary()), pa.array(list(texts), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def _encoder(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 64):
                encoded = [bpe.encode(t, high) for t, high in _texts(column.slice(i, 64))]
                yield _rows(ids[i:i + 64], encoded, bpe.decode, digest)

    return run


def _leaves(path: str, leaf: int):
    """Stretches between special tokens' strings, cut into leaves; a special token is a row of its own (``special``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for key, doc, copies, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = []
                for stretch in bpe.cut.split(text):
                    special = stretch in bpe.specials
                    parts += [(stretch, True)] if special else [(stretch[i:i + leaf], False) for i in range(0, len(stretch), leaf)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([doc] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([p for p, _ in parts], pa.string()), pa.array([x for _, x in parts])],
                    ["key", "doc_id", "copies", "part", "text", "special"],
                )

    return run


def _leaf_encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            found = [[] if special else bpe.pieces(t) for t, special in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            ranks = pa.array([np.array([r for _, own in x for r in own], dtype="<u4").tobytes() for x in found], pa.binary())
            ends = pa.array([np.array([(len(p), len(own)) for p, own in x], dtype="<u4").tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), ranks, ends], ["key", "doc_id", "copies", "part", "text", "special", "ranks", "ends"])

    return run


def _concatenator(path: str, digest: bool):
    """Rows come sorted by key and part."""

    def joined(bpe, sides: list) -> bytes:
        while len(sides) > 1:
            sides = [bpe.concatenate(sides[i], sides[i + 1]) if i + 1 < len(sides) else sides[i] for i in range(0, len(sides), 2)]
        return b"".join(bpe.packed(ranks) for _, ranks in sides[0]) if sides else b""

    def whole(bpe, leaves: list) -> bytes:
        out, sides = [], []
        for own, special, ranks, ends in leaves:
            if special:
                out += [joined(bpe, sides), bpe.specials[own].to_bytes(4, "little")]
                sides = []
                continue
            ranks, at, used, pieces = np.frombuffer(ranks, "<u4").tolist(), 0, 0, []
            for chars, n in np.frombuffer(ends, "<u4").reshape(-1, 2).tolist():
                pieces.append((own[at:at + chars], ranks[used:used + n]))
                at, used = at + chars, used + n
            sides.append(pieces)
        return b"".join([*out, joined(bpe, sides)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, group, leaves = byte_bpe(path), None, []

        def out() -> Iterator[pa.RecordBatch]:
            if leaves:
                encoded = whole(bpe, leaves)
                yield _rows([group[1]] * group[2], [encoded] * group[2], bpe.decode, digest)

        for batch in batches:
            for key, doc, copies, _, text, special, ranks, ends in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if group != (key, doc, copies):
                    yield from out()
                    group, leaves = (key, doc, copies), []
                leaves.append((text, special, ranks, ends))
        yield from out()

    return run


def encode_documents(docs: DataFrame, path: str | None = None, digest: bool = False, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of each document;
    with ``digest`` the SHA-256 of both in place of them. path: a tokenizers file of this kind."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = _DIGEST if digest else _OUT
    short = rows.where(F.length("text") <= spread).mapInArrow(_encoder(path, digest), out)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = rows.where(F.length("text") > spread).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    leaves = (
        long.select(F.sha2("text", 256).alias("key"), "doc_id", "copies", "text")
        .mapInArrow(_leaves(path, max(1, spread // 4)), "key string, doc_id long, copies long, part long, text string, special boolean")
        .repartition(parts, "key", "part")
        .mapInArrow(_leaf_encoder(path), "key string, doc_id long, copies long, part long, text string, special boolean, ranks binary, ends binary")
    )
    met = leaves.repartition(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id", "part")
    return short.unionByName(met.mapInArrow(_concatenator(path, digest), out))
