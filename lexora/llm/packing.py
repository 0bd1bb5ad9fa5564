"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous steps.

Documents are tokenised and cut into pieces of up to ``capacity`` tokens. Pieces and gaps (sequences
with room left) are tables. A superstep takes a band of lengths, the longest first, and

1. range-sorts its pieces, by length, and all gaps, by room, together, longest first;
2. deals what is sorted to shares by rank: neighbours go to different shares, so every share holds the
   same mix, and no two shares want the same gap;
3. sweeps down every share: a gap that the sweep passes becomes open, and a piece takes its successor,
   the smallest open gap that holds it, which goes on with the room left; the piece that is first by
   rank chooses first, and one that finds no gap opens a sequence;
4. writes what is placed, and the gaps as they are now, for the next superstep.

A share holds about ``SHARE`` pieces and gaps, whatever the corpus; bands that fit into one share
together are one superstep. With one share the result is that of best-fit decreasing; with more, a
share can leave its last sequences open, and the next band's pieces, dealt anew, fill them. Only
counts of pieces by band reach the driver. Every step is written to the shared folder before the next
begins, so a lost executor changes nothing.

Defined cases: a null text counts as empty; an empty text is the end token alone. Rows that repeat
a doc_id, or have none, are packed on their own. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm._hashing import text_buffers
from lexora.llm.tokenizing import highest_bytes, word_bpe
from lexora.session import bound_batches, cut, forget

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Pieces and gaps of one share.
SHARE = 1 << 16
#: A band holds the lengths over capacity / divisor that no band before it holds.
DIVISORS = (2, 3, 4, 6, 8, 16, 64)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ROWS = f"gap boolean, {_PIECES}, sequence_id long, offset long"


def _tokeniser(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, step = word_bpe(path), 4 * capacity
        for batch in batches:
            raw, edges = text_buffers(batch.column(1))
            high = highest_bytes(raw, edges).tolist()
            out: list[tuple] = []
            for doc, text, top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), high, strict=True):
                ids = (bpe.encode(text, top) if text else b"") + END
                for k, i in enumerate(range(0, len(ids), step)):
                    own = ids[i:i + step]
                    out.append((doc, k, i // 4, len(own) // 4, zlib.crc32(own)))
            if not out:
                continue
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and CRC-32 of the ids of every piece of every document."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_tokeniser(path or public_tokenizers.path(VOCABULARY), capacity), _PIECES)


def sweep(values: np.ndarray, gaps: np.ndarray, ids: np.ndarray, capacity: int, first: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Sweeps down rows sorted by value: a gap's room, with its sequence in ids, or a piece's length.

    Returns the sequence and the offset of each piece (of gaps, their own), and the room of every
    sequence with room left. New sequences are numbered from ``first``.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each room that an open gap has
    sequence, offset = np.array(ids, dtype=np.int64), np.zeros(len(values), np.int64)
    for i, (value, gap, own) in enumerate(zip(values.tolist(), gaps.tolist(), ids.tolist(), strict=True)):
        if gap:
            room = value
        else:
            fits = rooms >> value
            if fits:
                held = value + (fits & -fits).bit_length() - 1
                own = open_at[held].pop()
                if not open_at[held]:
                    rooms &= ~(1 << held)
            else:
                own, held, first = first, capacity, first + 1
            sequence[i], offset[i], room = own, capacity - held, held - value
        if room:
            open_at[room].append(own)
            rooms |= 1 << room
    return sequence, offset, {own: room for room, owners in enumerate(open_at) for own in owners}


def _sweeper(capacity: int, step: int):
    """Rows come sorted by share, then as ``sweep`` wants them: (share, value, gap, pieces' columns, sequence_id)."""
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def swept(share: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gap = rows["gap"].to_numpy()
        sequence, offset, rooms = sweep(rows["value"].to_numpy(), gap, rows["sequence_id"].fill_null(0).to_numpy(), capacity, (step << 52) + (share << 32))
        piece = np.flatnonzero(~gap)
        placed = rows.select(names[1:6]).take(pa.array(piece))
        done = [pa.array(np.zeros(len(piece), bool)), *placed.columns, pa.array(sequence[piece]), pa.array(offset[piece])]
        yield from pa.Table.from_arrays(done, names).to_batches(max_chunksize=16_384)
        left = np.array(sorted(rooms.items()), dtype=np.int64).reshape(-1, 2)
        empty = lambda kind: pa.nulls(len(left), kind)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        gaps = [pa.array(np.ones(len(left), bool)), *map(empty, kinds), pa.array(left[:, 0]), pa.array(left[:, 1])]
        yield from pa.Table.from_arrays(gaps, names).to_batches(max_chunksize=16_384)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            share = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1], [True]])) if len(share) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != share[a]:
                    yield from swept(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield from swept(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))

    return run


def _supersteps(counts: dict[int, int], share: int) -> list[tuple[int, int, int]]:
    """(first band, last band, pieces) of each superstep: neighbouring bands that fit into a share together are one."""
    out: list[tuple[int, int, int]] = []
    for band in sorted(counts):
        if out and out[-1][2] + counts[band] <= share:
            out[-1] = (out[-1][0], band, out[-1][2] + counts[band])
        else:
            out.append((band, band, counts[band]))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """The pieces with sequence_id and offset. Needs doc_id, piece, start, length and ids_crc32."""
    own = [f.split()[0] for f in _PIECES.split(", ")]
    # Band 0 fills its sequences alone.
    band = reduce(lambda rest, d: F.when(F.col("length") * d[1] > capacity, d[0]).otherwise(rest), reversed(list(enumerate(DIVISORS, 1))), F.lit(len(DIVISORS) + 1))
    pieces = cut(pieces.select(*own, F.when(F.col("length") == capacity, 0).otherwise(band).alias("band")))
    counts = {r["band"]: r["n"] for r in pieces.groupBy("band").agg(F.count("*").alias("n")).collect()}
    counts.pop(0, None)
    placed = [pieces.where("band = 0").select(*own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = None
    for step, (first, last, many) in enumerate(_supersteps(counts, share), 1):
        rows = pieces.where(F.col("band").between(first, last)).select(F.col("length").alias("value"), F.lit(False).alias("gap"), *own, F.lit(None).cast("long").alias("sequence_id"))
        if gaps is not None:
            many += gaps.count()
            rows = rows.unionByName(gaps.select(F.col("offset").alias("value"), F.lit(True).alias("gap"), *own, "sequence_id"))
        shares = -(-many // share)
        order = [F.desc("value"), F.desc("gap"), F.asc("doc_id"), F.asc("piece"), F.asc("ids_crc32"), F.asc("sequence_id")]
        ranked = cut(rows.repartitionByRange(shares, *order).sortWithinPartitions(*order).withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int")))
        dealt = ranked.select("share", *rows.columns).repartition(shares, "share").sortWithinPartitions("share", *order)
        swept = cut(dealt.mapInArrow(_sweeper(capacity, step), _ROWS))
        forget(ranked)
        placed.append(swept.where("NOT gap").select(*own, "sequence_id", "offset"))
        gaps = swept.where("gap")
    return reduce(DataFrame.unionByName, placed)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents tokenised, cut and packed: a row for each piece."""
    return pack(token_pieces(docs, path, capacity), capacity)
