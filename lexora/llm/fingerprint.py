"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is the multiset of its passages: paragraphs, and within a paragraph stretches that end at
words chosen by their hash, so an edit changes only the passages it touches. A passage's digest
hashes its bytes and how often the same passage came before. The sketch has ``cells`` cells in
three tables; each digest is added to one cell of each table: a count, the sum of the digests and
the sum of their checks. Sketches of two versions subtract cell by cell, what they share cancels,
and peeling cells that hold a single digest recovers the digests that differ. If peeling gets
stuck, both sketches are built again four times larger; from twice as many cells as there are digests
on, where only digests that collide can be stuck, the two lists are compared instead. ``likeness`` is
one less the share of differing digests among all digests of both texts.

The fingerprint is the smallest sketch, so equal texts have equal fingerprints. Documents are dealt to
tasks in order of doc_id, by ranges of about ``BUCKET`` bytes, found on keys and lengths alone; the
first document of a range also goes to the range before it. Texts and digests stay in the worker that
reads them; the memory used is that of one batch of texts.

Defined cases: a null text counts as empty; an empty text has the empty sketch; two empty texts are
alike (1.0), an empty text and another are not (0.0). Rows that repeat a doc_id follow one another
by a hash of their texts. Rows without a doc_id have no next document: what replaces their end is empty. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm._hashing import _powers, mix, segments_of, stream, text_buffers
from lexora.session import bound_batches, cut, forget

CELLS, TABLES, GROWTH = 24, 3, 4
#: A passage ends at one word in so many, and after so many words at the latest; the first words of a
#: text are passages of their own, so short texts can be alike in part.
PASSAGE, LONGEST, SINGLE = 8, 16, 32
#: Bytes of text in a task.
BUCKET = 8 << 20

_U = np.uint64
_SEEDS = stream(51, TABLES)
_CHECK = stream(52, 2)


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passage digests of all texts one after another, and how many each text has."""
    raw, edges = text_buffers(column)
    hashes, lines, counts = segments_of(raw, edges)
    if not len(hashes):
        return hashes, counts
    after = np.cumsum(counts)
    nth = np.arange(len(hashes)) - np.repeat(after - counts, counts)
    ends = lines | (hashes % _U(PASSAGE) == 0) | (nth < SINGLE)
    ends[after[counts > 0] - 1] = True

    def laid() -> tuple[np.ndarray, np.ndarray]:
        stop = np.flatnonzero(ends)
        starts = np.concatenate([[0], stop[:-1] + 1])
        return starts, np.arange(len(hashes)) - np.repeat(starts, stop - starts + 1)

    ends |= laid()[1] % LONGEST == LONGEST - 1
    starts, place = laid()
    with np.errstate(over="ignore"):
        found = mix(np.add.reduceat(hashes * _powers(int(place.max()) + 1)[place], starts))
    row = np.repeat(np.arange(len(counts)), counts)[starts]
    order = np.lexsort((found, row))
    same = np.zeros(len(found), bool)
    same[1:] = (found[order][1:] == found[order][:-1]) & (row[order][1:] == row[order][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(found))))
    before = np.empty(len(found), np.uint64)
    before[order] = (np.arange(len(found)) - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        found = np.where(before > 0, mix(found + before * _CHECK[0]), found)
    return found, np.bincount(row, minlength=len(counts))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each table."""
    each = cells // TABLES
    return np.stack([(mix(keys ^ s) % _U(each)).astype(np.int64) + t * each for t, s in enumerate(_SEEDS)])


class Sketches:
    """``many`` sketches of ``cells`` cells each."""

    def __init__(self, many: int, cells: int):
        self.many, self.cells = many, cells
        self.count = np.zeros(many * cells, np.int64)
        self.keys = np.zeros(many * cells, np.uint64)
        self.checks = np.zeros(many * cells, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        """sign: 1 or -1 for each key."""
        check = mix(keys ^ _CHECK[1])
        plus = sign > 0
        with np.errstate(over="ignore"):
            signed, tested = np.where(plus, keys, -keys), np.where(plus, check, -check)
            for place in _places(keys, self.cells):
                at = owner * self.cells + place
                np.add.at(self.count, at, sign)
                np.add.at(self.keys, at, signed)
                np.add.at(self.checks, at, tested)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Differing digests recovered of each sketch, and whether all were. Empties the sketches."""
        found, look = np.zeros(self.many, np.int64), np.arange(len(self.count))
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look]
            with np.errstate(over="ignore"):
                keys = np.where(sign > 0, self.keys[look], -self.keys[look])
                checks = np.where(sign > 0, self.checks[look], -self.checks[look])
            pure = mix(keys ^ _CHECK[1]) == checks
            owner, keys, sign = look[pure] // self.cells, keys[pure], sign[pure]
            if not len(keys):
                break
            order = np.lexsort((keys, owner))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            one = order[fresh]
            owner, keys, sign = owner[one], keys[one], sign[one]
            self.add(owner, keys, -sign)
            found += np.bincount(owner, minlength=self.many)
            look = np.unique(_places(keys, self.cells) + owner * self.cells)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return found, ~left.reshape(self.many, self.cells).any(axis=1)

    def packed(self) -> list[str]:
        shape = (self.many, self.cells)
        parts = zip(self.count.astype("<i4").reshape(shape), self.keys.astype("<u8").reshape(shape), (self.checks >> _U(32)).astype("<u4").reshape(shape), strict=True)
        return [base64.b64encode(c.tobytes() + k.tobytes() + x.tobytes()).decode() for c, k, x in parts]


class Passages:
    """The digests of a list of texts."""

    def __init__(self, texts: list[str]):
        self.keys, self.counts = digests(pa.array(texts, pa.large_string()))
        self.ends = np.cumsum(self.counts)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in rows, digest) of the digests of some texts."""
        n = self.counts[rows]
        if not n.sum():
            return np.zeros(0, np.int64), self.keys[:0]
        at = np.repeat(self.ends[rows] - np.cumsum(n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.keys[at]

    def fingerprints(self) -> list[str]:
        sketches = Sketches(len(self.counts), CELLS)
        owner, keys = self.of(np.arange(len(self.counts)))
        sketches.add(owner, keys, np.ones(len(keys), np.int64))
        return sketches.packed()


def likeness(left: Passages, right: Passages, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike the texts a of ``left`` are to the texts b of ``right``, pair by pair."""
    total = left.counts[a] + right.counts[b]
    out = np.ones(len(a))
    todo, cells = np.flatnonzero(total > 0), CELLS
    while len(todo):
        for i in todo[cells > GROWTH * np.maximum(CELLS, 2 * total[todo])].tolist():
            (_, x), (_, y) = left.of(a[i:i + 1]), right.of(b[i:i + 1])
            out[i] = 1 - len(np.setxor1d(x, y)) / total[i]
        todo = todo[cells <= GROWTH * np.maximum(CELLS, 2 * total[todo])]
        again = [todo[:0]]
        step = max(1, (1 << 20) // cells)
        for i in range(0, len(todo), step):
            part = todo[i:i + step]
            sketches = Sketches(len(part), cells)
            for side, rows, sign in ((left, a, 1), (right, b, -1)):
                owner, keys = side.of(rows[part])
                sketches.add(owner, keys, np.full(len(keys), sign, np.int64))
            found, whole = sketches.peel()
            out[part[whole]] = 1 - found[whole] / total[part[whole]]
            again.append(part[~whole])
        todo, cells = np.concatenate(again), cells * GROWTH
    return out


def _reader(ranges: int):
    """Rows come sorted by bucket and doc_id; ``ahead`` marks copies of the next bucket's first rows. Buckets from ``ranges`` on hold rows without a doc_id."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, next text or None)."""
        texts = [r[1] for r in rows]
        after = [r[2] or "" for r in rows]
        edited = []
        for own, more in zip(texts, after, strict=True):
            q = len(own) // 4
            edited.append(own[:len(own) - q] + more[:q])
        own, new, beyond = Passages(texts), Passages(edited), Passages(after)
        every = np.arange(len(rows))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(own.fingerprints()),
                pa.array(new.fingerprints()),
                pa.array(likeness(own, new, every, every)),
                pa.array(likeness(own, beyond, every, every)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = None, [], 0
        for batch in batches:
            for bucket, ahead, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None:
                    rows.append((held[1], held[2], text if bucket == held[0] and bucket < ranges else ""))
                    size += len(held[2]) + len(text)
                    if size > 1 << 21:
                        yield emit(rows)
                        rows, size = [], 0
                held = None if ahead else (bucket, doc, text)
        if held is not None:
            rows.append((held[1], held[2], ""))
        if rows:
            yield emit(rows)

    return run


def _bounds(size: int):
    """The first (doc_id, mark) of each range: of every partition, and wherever ``size`` bytes are full. Rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, last = 0, None
        for batch in batches:
            doc, mark, length = (batch.column(i).to_numpy() for i in range(3))
            starts = []
            for i, (d, m, n) in enumerate(zip(doc.tolist(), mark.tolist(), length.tolist(), strict=True)):
                if room <= 0 and (d, m) != last:  # equal keys stay together
                    starts.append(i)
                    room = size
                room, last = room - n, (d, m)
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array(mark[starts])], ["doc_id", "mark"])

    return run


def _dealer(doc: np.ndarray, mark: np.ndarray, parts: int):
    """Adds (bucket, ahead) to (doc_id, mark, text). The first row of a range also goes, as ``ahead``, to the range before it; that of the first to the last."""
    ends = np.array(list(zip(doc.tolist(), mark.tolist(), strict=True)), dtype=[("d", "<i8"), ("m", "<i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own = np.empty(batch.num_rows, dtype=ends.dtype)
            own["d"], own["m"] = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            bucket = np.where(known, np.searchsorted(ends, own, side="right") - 1, len(ends) + own["m"] % parts)
            first = np.flatnonzero(known)[ends[bucket[known]] == own[known]]
            rows = pa.array(np.concatenate([np.arange(batch.num_rows), first]))
            places = np.concatenate([bucket, (bucket[first] - 1) % max(1, len(ends))])
            ahead = np.concatenate([np.zeros(batch.num_rows, np.int32), np.ones(len(first), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(ahead), *(c.take(rows) for c in batch.columns)], ["bucket", "ahead", "doc_id", "mark", "text"])

    return run


def fingerprint_edits(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Fingerprints of every document and of the document with its last quarter replaced by the
    start of the next document by doc_id, with the likeness to both."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    keys = rows.where("doc_id IS NOT NULL").select("doc_id", "mark", F.octet_length("text").cast("long").alias("length"))
    ordered = keys.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    # One row for every ``bucket`` bytes of text and for every partition.
    bounds = cut(ordered.mapInArrow(_bounds(bucket), "doc_id long, mark long"))
    found = sorted((r["doc_id"], r["mark"]) for r in bounds.distinct().collect())
    forget(bounds)
    doc, mark = np.array(found, dtype=np.int64).reshape(-1, 2).T
    dealt = rows.mapInArrow(_dealer(doc, mark, parts), "bucket long, ahead int, doc_id long, mark long, text string")
    order = ["bucket", "ahead", "doc_id", "mark"]
    ordered = dealt.repartitionById(len(found) + parts, F.col("bucket").cast("int")).sortWithinPartitions(*order)
    return ordered.select("bucket", "ahead", "doc_id", "text").mapInArrow(
        _reader(len(found)),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
