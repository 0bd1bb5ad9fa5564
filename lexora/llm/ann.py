"""Approximate nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a string of ``BITS`` sign bits of random projections; a tree is the
sorted array of its strings. The arrays are one table, partitioned by tree and leading bits into
cells of about ``CELL`` strings (a crowded cell is dealt into several), so a query visits only the
cells that its prefixes name. A query first descends in every tree to where its string would stand,
and takes the longest prefix length at which ``WANT`` strings of all trees together match its own.
Entries that share a prefix of that length with it in some tree are its candidates; each is compared
by exact distance, where the vectors lie. Then it ascends in all trees at once: two vectors at an
angle a share x leading bits of a tree with probability (1 - a / pi) ** x, so the angle to the k-th
best found tells the length at which a neighbour as far as that is met in some tree with probability
``REACH``. As better ones only narrow that angle, one ascent to that length is enough; a query that
has fewer than ``k`` entries ascends further, to no prefix at all in the end.

Each query has lengths of its own: among clustered vectors it stays deep, among random ones, whose
neighbours are hardly nearer than the rest, it has to meet a large share of them. Equal vectors are
one entry that lists its smallest vec_ids, as many as a result can name, so a vector that a third of
the rows share is one entry. Entries are numbered along the first tree and lie in blocks of
``BLOCK`` neighbours; a task holds one block's vectors, and queries with their candidates stream past
it, so nothing is copied and only blocks with candidates are visited. Every row is indexed and no
candidate is dropped; vectors of different lengths live in trees of their own.

Only the projections' centres are fitted, on at most ``SAMPLE`` rows.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no
part, as query or as candidate, nor do rows without a vec_id. A vector's candidates are those of its
own length. A query's own row is no candidate, nor are other rows with its vec_id; of a vec_id's
several vectors the smallest is the query. With fewer than ``k`` candidates all are returned. Ties go
to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.session import bound_batches, cut, forget

BITS, TREES, K = 64, 64, 10
REACH, WANT, SAMPLE = 0.95, 160, 2000
CELL, BLOCK = 1 << 16, 8192

_TOP = np.uint64(1 << 63)
_KEYS = ["tree", "cell", "salt"]


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))


def _lists(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy()
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


class Hasher:
    """Strings of vectors as signed integers that sort as the strings do."""

    def __init__(self, centres: dict[int, list[float]], trees: int, seed: int):
        self.centres, self.trees, self.seed, self.planes = centres, trees, seed, {}

    def centre(self, width: int) -> np.ndarray:
        return np.array(self.centres.get(width, [0.0] * width))

    def strings(self, matrix: np.ndarray) -> np.ndarray:
        width = matrix.shape[1]
        if width not in self.planes:
            self.planes = {width: np.random.default_rng([self.seed, width]).standard_normal((width, self.trees * BITS))}
        out = np.empty((len(matrix), self.trees), np.int64)
        for i in range(0, len(matrix), 256):
            bits = (matrix[i:i + 256] - self.centre(width)) @ self.planes[width] > 0
            packed = np.packbits(bits.reshape(-1, self.trees, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)
            out[i:i + 256] = (packed ^ _TOP).view(np.int64)
        return out


def _coder(hasher: Hasher):
    """Adds the strings to (ids, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _lists(batch.column(1)) if batch.num_rows else []
            width = np.array([len(v) for v in vectors], dtype=np.int32)
            codes = np.zeros((len(vectors), hasher.trees), np.int64)
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                codes[own] = hasher.strings(np.stack([vectors[i] for i in own]))
            edges = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * hasher.trees)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width), pa.ListArray.from_arrays(edges, pa.array(codes.reshape(-1)))], ["ids", "v", "width", "codes"])

    return run


def _prefix_ends(codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last string that share ``level`` leading bits with each."""
    rest = np.where(level == 0, ~np.uint64(0), (np.uint64(1) << (BITS - np.maximum(level, 1)).astype(np.uint64)) - np.uint64(1))
    plain = codes.view(np.uint64) ^ _TOP
    return ((plain & ~rest) ^ _TOP).view(np.int64), ((plain | rest) ^ _TOP).view(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    """The stretches of a batch that lie in one cell; its first columns are the cell's key."""
    keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
    edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]])) if batch.num_rows else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(keys[:, a].tolist()), int(a), int(b)


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of rows sorted by (cell's key, code, entry): its sorted arrays."""

    def row(key: tuple[int, int, int], held: list) -> pa.RecordBatch:
        arrays = [np.concatenate([x[k] for x in held]).astype("<i8").tobytes() for k in range(2)]
        return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, (pa.int64(), pa.int64(), pa.int32()), strict=True)), *(pa.array([x], pa.binary()) for x in arrays)], [*_KEYS, "codes", "entries"])

    here, held = None, []
    for batch in batches:
        code, entry = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        for key, a, b in _runs(batch):
            if key != here:
                if held:
                    yield row(here, held)
                here, held = key, []
            held.append((code[a:b], entry[a:b]))
    if held:
        yield row(here, held)


def _walker(counting: bool):
    """Cells of rows (cell's key, codes, entries, code, query_id, level), the cell's arrays first, then who asks.

    Counting, gives (query_id, counts): matches at every length; else (query_id, block, places).
    """

    def answer(codes: np.ndarray, entries: np.ndarray, asked: np.ndarray, queries: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
        if counting:
            counts = np.empty((len(asked), BITS + 1), np.int64)
            for x in range(BITS + 1):
                low, high = _prefix_ends(asked, np.full(len(asked), x))
                counts[:, x] = np.searchsorted(codes, high, side="right") - np.searchsorted(codes, low, side="left")
            edges = pa.array(np.arange(len(asked) + 1, dtype=np.int32) * (BITS + 1))
            return pa.RecordBatch.from_arrays([pa.array(queries), pa.ListArray.from_arrays(edges, pa.array(counts.reshape(-1)))], ["query_id", "counts"])
        low, high = _prefix_ends(asked, level)
        owner, block, places = [], [], []
        for query, a, b in zip(queries.tolist(), np.searchsorted(codes, low, side="left").tolist(), np.searchsorted(codes, high, side="right").tolist(), strict=True):
            met = np.sort(entries[a:b])
            home, place = met // BLOCK, (met % BLOCK).astype("<i4")
            edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(met) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                owner.append(query)
                block.append(int(home[i]))
                places.append(place[i:j].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(block, pa.int64()), pa.array(places, pa.binary())], ["query_id", "block", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = codes = entries = None
        for batch in batches:
            for key, a, b in _runs(batch):
                if key != here:
                    here = key
                    codes, entries = (np.frombuffer(batch.column(i)[a].as_py(), "<i8") for i in (3, 4))
                    a += 1
                for i in range(a, b, 512):
                    part = batch.slice(i, min(b, i + 512) - i)
                    yield answer(codes, entries, *(part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (5, 6, 7)))

    return run


def _comparer(hasher: Hasher, k: int):
    """Blocks of rows (block, asking, query_id or place, part, ids, v, places), sorted by these: the block's entries, then
    for each query its vector and its candidates. Gives the best ``k`` of each query in the block."""
    names = ["query_id", "vec_id", "score", "cosine"]

    def best(query: int, asked: np.ndarray, rows: np.ndarray, matrix: np.ndarray, home: np.ndarray, ids: list) -> list[tuple[int, int, float, float]]:
        met = matrix[home[rows]]
        far = np.sqrt(np.square(met - asked).sum(axis=1))
        if len(far) > k + 1:  # one more than k, as the query's own entry may be among them; ties stay
            near = np.flatnonzero(far <= np.partition(far, k)[k])
            rows, far, met = rows[near], far[near], met[near]
        a, b = asked - hasher.centre(len(asked)), met - hasher.centre(len(asked))
        size = np.linalg.norm(a) * np.linalg.norm(b, axis=1)
        cosine = np.divide(b @ a, size, out=np.zeros(len(far)), where=size > 0)
        found = sorted((float(d), int(i), float(c)) for d, j, c in zip(far, rows, cosine, strict=True) for i in ids[j] if i != query)
        return [(query, i, d, c) for d, i, c in found[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = query = asked = None
        vectors, ids, tables, marks, out = [], [], {}, [], []

        def flush() -> None:
            if query is None or not marks:
                return
            if not tables:
                width = np.array([len(v) for v in vectors])
                for w in np.unique(width).tolist():
                    own = np.flatnonzero(width == w)
                    home = np.zeros(len(width), np.int64)
                    home[own] = np.arange(len(own))
                    tables[w] = (np.stack([vectors[i] for i in own]), home)
            rows = np.unique(np.concatenate(marks))
            out.extend(best(query, asked, rows, *tables[len(asked)], ids))

        for batch in batches:
            block, asking, number, part = (batch.column(i).to_pylist() for i in range(4))
            own, vector, places = batch.column(4).to_pylist(), _lists(batch.column(5)) if batch.num_rows else [], batch.column(6).to_pylist()
            for i in range(len(block)):
                if block[i] != here or (asking[i] and number[i] != query):
                    flush()
                    query, marks = None, []
                if block[i] != here:
                    here, vectors, ids, tables = block[i], [], [], {}
                if not asking[i]:
                    vectors.append(vector[i])
                    ids.append(own[i])
                elif part[i] == 0:
                    query, asked = number[i], vector[i]
                else:
                    marks.append(np.frombuffer(places[i], "<i4"))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)

    return run


class Forest:
    """The trees' strings in cells, each a row of sorted arrays, and the entries in blocks."""

    def __init__(self, entries: DataFrame, hasher: Hasher, cell: int):
        """entries: e, ids, v, width, codes."""
        self.hasher, self.entries = hasher, entries
        self.parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.bits = max(0, math.ceil(math.log2(max(1, entries.count() / cell))))
        rows = self.in_trees(entries.select("codes", "width", "e")).withColumn("cell", self.cell_of("code"))
        sizes = rows.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("salts"))
        rows = rows.join(sizes, ["tree", "cell"]).select("tree", "cell", F.pmod(F.xxhash64("e"), "salts").cast("int").alias("salt"), "code", "e")
        dealt = rows.repartition(self.parts, *_KEYS).sortWithinPartitions(*_KEYS, "code", "e")
        self.cells = cut(dealt.mapInArrow(_packer, "tree long, cell long, salt int, codes binary, entries binary"))

    @staticmethod
    def in_trees(rows: DataFrame) -> DataFrame:
        """A row for each tree; a tree's number holds the vectors' length."""
        rest = [c for c in rows.columns if c not in ("codes", "width")]
        return rows.select((F.col("width").cast("long") * 65536).alias("base"), *rest, F.posexplode("codes").alias("t", "code")).select((F.col("base") + F.col("t")).alias("tree"), "code", *rest)

    def cell_of(self, code: str) -> Column:
        return F.shiftright(code, BITS - self.bits) if self.bits else F.lit(0).cast("long")

    def walk(self, queries: DataFrame, counting: bool) -> DataFrame:
        """queries: query_id, codes, width, level."""
        asked = self.in_trees(queries.select("codes", "width", "query_id", "level"))
        cells = F.array(self.cell_of("code"))
        if self.bits and not counting:
            span = F.expr(f"shiftleft(1L, {self.bits} - level)")
            prefix = F.when(F.col("level") == 0, F.lit(-(1 << (self.bits - 1))).cast("long")).otherwise(F.expr(f"shiftright(code, cast({BITS} - level AS INT)) * shiftleft(1L, {self.bits} - level)"))
            cells = F.when(F.col("level") >= self.bits, cells).otherwise(F.sequence(prefix, prefix + span - 1))
        asked = asked.withColumn("cell", F.explode(cells)).join(self.cells.select(*_KEYS), ["tree", "cell"])
        none = lambda kind: F.lit(None).cast(kind)
        asked = asked.select(*_KEYS, none("binary").alias("codes"), none("binary").alias("entries"), "code", "query_id", F.col("level").cast("long").alias("level"))
        named = asked.select(*_KEYS).distinct()
        cells = self.cells.join(named, _KEYS, "left_semi").withColumns({"code": none("long"), "query_id": none("long"), "level": none("long")})
        met = cells.unionByName(asked).repartition(self.parts, *_KEYS).sortWithinPartitions(*_KEYS, F.col("level").asc_nulls_first())
        return met.mapInArrow(_walker(counting), "query_id long, counts array<long>" if counting else "query_id long, block long, places binary")

    def compare(self, queries: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each query among the entries that share ``level`` leading bits with it in some tree."""
        met = cut(self.walk(queries, False))
        none = lambda kind: F.lit(None).cast(kind)
        entries = self.entries.select(F.floor(F.col("e") / BLOCK).cast("long").alias("block"), F.lit(False).alias("asking"), (F.col("e") % BLOCK).alias("number"), F.lit(0).alias("part"), "ids", "v", none("binary").alias("places"))
        entries = entries.join(met.select("block").distinct(), "block", "left_semi")
        asked = met.select("query_id", "block").distinct().join(queries.select("query_id", "qv"), "query_id")
        asked = asked.select("block", F.lit(True).alias("asking"), F.col("query_id").alias("number"), F.lit(0).alias("part"), none("array<long>").alias("ids"), F.col("qv").alias("v"), none("binary").alias("places"))
        lists = met.select("block", F.lit(True).alias("asking"), F.col("query_id").alias("number"), F.lit(1).alias("part"), none("array<long>").alias("ids"), F.array().cast("array<double>").alias("v"), "places")
        rows = entries.unionByName(asked).unionByName(lists).repartition(self.parts, "block").sortWithinPartitions("block", "asking", "number", "part")
        found = rows.mapInArrow(_comparer(self.hasher, k), "query_id long, vec_id long, score double, cosine double")
        first = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("cosine").alias("cosine"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        out = cut(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        forget(met)
        return out


def _centres(rows: DataFrame) -> dict[int, list[float]]:
    """The mean vector of each length in a bounded sample."""
    ranked = rows.withColumn("r", F.xxhash64("vec_id", "v"))
    # The ranks alone are sorted; the vectors of the few rows below the cut follow.
    last = ranked.select("r").orderBy("r").limit(SAMPLE).agg(F.max("r").alias("last")).first()["last"]
    sample: dict[int, list] = {}
    for r in [] if last is None else ranked.where(F.col("r") <= last).select("v").limit(2 * SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    return {width: np.mean(own, axis=0).tolist() for width, own in sample.items()}


def _numbered(sorted_rows: DataFrame) -> DataFrame:
    """Numbers rows through, from 0, in place of (part, row). One row for each partition is broadcast."""
    parts = sorted_rows.groupBy("part").agg(F.count("*").alias("many"), F.min("row").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", (F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    out = cut(sorted_rows.join(F.broadcast(parts), "part").withColumn("e", F.col("row") + F.col("shift")).drop("part", "row", "shift"))
    forget(sorted_rows)
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = K, trees: int = TREES, reach: float = REACH, cell: int = CELL, seed: int = 5) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bound_batches(spark, 2048)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = clean(vectors)
    hasher = Hasher(_centres(rows), trees, seed)
    coded = "ids array<long>, v array<double>, width int, codes array<long>"
    smallest = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        rows.distinct().withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "v")
        .mapInArrow(_coder(hasher), coded).withColumn("c0", F.col("codes")[0])
        .repartitionByRange(parts, "width", "c0", F.col("ids")[0]).sortWithinPartitions("width", "c0", F.col("ids")[0]).drop("c0")
    )
    entries = _numbered(cut(entries.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = asked.select(F.array("query_id").alias("ids"), "v").mapInArrow(_coder(hasher), coded)
    queries = cut(asked.select(F.col("ids")[0].alias("query_id"), F.col("v").alias("qv"), "width", "codes"))
    forest = Forest(entries, hasher, cell)

    bound_batches(spark, 16_384)
    counted = forest.walk(queries.withColumn("level", F.lit(0)), True).groupBy("query_id").agg(*[F.sum(F.col("counts")[x]).alias(f"n{x}") for x in range(BITS + 1)])
    longest = F.coalesce(*[F.when(F.col(f"n{x}") >= WANT, x) for x in range(BITS, -1, -1)], F.lit(0))
    todo = cut(queries.join(counted.select("query_id", longest.cast("int").alias("level")), "query_id", "left").withColumn("level", F.coalesce("level", F.lit(0))))
    answers = None
    while True:
        bound_batches(spark, 2048)
        found = forest.compare(todo, k)
        chance = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.min("cosine")))) / math.pi
        # The length at which a neighbour as far as the k-th is met in some tree with probability ``reach``.
        least = F.when(chance > 1 - 1e-12, BITS).otherwise(F.greatest(F.lit(0), F.floor(math.log(1 - (1 - reach) ** (1 / trees)) / F.log(F.greatest(chance, F.lit(1e-9))))))
        judged = todo.join(found.groupBy("query_id").agg(F.count("*").alias("many"), least.alias("least")), "query_id", "left")
        short = F.coalesce("many", F.lit(0)) < k
        target = F.when(short, F.greatest(F.lit(0), F.col("level") - 4)).otherwise(F.least("least", "level")).cast("int")
        judged = cut(judged.select(*queries.columns, "level", target.alias("target")))
        done = judged.where("target = level").select("query_id")
        best = found.join(done, "query_id", "left_semi")
        answers = best if answers is None else answers.unionByName(best)
        todo = judged.where("target < level").select(*queries.columns, F.col("target").alias("level"))
        if todo.isEmpty():
            break
    forget(entries, queries, forest.cells)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
