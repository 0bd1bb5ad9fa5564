"""Near-duplicate detection: chosen-path set similarity join over five-word shingles.

Method. A document is the set of its distinct five-word shingles (``_hashing``). Documents with equal
sets, told by a cryptographic digest of the whole set, are one class and take part once, so copies
cost nothing. Every class walks down independent trees. Each place of a tree selects one or two
minwise tokens that no other place and no other tree uses, and the class goes on into one child for
each selected token; the child's path holds the token, so two sets of similarity s share a child with
probability s. Two tokens are selected on the first levels, which keeps pairs at the threshold
together, and one on the levels below, which parts the others. The number of trees is chosen so that
the chance of missing a pair at the threshold in all of them is under ``MISS``; regrown trees draw
tokens of their own and keep to it too.

Nodes are compared exhaustively, on the full sets, and what a comparison gives out is linear in its
members:

1. In each node of up to ``SMALL`` members all members are compared by 96 minwise tokens. Those that
   may be linked, directly or through others, belong together; a spanning forest of that goes out. A
   larger node belongs together as a whole. Nodes with the same members are compared once.
2. What belongs together forms groups. The texts of a group of up to ``SMALL`` members meet in one
   task, once, where all pairs are compared by a product of their membership matrices: exact
   intersections, and the group's components at once.
3. A group of up to ``FEW`` times ``SMALL`` members is dealt into half blocks at random. Every two of
   them meet in one task, all in one round, so all pairs are compared as in 2, and a spanning forest
   of the links goes out.
4. A larger group is dealt into blocks at random, which settles most of it, and then goes through its
   trees, one after the other: only nodes that still hold several components are compared, as in 2,
   and a spanning forest of new links goes out. Nodes of more than ``SMALL`` members are branched
   further by deeper trees, and what stays larger is compared block by block, so no link is given up.

A pair inside a component is not compared, so only links that cannot change a component are left
out. A pair at the threshold passes the comparison by tokens with a probability over 0.999999.
Every table written on the way is deleted when what follows from it is written.

Defined cases: a null or empty text, or one of white space, has no shingles and is linked with
nothing. Rows with a null doc_id take part in no link; their component_id is null and they are
kept. Rows that repeat a doc_id are separate rows, linked by their own texts. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.llm._hashing import mix, shingle_sets, stream
from lexora.operators.components import connected_components
from lexora.session import bound_batches, cut, forget, shared_dir

TOKENS, MISS = 96, 4e-6
#: Standard deviations below the threshold at which the tokens of a pair still let it pass.
SLACK = 4.8
#: Members, and shingles of all members, that are compared in one task; how often larger nodes are branched further.
SMALL, SHINGLES, REGROW = 1024, 1 << 20, 2
#: Blocks of ``SMALL`` members up to which a group is compared at once; a text goes to 2 * FEW - 1 tasks at most.
FEW = 4
#: Rows without texts that are handed to Python at once.
NARROW = 16_384

_U = np.uint64
_SKETCH = "doc_id long, mark long, n_shingles long, k1 long, k2 long, tokens binary, paths array<long>, packed binary"


def levels_for(similarity: float, deeper: int = 0) -> list[int]:
    """Tokens selected on each level: two on three levels, then one on as many as cost little recall."""
    return [2, 2, 2] + [1] * (int(math.log(0.44) / math.log(similarity)) + deeper)


def trees_for(similarity: float, levels: list[int], miss: float = MISS) -> int:
    """Trees that miss a pair at the threshold with probability ``miss`` at most."""
    lost = 0.0
    for fan in reversed(levels):
        lost = (1 - similarity + similarity * lost) ** fan
    return math.ceil(math.log(miss) / math.log(lost))


def minwise(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The minwise token of a set under each seed."""
    best = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 512):
            np.minimum(best, (seeds[:, None] * hashes[None, i:i + 512]).min(axis=1), out=best)
    return mix(best)


def tokens_for(trees: int, levels: list[int]) -> int:
    """Tokens that trees use when each place has its own."""
    return trees * sum(math.prod(levels[:i + 1]) for i in range(len(levels)))


def chosen_paths(tokens: np.ndarray, trees: int, levels: list[int], seed: int) -> np.ndarray:
    """Paths of each row of ``tokens`` in each tree; levels: tokens selected at each level."""
    rows, used = len(tokens), 0
    paths = np.broadcast_to(stream(seed, trees), (rows, trees))
    with np.errstate(over="ignore"):
        for fan in levels:
            wide = paths.shape[1] * fan
            place = np.arange(used + 1, used + wide + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
            paths = mix((np.tile(paths, fan) * _U(0x9E3779B97F4A7C15)) ^ tokens[:, used:used + wide] ^ place)
            used += wide
    return paths


def _sketcher(trees: int, levels: list[int], seed: int):
    """Sketches of (doc_id, mark, text): size, digest, tokens and paths of the set, and the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(TOKENS, tokens_for(trees, levels))
        seeds = stream(1000 + seed, width) | _U(1)
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for own in shingle_sets(batch.column(2)):
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                tokens.append(minwise(own, seeds))
            n = len(sizes)
            packed = [press.compress(t.encode()) if size else b"" for t, size in zip(batch.column(2).to_pylist(), sizes, strict=True)]
            drawn = np.array(tokens, dtype=np.uint64).reshape(n, width)
            paths = chosen_paths(drawn, trees, levels, seed)
            flat = pa.array(paths.reshape(-1).view(np.int64))
            marks = drawn[:, :TOKENS].astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, dtype=np.int32) * paths.shape[1]), flat)
            digest = np.frombuffer(b"".join(keys), np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([m.tobytes() for m in marks], pa.binary()), lists, pa.array(packed, pa.binary())],
                ["doc_id", "mark", "n_shingles", "k1", "k2", "tokens", "paths", "packed"],
            )

    return run


def _unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x) for x in column.to_pylist()], pa.large_binary())


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that never split rows of equal first column. Rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if held and (last or held[-1].column(0)[0].as_py() != key[0]):
            same = int(np.flatnonzero(key != held[-1].column(0)[0].as_py())[0]) if key[0] == held[-1].column(0)[0].as_py() else 0
            yield pa.Table.from_batches([*held, batch.slice(0, same)]).combine_chunks().to_batches()[0]
            batch, held, last = batch.slice(same), [], last - same
        if last > 0:
            yield batch.slice(0, last)
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups_of(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _forest(members: int, labels: np.ndarray, linked: Callable[[int], np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(spanning forest of new links, component of each member) where members of one label belong together.

    linked: a mask of the members linked with one. The forest is of stars around first members, which
    joins to components in fewer steps than paths.
    """
    own: dict[int, list[int]] = {}
    for i, x in enumerate(labels.tolist()):
        own.setdefault(x, []).append(i)
    left, component, forest = np.ones(members, bool), np.zeros(members, np.int64), []
    for i in range(members):
        if not left[i]:
            continue
        todo = list(own[labels[i]])
        left[todo] = False
        component[todo] = i
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(linked(j) & left).tolist():
                if left[k]:
                    forest.append((i, k))
                    more = own[labels[k]]
                    left[more] = False
                    component[more] = i
                    todo += more
    return forest, component


def _candidates(least: int, percent: int):
    """(src, dst): what may be linked in a group of (key, node, n, tokens), as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 4):
            key, node, size = (batch.column(i).to_numpy() for i in range(3))
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(key), TOKENS)

            def alike(i: int, rows: slice) -> np.ndarray:
                fits = 100 * np.minimum(size[i], size[rows]) >= percent * np.maximum(size[i], size[rows])
                return fits & ((marks[rows] == marks[i]).sum(axis=1) >= least)

            found = []
            for a, b in _groups_of(key):
                if b - a == 2:
                    if alike(a, slice(b - 1, b))[0]:
                        found.append((a, a + 1))
                else:
                    edges, _ = _forest(b - a, np.arange(b - a), lambda i, a=a, b=b: alike(a + i, slice(a, b)))
                    found += [(a + i, a + j) for i, j in edges]
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["src", "dst"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all pairs of sets of distinct hashes.

    Hashes held by the same members count as one column with a weight, so near copies, which share
    most of theirs, make a narrow matrix; its product with itself is taken a stretch of columns at a time.
    """
    many = len(sets)
    if many == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], dtype=np.float64)
    row = np.repeat(np.arange(many), [len(s) for s in sets])
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((many, many))
    keep = held[place] > 1
    row, place = row[keep], place[keep]
    if not len(row):
        return out
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    with np.errstate(over="ignore"):
        who = np.add.reduceat(stream(61, many)[row], starts)
    _, first, weight = np.unique(who, return_index=True, return_counts=True)
    ends = np.append(starts[1:], len(row))
    kind = np.float32 if weight.sum() < 1 << 24 else np.float64
    step = max(256, (1 << 21) // many)
    for i in range(0, len(first), step):
        taken = first[i:i + step]
        length = ends[taken] - starts[taken]
        at = np.repeat(starts[taken] - np.cumsum(length) + length, length) + np.arange(length.sum())
        matrix = np.zeros((many, len(taken)), kind)
        matrix[row[at], np.repeat(np.arange(len(taken)), length)] = 1
        out += (matrix * weight[i:i + step].astype(kind)) @ matrix.T
    return out


def _comparer(percent: int, settled: bool):
    """Compares groups of (key, node, label, packed) on the full sets.

    Gives (src, dst), a spanning forest of the links between labels, or, where the groups are all that
    can be linked (``settled``), (node, component) of every member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 4):
            key, node, label = (batch.column(i).to_numpy() for i in range(3))
            left, right = [], []
            for a, b in _groups_of(key):
                sets = list(shingle_sets(_unpacked(batch.column(3).slice(a, b - a))))
                size = np.array([len(s) for s in sets])
                shared = shared_counts(sets)
                edges, component = _forest(b - a, label[a:b], lambda i, size=size, shared=shared: 100 * shared[i] >= percent * (size[i] + size - shared[i]))
                if settled:
                    left += node[a:b].tolist()
                    least = np.full(b - a, np.iinfo(np.int64).max)
                    np.minimum.at(least, component, node[a:b])
                    right += least[component].tolist()
                else:
                    left += [node[a + i] for i, _ in edges]
                    right += [node[a + j] for _, j in edges]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["node", "component"] if settled else ["src", "dst"])

    return run


def _gathered(rows: DataFrame) -> DataFrame:
    """(node, keys, label) of (key, node, label): a text is joined once to its node, then goes to each of its keys."""
    return rows.groupBy("node").agg(F.collect_list("key").alias("keys"), F.first("label").alias("label"))


def _compare(own: DataFrame, texts: DataFrame, percent: int, settled: bool = False) -> DataFrame:
    """own: (node, keys, label), a row for each node; texts: (node, packed)."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = own.join(texts, "node").select(F.explode("keys").alias("key"), "node", "label", "packed")
    dealt = met.repartition(parts, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(_comparer(percent, settled), "node long, component long" if settled else "src long, dst long")


def _blocks(members: Column, shingles: Column) -> Column:
    """Blocks that a set of members is dealt into, so that each can be compared in a task."""
    return F.least(F.ceil(F.greatest(members / SMALL, shingles / SHINGLES)).cast("int"), members.cast("int"))


def _company(classes: DataFrame) -> DataFrame:
    """(path, node, members, lo) for the members of nodes with company. classes: node, paths."""
    rows = classes.select("node", F.explode("paths").alias("path"))
    held = rows.groupBy("path").agg(F.count("*").alias("members"), F.min("node").alias("lo")).where("members > 1")
    return rows.join(held, "path")


def _belonging(company: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(src, dst): members of a node that may be linked, or that lie in one large node."""
    spark = company.sparkSession
    share, parts = percent / 100, int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = math.floor(TOKENS * share - SLACK * math.sqrt(TOKENS * share * (1 - share)))
    small = company.where(F.col("members") <= SMALL).groupBy("path").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    small = small.select("nodes").distinct().select(F.xxhash64("nodes").alias("key"), F.explode("nodes").alias("node"))
    met = small.join(marks, "node").select("key", "node", "n", "tokens").repartition(parts, "key").sortWithinPartitions("key", "node")
    alike = met.mapInArrow(_candidates(least, percent), "src long, dst long")
    large = company.where((F.col("members") > SMALL) & (F.col("node") != F.col("lo"))).select(F.col("node").alias("src"), F.col("lo").alias("dst"))
    return alike.union(large)


def _mixed(members: DataFrame, labels: DataFrame, trees: int, tree: int | None = None) -> DataFrame:
    """(gid, path, node, label, blocks) of the nodes of one tree, or of all, that hold several components.

    members: gid, node, n, paths. Labels are joined to members, not to their many paths.
    """
    rows = members.join(labels.select("node", F.col("component").alias("label")), "node")
    paths = F.col("paths") if tree is None else F.filter("paths", lambda _, at: at % trees == tree)
    rows = rows.select("gid", "node", "n", "label", F.explode(paths).alias("path"))
    several = (
        rows.groupBy("gid", "path").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), _blocks(F.count("*"), F.sum("n")).alias("blocks"))
        .where("lo < hi").select("gid", "path", "blocks")
    )
    return rows.join(several, ["gid", "path"]).select("gid", "path", "node", "label", "blocks")


def _linked_further(links: DataFrame, labels: DataFrame) -> DataFrame:
    links = cut(links)
    if links.isEmpty():
        forget(links)
        return labels
    grown = connected_components(links, labels=labels)
    forget(links, labels)
    return grown


def _climb(members: DataFrame, labels: DataFrame, texts: DataFrame, trees: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Labels after the small nodes of each tree are compared, and (gid, path, node, label, blocks) of what is too large."""
    for tree in range(trees):
        mixed = cut(_mixed(members, labels, trees, tree).where("blocks = 1"))
        if not mixed.isEmpty():
            labels = _linked_further(_compare(_gathered(mixed.select(F.xxhash64("gid", "path").alias("key"), "node", "label")), texts, percent), labels)
        forget(mixed)
    return labels, cut(_mixed(members, labels, trees).where("blocks > 1"))


def _middling(groups: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the linked members of groups of a few blocks, in one round. groups: gid, node, blocks."""
    halves = 2 * F.col("blocks")
    dealt = groups.select("gid", "node", F.pmod(F.xxhash64("node"), halves).cast("int").alias("own"), F.sequence(F.lit(0), halves - 1).alias("others"))
    keys = F.transform(F.filter("others", lambda x: x != F.col("own")), lambda x: F.xxhash64("gid", F.least("own", x), F.greatest("own", x)))
    met = dealt.select("node", keys.alias("keys"), F.col("node").alias("label"))
    links = cut(_compare(met, sketch.select(F.col("row").alias("node"), "packed"), percent))
    linked = connected_components(links)
    forget(links)
    return linked


def _large(groups: DataFrame, classes: DataFrame, sketch: DataFrame, percent: int, seed: int, trees: int) -> DataFrame:
    """(node, component) of the members of large groups. groups: gid, node, blocks; classes: node, n, paths."""
    share = percent / 100
    texts = cut(sketch.join(groups.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "packed"))
    labels = cut(groups.select("node", F.col("node").alias("component")))
    dealt = groups.select("node", F.array(F.xxhash64("gid", F.pmod(F.xxhash64("node"), "blocks"))).alias("keys"), F.col("node").alias("label"))
    labels = _linked_further(_compare(dealt, texts, percent), labels)
    members = cut(groups.select("gid", "node").join(classes, "node"))
    labels, crowded = _climb(members, labels, texts, trees, percent)
    for again in range(1, REGROW + 1):
        if crowded.isEmpty():
            break
        crowd = crowded.select("gid", "node").distinct()
        deep = levels_for(share, 4 * again)
        trees = trees_for(share, deep)
        known = texts.join(crowd.select("node"), "node").select("node", F.col("node").alias("mark"), "packed")
        # Groups come from the first trees' tokens and stay as they are.
        grown = cut(known.mapInArrow(_resketcher(trees, deep, seed + 100 * again), "node long, n long, paths array<long>").join(crowd, "node"))
        forget(members, crowded)
        members = grown
        labels, crowded = _climb(members, labels, texts, trees, percent)
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        met = crowded.withColumn("own", own).withColumn("other", F.explode(others))
        cell = F.least("own", "other") * F.col("blocks").cast("long") + F.greatest("own", "other")
        labels = _linked_further(_compare(_gathered(met.select(F.xxhash64("gid", "path", cell).alias("key"), "node", "label")), texts, percent), labels)
    forget(members, crowded, texts)
    return labels


def _resketcher(trees: int, levels: list[int], seed: int):
    """(node, n, paths) of (node, mark, packed)."""
    sketch = _sketcher(trees, levels, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([x.decode() for x in _unpacked(batch.column(2)).to_pylist()], pa.large_string())
            for out in sketch(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["doc_id", "mark", "text"])])):
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(2), out.column(6)], ["node", "n", "paths"])

    return run


def _labelled(sketch: DataFrame, percent: int, seed: int, trees: int) -> DataFrame:
    """(k1, k2, component_id) of every class of equal sets."""
    spark = sketch.sparkSession
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(
        full.groupBy("k1", "k2")
        .agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("paths").alias("paths"))
    )
    company = cut(_company(classes.select("node", "paths")))
    bound_batches(spark, NARROW)
    edges = cut(_belonging(company, classes.select("node", "n", "tokens"), percent).distinct())
    bound_batches(spark)
    forget(company)
    together = connected_components(edges)
    forget(edges)
    groups = together.select("node", F.col("component").alias("gid")).join(classes.select("node", "n"), "node")
    sizes = groups.groupBy("gid").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    groups = cut(groups.select("gid", "node").join(sizes, "gid"))
    forget(together)
    small = groups.where("blocks = 1").select("node", F.array("gid").alias("keys"), F.col("node").alias("label"))
    labels = [cut(_compare(small, sketch.select(F.col("row").alias("node"), "packed"), percent, settled=True))]
    middling = groups.where(F.col("blocks").between(2, FEW))
    if not middling.isEmpty():
        labels.append(_middling(middling, sketch, percent))
    large = groups.where(F.col("blocks") > FEW)
    if not large.isEmpty():
        labels.append(_large(large, classes.select("node", "n", "paths"), sketch, percent, seed, trees))
    every = reduce(DataFrame.union, labels)
    named = every.join(classes.select("node", "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select(F.col("node").alias("member"), "component_id")
    known = classes.select("k1", "k2", "node", "least")
    out = cut(known.join(found, known["node"] == found["member"], "left").select("k1", "k2", F.coalesce("component_id", "least").alias("component_id")))
    forget(classes, groups, *labels)
    return out


def _linked(docs: DataFrame, percent: int, seed: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id and kept of each row."""
    spark = docs.sparkSession
    shared_dir(spark)
    bound_batches(spark)
    share = percent / 100
    levels = levels_for(share)
    trees = trees_for(share, levels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sketch = cut(rows.mapInArrow(_sketcher(trees, levels, seed), _SKETCH).withColumn("row", F.monotonically_increasing_id()))
    found = _labelled(sketch, percent, seed, trees)
    columns = ["doc_id", "mark", "n_shingles", "component_id"]
    linked = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").join(found, ["k1", "k2"]).select(*columns)
    alone = sketch.where("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id")).select(*columns)
    out = cut(linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    forget(sketch, found)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``percent`` is the least Jaccard similarity of a link in hundredths. ``component_id`` is the
    smallest doc_id reachable over links; ``kept`` holds for the document of that id.
    """
    return _linked(docs, percent, seed).drop("mark")


def without_copies(docs: DataFrame, percent: int = 80, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` whose own text is kept."""
    copies = _linked(docs, percent, seed).where(~F.col("kept")).select(F.col("doc_id").alias("_copy"), F.col("mark").alias("_mark")).distinct()
    own = (docs["doc_id"].cast("long") == copies["_copy"]) & (F.xxhash64(docs["text"]) == copies["_mark"])
    return docs.join(copies, own, "left_anti")
