"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a document's hash. All documents begin in one bucket;
a bucket over the byte limit splits on the next bit, others stay, until every shard fits. As a
bucket's bytes are the sum of its halves', a document's shard is at the smallest depth at which its
prefix fits. So one round aggregates bytes by a prefix of ``step`` bits (partial sums, combined before
the shuffle), sums those cells into all their ancestors, and reads off the depth of each cell; only
cells that still do not fit go to another round with the next bits. ``step`` follows the corpus's size,
so a corpus takes one or two rounds. No row count grows in one task: a prefix's sum is all that meets.

The hash's bits are 60 of the MD5 of doc_id, then 60 of the MD5 of the text, then those of a number
for the row, so rows that repeat a doc_id, or both, still split.

Defined cases: a null text has no bytes; a null doc_id hashes as an empty string; one document larger than
the limit is a shard alone. An empty table has no shards. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.session import cut

LIMIT = 1 << 20
WINDOW, WINDOWS = 60, 3


def _bits(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, WINDOW // 4), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("bytes"),
        _bits(F.md5(F.coalesce(doc, F.lit("")).cast("binary"))).alias("w0"),
        _bits(F.md5(text.cast("binary"))).alias("w1"),
        _bits(F.md5(row.cast("string").cast("binary"))).alias("w2"),
    )


def _slice(depth: int, step: int) -> Column:
    """The ``step`` bits of the hash that follow the first ``depth``; a slice stays in its window."""
    window, at = divmod(depth, WINDOW)
    return F.shiftright(f"w{window}", WINDOW - at - step).bitwiseAND((1 << step) - 1)


def _text_bits(value: Column, width: Column) -> Column:
    """The leading bits as a string of 0 and 1."""
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(value), width.cast("int"), F.lit("0")))


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard (its hash prefix as a bit string), depth, shard_bytes and shard_docs."""
    rows = cut(_keyed(docs))
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    step = min(20, max(4, math.ceil(math.log2(max(1, total / limit))) + 3))
    todo, depth, placed = rows.withColumn("path", F.lit("")), 0, None
    while True:
        width = min(step, WINDOW - depth % WINDOW)
        own = todo.withColumn("slice", _slice(depth, width))
        cells = own.groupBy("path", "slice").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        levels = F.explode(F.sequence(F.lit(0), F.lit(width))).alias("level")
        above = cells.select("path", "slice", "bytes", "docs", levels).withColumn("prefix", F.expr(f"shiftright(slice, {width} - level)"))
        sizes = above.groupBy("path", "level", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        fits = sizes.where((F.col("bytes") <= limit) | (F.col("docs") == 1))
        # The depth of each cell: the first of its ancestors that fits.
        first = (
            above.select("path", "slice", "level", "prefix").join(fits, ["path", "level", "prefix"])
            .groupBy("path", "slice").agg(F.min(F.struct("level", "bytes", "docs")).alias("at"))
        )
        judged = cut(own.join(first, ["path", "slice"], "left"))
        shard = F.concat("path", _text_bits(F.expr(f"shiftright(slice, {width} - at.level)"), F.col("at.level")))
        done = judged.where("at IS NOT NULL").select("doc_id", F.col("bytes"), shard.alias("shard"), (F.col("at.level") + depth).cast("int").alias("depth"), F.col("at.bytes").alias("shard_bytes"), F.col("at.docs").alias("shard_docs"))
        placed = done if placed is None else placed.unionByName(done)
        depth += width
        left = judged.where("at IS NULL")
        if depth >= WINDOW * WINDOWS or not left.limit(1).count():
            return placed
        todo = left.select(*rows.columns, F.concat("path", _text_bits(F.col("slice"), F.lit(width))).alias("path"))


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
nodes AS (SELECT doc_id, bytes, level, h >> (60 - level) AS prefix FROM rows, (SELECT unnest(range(0, 31)) AS level)),
sizes AS (SELECT level, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM nodes GROUP BY ALL),
first AS (
  SELECT n.doc_id, min(n.level) AS level FROM nodes n JOIN sizes s ON n.level = s.level AND n.prefix = s.prefix
  WHERE shard_bytes <= {LIMIT} OR shard_docs = 1 GROUP BY n.doc_id)
SELECT n.doc_id, n.bytes::BIGINT AS bytes,
  CASE WHEN n.level = 0 THEN '' ELSE right(repeat('0', 31) || bin(n.prefix), n.level::INT) END AS shard,
  n.level::INT AS depth, shard_bytes, shard_docs
FROM first f JOIN nodes n ON f.doc_id = n.doc_id AND f.level = n.level
JOIN sizes s ON n.level = s.level AND n.prefix = s.prefix
"""
