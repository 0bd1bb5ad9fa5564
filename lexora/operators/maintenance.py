"""What triggers keep up to date in a database, as recomputation of the touched rows alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions.rank import common_type

STATUSES = ["active", "candidate", "rejected"]


def child_mark(*columns: str) -> Column:
    """An aggregate that tells sets of child rows apart whatever their order: their number and the sum of 60 bits of each row's digest.

    It is summed on the map side, so a parent with very many children needs no list of them.
    """
    each = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    bits = F.conv(F.substring(F.md5(each.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(bits).cast("decimal(38,0)").cast("string"))


def input_hashes(parents: DataFrame, key: str, own: Sequence[str], children: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(key, input_hash) of parents: their own columns and a mark of the rows of each child table, which have the parent's key."""
    marked = parents.select(key, *[c for c in own if c != key])
    for n, (rows, columns) in enumerate(children):
        marked = marked.join(rows.groupBy(key).agg(child_mark(*columns).alias(f"_m{n}")), key, "left")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*own, *[f"_m{n}" for n in range(len(children))]]]
    return marked.select(key, F.md5(F.concat_ws("|", *parts).cast("binary")).alias("input_hash"))


def refresh_hashes(parents: DataFrame, touched: DataFrame, key: str, own: Sequence[str], children: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Parents, in which only those named in ``touched``, the changed rows of any child table, get their hash again; nothing else changes.

    Children of other parents are not aggregated. Rows without a parent's key and unknown parents are passed over.
    """
    ids = touched.select(key).where(F.col(key).isNotNull()).distinct()
    near = [(rows.join(ids, key, "left_semi"), columns) for rows, columns in children]
    fresh = input_hashes(parents.join(ids, key, "left_semi"), key, own, near).withColumnRenamed("input_hash", "_fresh")
    return parents.join(fresh, key, "left").select(*[F.coalesce("_fresh", c).alias(c) if c == "input_hash" else F.col(c) for c in parents.columns])


def sync_projection(projected: DataFrame, before: DataFrame, after: DataFrame, at: Column, owner: str = "legacy") -> tuple[DataFrame, DataFrame]:
    """(projected, faults) after the older table went from ``before`` to ``after``; only changed rows are written.

    before, after: id, type, name, status, locked, qualifier, one row an id; projected: these and subtype, origin, write_owner, revision,
    updated_at. New rows are inserted, changed ones updated where anything differs, with a revision more; a new common type clears
    the subtype; rows gone are retired. Statuses other than ``STATUSES`` count as retired. Rows that another owner writes take on
    a lock only. Changed rows whose id has another origin are faults and stay as they are.
    """
    fields = ["type", "name", "status", "locked", "qualifier"]
    shape = F.struct(
        common_type(F.col("type")).alias("type"), F.col("name"), F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("retired").alias("status"),
        F.coalesce("locked", F.lit(False)).alias("locked"), F.when(F.trim("qualifier") != "", F.trim("qualifier")).alias("qualifier"), F.col("type").alias("given"),
    )
    was, now = before.select("id", shape.alias("_was"), F.col("status").alias("_s")), after.select("id", shape.alias("_now"), F.col("status").alias("_t"))
    changes = was.join(now, "id", "full").where(~F.col("_was").eqNullSafe(F.col("_now")) | ~F.col("_s").eqNullSafe(F.col("_t")))
    changes = changes.select("id", "_now", F.lit(True).alias("_changed"))
    both = projected.withColumn("_here", F.lit(True)).join(changes, "id", "full")
    here, changed, gone = F.coalesce("_here", F.lit(False)), F.coalesce("_changed", F.lit(False)), F.col("_now").isNull()
    foreign, ours = here & (F.col("origin") != owner), F.col("write_owner") == owner
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_now.{c}")) for c in fields])
    act = (
        F.when(~changed, "keep").when(~here & gone, "drop").when(~here, "insert").when(gone & ours, "retire").when(gone, "keep").when(foreign, "fault")
        .when(~ours & F.col("_now.locked") & ~F.col("locked"), "lock").when(~ours, "keep").when(differs, "update").otherwise("keep")
    )
    told = both.withColumn("_act", act)
    a, written = F.col("_act"), F.col("_act").isin("insert", "update")
    new = {c: F.when(written, F.col(f"_now.{c}")).otherwise(F.col(c)) for c in fields}
    new["status"] = F.when(a == "retire", "retired").otherwise(new["status"])
    new["locked"] = F.when(a == "lock", True).otherwise(new["locked"])
    new["subtype"] = F.when((a == "update") & ~F.col("type").eqNullSafe(F.col("_now.type")), None).otherwise(F.col("subtype"))
    new["origin"] = F.when(a == "insert", owner).otherwise(F.col("origin"))
    new["write_owner"] = F.when(a == "insert", owner).otherwise(F.col("write_owner"))
    new["revision"] = F.when(a == "insert", 1).when(a.isin("update", "retire", "lock"), F.col("revision") + 1).otherwise(F.col("revision"))
    new["updated_at"] = F.when(a.isin("insert", "update", "retire", "lock"), at).otherwise(F.col("updated_at"))
    table = told.where("_act <> 'drop'").select(*[new[c].cast(dict(projected.dtypes)[c]).alias(c) if c in new else F.col(c) for c in projected.columns])
    return table, told.where("_act = 'fault'").select("id", "origin")
