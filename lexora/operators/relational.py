"""Relational building blocks: keyed firsts, top lists, unpivots, name-set joins, paging, versioned rewrites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.session import cut


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Spark limits groups before the shuffle, so hot keys stay small."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return numbered.withColumnRenamed("_n", rank) if rank else numbered.drop("_n")


def latest_value(df: DataFrame, keys: Sequence[str], value: str, at: str, name: str) -> DataFrame:
    """The value of the latest row of each key, as an aggregate: no window, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, at).alias(name))


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(name))


def top_list(value: str, order: Column, n: int, separator: str = ",") -> Column:
    """Aggregate: the first n values of a group in some order, joined."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(value).cast("string").alias("v")))), 1, n)
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def unpivot(df: DataFrame, keys: Sequence[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long in one pass; columns maps a label to the column that holds its value."""
    pairs = ", ".join(f"'{label}', cast(`{column}` as string)" for label, column in columns.items())
    return df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as ({name}, {value})")


def names_of(df: DataFrame, key: str, canonical: str, aliases: str | None = None) -> DataFrame:
    """(name, key): canonical names and aliases as one distinct set, for equi joins in place of OR conditions."""
    names = F.array(F.col(canonical)) if aliases is None else F.concat(F.array(F.col(canonical)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return df.select(F.explode(names).alias("name"), F.col(key)).where("name is not null and name != ''").distinct()


def unknown_terms(terms: DataFrame, names: DataFrame, term: str, name: str = "name") -> DataFrame:
    """The rows whose term is no known name: an equi anti join over the name set."""
    return terms.join(names.select(F.col(name).alias(term)).distinct(), term, "left_anti")


def shared_values(df: DataFrame, key: str, value: str, others: Sequence[str] = ()) -> DataFrame:
    """Values held by several keys: (value, *others, holders, least, most)."""
    distinct = df.select(key, value, *others).distinct()
    return distinct.groupBy(value, *others).agg(F.count("*").alias("holders"), F.min(key).alias("least"), F.max(key).alias("most")).where("holders > 1")


def ambiguous(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Marks rows that share their keys with another row: an aggregate joined back, no self join."""
    counted = df.groupBy(*keys).agg((F.count("*") > 1).alias(flag))
    return df.join(counted, list(keys))


def page_after(df: DataFrame, at: str, key: str, cursor: tuple, n: int) -> DataFrame:
    """The n + 1 rows behind a cursor (at, key): one more than a page tells whether there is another."""
    t, k = F.lit(cursor[0]), F.lit(cursor[1])
    return df.where((F.col(at) > t) | ((F.col(at) == t) & (F.col(key) > k))).orderBy(at, key).limit(n + 1)


def surrogate_ids(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in some order, by a range sort and the partitions' sizes, not one task's window."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_r", F.monotonically_increasing_id()))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("n"), F.min("_r").alias("first"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", "first", before.alias("before"))
    return marked.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_r") - F.col("first") + F.col("before") + start).drop("_p", "_r", "first", "before")


def running_sum(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """The sum of a value up to each row in some order, by a range sort and the partitions' sums, not one task's window."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_v", value.cast("long")).repartitionByRange(parts, order).sortWithinPartitions(order)
    marked = cut(ranged.withColumn("_p", F.spark_partition_id()))
    sums = marked.groupBy("_p").agg(F.sum("_v").alias("s"))  # a row for each partition
    before = F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_v").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_own", own).join(F.broadcast(sums.select("_p", before.alias("_before"))), "_p").withColumn(name, F.col("_own") + F.col("_before")).drop("_p", "_v", "_own", "_before")


def prefix_matches(names: DataFrame, groups: DataFrame, name: str, group: str) -> DataFrame:
    """Pairs where a name is a group's name, a space, and a rest: joined on the name's own word prefixes."""
    words = F.split(F.col(name), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    spread = names.where(F.contains(F.col(name), F.lit(" "))).withColumn(group, F.explode(prefixes))
    return spread.join(groups.select(group).distinct(), group)


def overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, row: str, days: int = 30) -> DataFrame:
    """Pairs (a, b) of rows of one key whose closed intervals of time overlap.

    Intervals meet in stretches of ``days`` days that both lie in, and count where the later one begins, so rows
    of a key that are far apart never meet.
    """
    stretch = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86_400 * days))
    spread = df.where(F.col(start) <= F.col(end)).withColumn("_first", stretch(start))
    spread = spread.select(*keys, row, start, end, "_first", F.explode(F.sequence("_first", stretch(end))).alias("_at"))
    a = spread.select(*keys, "_at", F.col(row).alias("a"), F.col(start).alias("sa"), F.col(end).alias("ea"), F.col("_first").alias("fa"))
    b = spread.select(*keys, "_at", F.col(row).alias("b"), F.col(start).alias("sb"), F.col(end).alias("eb"), F.col("_first").alias("fb"))
    met = (F.col("a") < F.col("b")) & (F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea")) & (F.col("_at") == F.greatest("fa", "fb"))
    return a.join(b, [*keys, "_at"]).where(met).select(*keys, "a", "b")


def has_overlap(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows whose interval overlaps an earlier one of their key: a running maximum, no self join."""
    earlier = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_e", F.max(end).over(earlier)).where(F.col("_e") >= F.col(start)).drop("_e")


def both_ways(edges: DataFrame, subject: str, object_: str, predicate: str) -> DataFrame:
    """Every relation seen from both ends: (entity, other, predicate, direction)."""
    out = edges.select(F.col(subject).alias("entity"), F.col(object_).alias("other"), predicate, F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col(object_).alias("entity"), F.col(subject).alias("other"), predicate, F.lit("in").alias("direction")))


def first_by_url(lists: Sequence[DataFrame], url: str) -> DataFrame:
    """Hit lists merged by URL; of equal ones that of the earliest list."""
    ranked = reduce(DataFrame.unionByName, [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)])
    return top_per_key(ranked, [url], [F.col("_list")]).drop("_list")


def upsert_counter(old: DataFrame, new: DataFrame, keys: Sequence[str], counter: str, at: str, payload: Sequence[str]) -> DataFrame:
    """Insert or update with a counter: a new version of a keyed table in which counters add and the latest payload wins."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.sum(counter).alias(counter), F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in payload])


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append so that no key is there twice."""
    return rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def update_from(target: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A new version of a table in which a patch's non-null values replace; a patch has one row a key."""
    renamed = patch.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(renamed, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, change): insert, update, unchanged or delete, by fingerprints of the rows."""
    mark = F.sha2(F.to_json(F.struct(*columns)), 256)
    a = old.select(*keys, mark.alias("_old"))
    b = new.select(*keys, mark.alias("_new"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("update")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change"))


def array_add(a: Column, value: Column) -> Column:
    """An array with a value added, without repeats and blanks."""
    return F.filter(F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.array(value))), lambda x: x.isNotNull() & (x != ""))


def array_minus_self(a: Column, b: Column, own: Column) -> Column:
    """The names of two arrays without one's own."""
    empty = F.array().cast("array<string>")
    return F.array_except(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)), F.array(own))
