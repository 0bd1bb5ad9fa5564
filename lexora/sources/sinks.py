"""Sinks: appends, inserts, upserts and versioned imports as new table versions, and file exchange."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions.text import mask_personal
from lexora.operators.relational import insert_absent, snapshot_diff, upsert_counter


def append_log(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Bulk append; partitioned by a date column the log prunes by it."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not there."""
    target = rows.sparkSession.read.schema(rows.schema).parquet(path)
    insert_absent(target, rows, keys).write.mode("append").parquet(path)


def next_version(rows: DataFrame, root: str, version: int) -> str:
    """Write a table version beside the others: readers of the old one are not disturbed."""
    path = f"{root.rstrip('/')}/v{version:08d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def upsert_attempts(old: DataFrame, batch: DataFrame, root: str, version: int, keys: list[str]) -> str:
    """A new version of an attempts table in which counters add up and the last outcome wins."""
    return next_version(upsert_counter(old, batch, keys, "attempts", "last_at", ["last_source", "last_reason"]), root, version)


def import_bindings(current: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(changes by kind, the new version) of a batch import; repeated imports change nothing."""
    change = snapshot_diff(current, batch, keys, columns).where("change != 'delete'")
    kept = current.join(batch.select(*keys), keys, "left_anti")
    return change.groupBy("change").agg(F.count("*").alias("rows")), kept.unionByName(batch.select(*current.columns))


def audit(requests: DataFrame, most: int = 120) -> DataFrame:
    """Request log rows with masked, shortened keywords."""
    return requests.withColumn("keyword", mask_personal(F.col("keyword"), most))


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a stated schema; a malformed row fails the read instead of being lost."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


class _Pending:
    """A value that one caller computes while others wait."""

    def __init__(self):
        self.ready, self.value, self.error, self.until = threading.Event(), None, None, 0.0


class ResultCache:
    """Results kept by a digest of the request for a time; callers that ask at once share one computation.

    At most ``most`` are kept: spent ones go first, then all that are finished. A failure reaches all who waited for it and is not kept.
    Without a lifetime nothing is kept.
    """

    def __init__(self, seconds: float, most: int = 2048):
        self.seconds, self.most, self.held, self.lock = seconds, most, {}, threading.Lock()

    def get(self, key: tuple, compute, now: float):
        """(value, whether it was held or shared)."""
        if self.seconds <= 0:
            return compute(), False
        digest = hashlib.sha256(repr(key).encode()).hexdigest()
        with self.lock:
            entry = self.held.get(digest)
            mine = entry is None or (entry.ready.is_set() and now >= entry.until)
            if mine:
                self.held.pop(digest, None)
                if len(self.held) >= self.most:
                    self._shrink(now)
                entry = self.held[digest] = _Pending()
        if not mine:
            entry.ready.wait()
            if entry.error is not None:
                raise entry.error
            return entry.value, True
        try:
            entry.value = compute()
        except BaseException as error:
            entry.error = error
            with self.lock:
                if self.held.get(digest) is entry:
                    del self.held[digest]
            raise
        finally:
            entry.until = now + self.seconds
            entry.ready.set()
        return entry.value, False

    def _shrink(self, now: float) -> None:
        for spent in (lambda e: now >= e.until, lambda e: True):
            self.held = {k: e for k, e in self.held.items() if not (e.ready.is_set() and spent(e))}
            if len(self.held) < self.most:
                return
