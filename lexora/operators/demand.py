"""Demand, gaps, coverage, lanes and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.operators.relational import mode_per_key, top_per_key, unknown_terms, unpivot


def demand_evidence(asked: DataFrame, as_of: Column, hosts: int = 2, days: int = 3, window: int = 60) -> DataFrame:
    """Terms asked for by enough hosts on enough days: (term, hosts, days, shown), shown being the form most used.

    asked: term, form, host, at.
    """
    fresh = asked.where(F.col("at") >= as_of - F.expr(f"interval {window} days"))
    counted = fresh.groupBy("term").agg(F.count_distinct("host").alias("hosts"), F.count_distinct(F.date_trunc("day", "at")).alias("days"))
    passed = counted.where((F.col("hosts") >= hosts) & (F.col("days") >= days))
    return passed.join(mode_per_key(asked, ["term"], "form", "shown"), "term")


def unmet(terms: DataFrame, known: DataFrame, examples: int = 10) -> DataFrame:
    """Terms without an entity by kind: (kind, terms, asked, examples). terms: term, kind; known: name."""
    per = unknown_terms(terms, known, "term").groupBy("kind", "term").agg(F.count("*").alias("asked"))
    totals = per.groupBy("kind").agg(F.count("*").alias("terms"), F.sum("asked").alias("asked"))
    first = top_per_key(per, ["kind"], [F.desc("asked"), F.asc("term")], examples, "n").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("rows"))
    return totals.join(first, "kind").select("kind", "terms", "asked", F.array_join(F.transform("rows", lambda r: r["term"]), ",").alias("examples"))


def locale_gaps(rows: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Rows, filled and missing values by key and locale column, in one pass over the table."""
    long = unpivot(rows, keys, columns, "locale", "value")
    filled = F.count("value")
    return long.groupBy(*keys, "locale").agg(F.count("*").alias("rows"), filled.alias("filled"), (F.count("*") - filled).alias("missing"), F.round(100 * filled / F.count("*"), 1).alias("pct"))


def answer_matrix(asked: DataFrame, held: DataFrame, key: str, by: str) -> DataFrame:
    """Requests, answers and their share by ``by``. held: key, answered."""
    answered = F.count_if(F.coalesce("answered", F.lit(False)))
    return asked.join(held, key, "left").groupBy(by).agg(F.count("*").alias("asked"), answered.alias("answered"), F.round(100 * answered / F.count("*"), 1).alias("pct"))


def coverage(terms: DataFrame, held: DataFrame, order: Sequence[str] = ("answerable", "rejected", "candidate")) -> DataFrame:
    """Terms by the best state that an entity of theirs reaches; none without an entity. held: term, state."""
    names = [*order, "none"]
    rank = F.array_position(F.array(*map(F.lit, names)), F.coalesce("state", F.lit("none")))
    best = terms.join(held, "term", "left").groupBy("term").agg(F.min(rank).cast("int").alias("rank"))
    return best.groupBy(F.element_at(F.array(*map(F.lit, names)), F.col("rank")).alias("bucket")).agg(F.count("*").alias("terms"))


def best_status(rows: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """(key, asked, status): the best status of each key by a fixed order."""
    names = F.array(*map(F.lit, order))
    return rows.groupBy(key).agg(F.count("*").alias("asked"), F.min(F.array_position(names, F.col(status))).cast("int").alias("_r")).select(key, "asked", F.element_at(names, F.col("_r")).alias("status"))


def silent_lanes(runs: DataFrame, last: int = 10, alert: int = 3) -> DataFrame:
    """Lanes by the run streak that scanned rows and applied none, over their last runs. runs: lane, at, scanned, applied."""
    recent = top_per_key(runs, ["lane"], [F.desc("at")], last, "n")
    worked = F.when((F.col("scanned") > 0) & (F.col("applied") == 0), 0).otherwise(1)
    upto = Window.partitionBy("lane").orderBy("n")
    streak = F.count_if(F.col("broken") == 0)
    return recent.withColumn("broken", F.sum(worked).over(upto)).groupBy("lane").agg(
        F.count("*").alias("runs"), streak.alias("streak"), (streak >= alert).alias("silent"), F.sum("scanned").alias("scanned"), F.sum("applied").alias("applied")
    )


def incidents(rows: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` failures of a role, each ended by a success. rows: role, event_id, at, failed."""
    order = Window.partitionBy("role").orderBy("at", "event_id")
    islands = rows.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order))
    found = islands.where("failed").groupBy("role", "island").agg(F.count("*").alias("failures"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return found.where(F.col("failures") >= least)


def rate_windows(rows: DataFrame, width: str, limit: int) -> DataFrame:
    """Calls of each key in each tumbling window. rows: key, at."""
    counted = rows.groupBy("key", F.window("at", width).alias("w")).agg(F.count("*").alias("calls"))
    return counted.select("key", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("minute"), "calls", (F.col("calls") > limit).alias("limited"))
