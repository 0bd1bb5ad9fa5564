"""Supply, backlog and readiness measures, guards and conservation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.rank import can_replace, ttl_clock


def latency(rows: DataFrame, started: str, finished: str, sla_seconds: int = 120) -> DataFrame:
    """Count, median, mean and overruns of how long rows took, in seconds."""
    took = F.unix_timestamp(F.col(finished).cast("timestamp")) - F.unix_timestamp(F.col(started).cast("timestamp"))
    timed = rows.where(F.col(finished) >= F.col(started)).select(took.alias("took"))
    return timed.agg(F.count("*").alias("n"), F.percentile("took", 0.5).alias("median"), F.avg("took").alias("mean"), F.count_if(F.col("took") > sla_seconds).alias("over"))


def supply(rows: DataFrame, keys: Sequence[str], value: str, blocked: Column, eligible: Column) -> DataFrame:
    """Missing values by key, split by whether they may be filled and what stops them."""
    missing = F.col(value).isNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(missing).alias("missing"), F.count_if(missing & eligible & ~blocked).alias("fillable"),
        F.count_if(missing & blocked).alias("blocked"), F.count_if(missing & ~eligible).alias("ineligible"),
    )


def funnel(names: DataFrame, entities: DataFrame, queue: DataFrame) -> DataFrame:
    """Names by state: served, partly served, queued or unknown. names: name; entities: name, ready; queue: name."""
    held = entities.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("ready").alias("some"), F.bool_and("ready").alias("every"))
    waiting = queue.select("name").distinct().withColumn("queued", F.lit(True))
    state = F.when(F.col("every"), "served").when(F.col("some"), "partly").when(F.col("n") > 0, "preparing").when(F.col("queued"), "queued").otherwise("unknown")
    return names.distinct().join(held, "name", "left").join(waiting, "name", "left").groupBy(state.alias("state")).agg(F.count("*").alias("names"))


def backlogs(rows: DataFrame, at: str, as_of: Column, conditions: dict[str, Column], warn_days: int) -> DataFrame:
    """(condition, waiting, late, oldest_days) of each named condition, all in one pass over the rows."""
    age = F.datediff(as_of, F.col(at))
    tagged = F.filter(F.array(*[F.when(c, name) for name, c in conditions.items()]), lambda x: x.isNotNull())
    counted = rows.select(F.explode(tagged).alias("condition"), age.alias("age")).groupBy("condition")
    return counted.agg(F.count("*").alias("waiting"), F.count_if(F.col("age") > warn_days).alias("late"), F.max("age").alias("oldest_days"))


def tier_changes(stored: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Rows whose computed tier differs from the stored one. stored, computed: key, tier."""
    new = computed.select(key, F.col("tier").alias("now"))
    return stored.join(new, key).where(~F.col("tier").eqNullSafe(F.col("now"))).select(key, F.col("tier").alias("was"), "now")


def expired(rows: DataFrame, created: str, notes: str, as_of: Column, days: int = 21) -> DataFrame:
    """Rows whose clock, creation or last reopening, ran out."""
    return rows.where(ttl_clock(F.col(created), F.col(notes)) < as_of - F.expr(f"interval {days} days"))


def conservation(selected: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """(key, leak): selected but not reported, reported but not selected, or reported twice."""
    a, b = selected.select(key).distinct(), reported.select(key)
    lost = a.join(b, key, "left_anti").select(key, F.lit("lost").alias("leak"))
    extra = b.distinct().join(a, key, "left_anti").select(key, F.lit("extra").alias("leak"))
    twice = b.groupBy(key).count().where("count > 1").select(key, F.lit("twice").alias("leak"))
    return lost.unionByName(extra).unionByName(twice)


def retry_due(rows: DataFrame, attempts: DataFrame, keys: Sequence[str], as_of: Column, days: int = 90) -> DataFrame:
    """Rows not tried with the same input within the revisit window. Both hold keys and input_hash; attempts last_at and exhausted."""
    held = attempts.where(F.col("exhausted") & (F.col("last_at") > as_of - F.expr(f"interval {days} days"))).select(*keys, "input_hash")
    return rows.join(held, [*keys, "input_hash"], "left_anti")


def unverified_names(names: DataFrame, evidence: DataFrame) -> DataFrame:
    """Guard: verified names without verified evidence that may be exported; must be empty."""
    good = evidence.where("verified and exportable").select(F.col("evidence_id"))
    return names.where("verified").join(good, "evidence_id", "left_anti")


def refused_writes(current: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Guard: writes that a lock, a stronger source or a reversed validity forbids."""
    met = writes.join(current.select(key, "locked", F.col("source").alias("_own")), key)
    backward = F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False))
    return met.where(~can_replace(F.col("locked"), F.col("_own"), F.col("source")) | backward).drop("_own")


def withdraw(names: DataFrame, evidence: DataFrame) -> DataFrame:
    """Names whose evidence was withdrawn lose their verification: a new version of the table."""
    gone = evidence.where("withdrawn").select("evidence_id").distinct().withColumn("_gone", F.lit(True))
    return names.join(gone, "evidence_id", "left").withColumn("verified", F.col("verified") & F.col("_gone").isNull()).drop("_gone").select(*names.columns)


def run_faults(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Guard: completed runs whose records do not add up, or that still hold planned ones. runs: run, status, expected; records: run, disposition."""
    counted = records.groupBy("run").agg(F.count("*").alias("recorded"), F.count_if(F.col("disposition") == "planned").alias("planned"))
    met = runs.where("status = 'completed'").join(counted, "run", "left").fillna(0, ["recorded", "planned"])
    return met.where("recorded <> expected OR planned > 0").select("run", "expected", "recorded", "planned")


def stray_redirects(redirects: DataFrame, operations: DataFrame) -> DataFrame:
    """Guard: redirects without an applied merge of the same ends; must be empty."""
    return redirects.join(operations.where("kind = 'merge' and applied").select("old", "survivor"), ["old", "survivor"], "left_anti")


def readiness(value: Column, verified: Column, machine: Column, exhausted: Column, policy: Column, identity: Column, unique: Column) -> Column:
    """The state of one locale of one entity; the first rule that holds."""
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    return (
        F.when(~identity, "identity_unproven").when(blank & exhausted, "unfillable").when(blank, "missing").when(~policy, "policy_blocked")
        .when(~unique, "ambiguous").when(machine, "machine_only").when(~verified, "unverified").otherwise("ready")
    )


def correction_decision(facts: DataFrame) -> DataFrame:
    """What happens to a submitted correction: the first rule that holds.

    facts: in_flight, prior_verdict, prior_days, new_evidence, valid_charset, corroborated, trusted, blank.
    """
    recent = F.col("prior_verdict").isNotNull() & (F.col("prior_days") <= 30) & ~F.col("new_evidence")
    action = (
        F.when(F.col("in_flight"), "duplicate").when(recent, F.concat(F.lit("reuse_"), F.col("prior_verdict"))).when(~F.col("valid_charset"), "reject_charset")
        .when(F.col("corroborated"), "auto_apply").when(F.col("trusted") & F.col("blank"), "fill_blank").when(F.col("trusted"), "verify").otherwise("queue")
    )
    return facts.withColumn("action", action)


def prior_decisions(rulings: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The latest ruling on each (entity, locale, value) of late, and how many there were."""
    fresh = rulings.where(F.col("resolved_at") >= as_of - F.expr(f"interval {days} days"))
    return fresh.groupBy("entity", "locale", "value").agg(F.max_by("verdict", "resolved_at").alias("verdict"), F.count("*").alias("rulings"))


def work_order(rows: DataFrame, limit: int) -> DataFrame:
    """What to check next: requested first, then unfilled, then the rest; oldest update first."""
    first = F.when(F.col("requested"), 0).when(F.col("unfilled"), 1).otherwise(2)
    return rows.withColumn("turn", first).orderBy("turn", "updated", "id").limit(limit)


def leases(rows: DataFrame, as_of: Column, minutes: int = 10, most: int = 3) -> DataFrame:
    """Queue rows after the reaper: stale leases are freed, spent rows fail, the rest wait twice as long each time."""
    stale = (F.col("status") == "running") & (F.col("leased_at") < as_of - F.expr(f"interval {minutes} minutes"))
    attempts = F.col("attempts") + F.when(stale, 1).otherwise(0)
    status = F.when(stale & (attempts >= most), "failed").when(stale, "pending").otherwise(F.col("status"))
    return rows.select("id", status.alias("status"), attempts.alias("attempts"), F.when(stale, F.pow(F.lit(2), attempts).cast("long")).alias("wait_minutes"))


def claim(rows: DataFrame, workers: int, n: int) -> DataFrame:
    """The n rows each worker takes: pending, most urgent, oldest; dealt by hash so no two workers meet."""
    share = F.pmod(F.xxhash64("id"), F.lit(workers)).cast("int")
    order = Window.partitionBy("worker").orderBy(F.desc("urgent"), "created", "id")
    return rows.where("status = 'pending'").withColumn("worker", share).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
