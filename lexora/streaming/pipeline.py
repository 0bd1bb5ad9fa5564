"""The time-driven pipeline as Structured Streaming: buffer, sweep, consensus, cooldown, incidents.

Every stateful step has a bound on its state: a watermark, a time to live, or a key's fixed-size
record. Batch operators do the work inside ``foreachBatch``, so a stream and a batch run agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, LongType, StructField, StructType

from lexora.operators.consensus import ConsensusRule, sweep


def file_stream(spark: SparkSession, path: str, schema: str, most_files: int = 16) -> DataFrame:
    """Parquet files as they arrive, at most so many a trigger: the back-pressure of every lane."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work through all there is, in batches, and stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_every(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], interval: str) -> StreamingQuery:
    """One query a cadence; a restart goes on from its checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def once_per_key(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: idempotent inserts and one trigger an hour for each entity."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, key: str, at: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of each key in tumbling or sliding windows, late rows within the watermark included."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def take_pending(buffer: DataFrame, n: int = 30, retries: int = 3) -> DataFrame:
    """The oldest pending hits with retries left: one sweep's batch."""
    return buffer.where((F.col("status") == "hit") & (F.col("state") == "pending") & (F.col("retries") < retries)).orderBy("fetched_at", "domain", "link").limit(n)


def settle(buffer: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The buffer after a sweep: done rows are done, failed ones wait with one more retry. outcomes: domain, link, ok."""
    met = buffer.join(outcomes.select("domain", "link", "ok"), ["domain", "link"], "left")
    state = F.when(F.col("ok"), "done").otherwise(F.col("state"))
    return met.withColumn("state", state).withColumn("retries", F.col("retries") + F.when(~F.col("ok"), 1).otherwise(0)).drop("ok").select(*buffer.columns)


class ConsensusStream:
    """Keeps an observation log and promotions as Parquet and evaluates changed pairs batch by batch."""

    def __init__(self, root: str, rule: ConsensusRule = ConsensusRule()):
        self.log, self.promoted, self.rule = f"{root}/log", f"{root}/promoted", rule

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Appends a batch, then promotes: written under the batch's number, so a repeated batch replaces itself.

        The log is partitioned by day, and only the days of the window are read.
        """
        spark = batch.sparkSession
        batch.withColumn("day", F.to_date("observed_at")).write.mode("overwrite").partitionBy("day").parquet(f"{self.log}/batch={batch_id}")
        newest = batch.agg(F.max("observed_at").alias("t")).first()["t"]
        schema = "entity long, locale string, promoted_at timestamp_ntz"
        won = spark.createDataFrame([], f"{schema}, norm string")
        if newest is not None:
            as_of = F.lit(newest).cast("timestamp_ntz")
            since = F.date_sub(F.to_date(as_of), self.rule.days + 1)
            log = spark.read.schema(StructType([*batch.schema.fields, StructField("day", DateType()), StructField("batch", LongType())])).option("basePath", self.log).parquet(self.log)
            log = log.where((F.col("batch") <= batch_id) & (F.col("day") >= since)).drop("batch", "day")
            promoted = spark.createDataFrame([], schema)
            if batch_id:
                kept = spark.read.schema(f"{schema}, batch long").option("basePath", self.promoted).parquet(self.promoted)
                promoted = kept.where(F.col("batch") < batch_id).drop("batch")
            won = sweep(log, promoted, as_of, self.rule).withColumn("promoted_at", as_of)
        won.write.mode("overwrite").parquet(f"{self.promoted}/batch={batch_id}")


_COOLING = "entity long, locale string, promoted_at timestamp"


def cooldown(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Promotions that no promotion of the pair precedes by less than the cooldown. State: one time a pair, dropped when it ends.

    stream: entity, locale, promoted_at, with a watermark on promoted_at.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for t in sorted(pd.concat([b["promoted_at"] for b in batches])):
            if last is None or t - last >= pd.Timedelta(hours=hours):
                last = t
                out.append(t)
        if last is not None:
            state.update((last.value // 1000,))
            ends = last.value // 1_000_000 + hours * 3_600_000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"entity": [key[0]] * len(out), "locale": [key[1]] * len(out), "promoted_at": out})

    return stream.groupBy("entity", "locale").applyInPandasWithState(run, _COOLING, "last long", "append", GroupStateTimeout.EventTimeTimeout)


_INCIDENT = "role string, event string, failures int, at timestamp"


def incidents(stream: DataFrame, opens: int = 3) -> DataFrame:
    """Opened and recovered incidents of each role: so many failures in a row open one, the first success closes it.

    stream: role, ok, at. State: a count and a flag a role.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, is_open = state.get if state.exists else (0, False)
        out = []
        for ok, at in pd.concat(list(batches)).sort_values("at")[["ok", "at"]].itertuples(index=False):
            if ok:
                if is_open:
                    out.append((key[0], "recovered", failures, at))
                failures, is_open = 0, False
            else:
                failures += 1
                if failures >= opens and not is_open:
                    is_open = True
                    out.append((key[0], "opened", failures, at))
        state.update((int(failures), bool(is_open)))
        yield pd.DataFrame(out, columns=["role", "event", "failures", "at"])

    return stream.groupBy("role").applyInPandasWithState(run, _INCIDENT, "failures int, open boolean", "append", GroupStateTimeout.NoTimeout)


def change_feed(outbox: DataFrame, cursor: tuple, n: int) -> DataFrame:
    """Invalidations behind a cursor (at, id): latest per entity, one more row than a page."""
    behind = outbox.where((F.col("at") > cursor[0]) | ((F.col("at") == cursor[0]) & (F.col("id") > cursor[1])))
    latest = Window.partitionBy("entity").orderBy(F.desc("at"), F.desc("id"))
    return behind.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n").orderBy("at", "id").limit(n + 1)


def reconcile(stored: DataFrame, computed: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Stored states that a recomputation contradicts."""
    new = computed.select(*keys, F.col("state").alias("now"))
    return stored.join(new, keys).where(~F.col("state").eqNullSafe(F.col("now"))).orderBy(*keys).limit(limit)


def cycle_audit(batch_id: int, batch: DataFrame) -> DataFrame:
    """One row of counts for a cycle."""
    return batch.agg(F.lit(batch_id).alias("cycle"), F.count("*").alias("items"), F.count_if(F.col("status") == "hit").alias("hits"), F.count_distinct("domain").alias("feeds"))


class Supervisor:
    """Runs a step: select, measure, run, check that nothing leaked, measure again, and retry while it made no headway."""

    def __init__(self, budget: int = 20, retries: int = 2, empty_retries: int = 1):
        self.budget, self.retries, self.empty_retries = budget, retries, empty_retries

    def run(self, select: Callable[[int], DataFrame], step: Callable[[DataFrame], DataFrame], measure: Callable[[], int], key: str = "id") -> dict:
        """The outcome with what was selected, reported, leaked, and the measure before and after."""
        from lexora.operators.quality import conservation

        before, error = measure(), None
        for attempt in range(1 + self.retries):
            chosen = select(self.budget)
            try:
                reported = step(chosen)
                leaks = conservation(chosen, reported, key).count()
            except Exception as failure:  # a step may be any code; its failure is this method's result
                error = repr(failure)
                continue
            after = measure()
            if after >= before and attempt < self.empty_retries:
                continue
            return {"ok": leaks == 0, "attempts": attempt + 1, "selected": chosen.count(), "reported": reported.count(), "leaks": leaks, "before": before, "after": after}
        return {"ok": False, "attempts": 1 + self.retries, "error": error, "before": before, "after": measure()}
