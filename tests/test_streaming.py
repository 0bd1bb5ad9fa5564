"""Streams agree with batch runs over the same rows."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from lexora.operators.consensus import ConsensusRule, sweep
from lexora.sources.tables import observations
from lexora.streaming import pipeline as P

T0 = dt.datetime(2024, 1, 1)


def _write(spark, path, rows, schema, files=3):
    for i in range(files):
        part = rows[i::files] if files > 1 else rows
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_consensus_stream_equals_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    obs = observations(spark, sf_dir)
    obs.coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    rule = ConsensusRule(change_minutes=60 * 24 * 40)
    each = P.ConsensusStream(str(tmp_path / "state"), rule)
    P.run_available(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), each).awaitTermination(120)
    got = spark.read.parquet(each.promoted).select("entity", "locale", "norm")
    newest = F.lit(obs.agg(F.max("observed_at")).first()[0]).cast("timestamp_ntz")
    nothing = spark.createDataFrame([], "entity long, locale string, promoted_at timestamp_ntz")
    want = sweep(obs, nothing, newest, rule).select("entity", "locale", "norm")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_consensus_stream_begins_empty(spark, sf_dir, tmp_path):
    """A first batch without rows, or without promotions, leaves a table that the next one reads."""
    obs = observations(spark, sf_dir)
    each = P.ConsensusStream(str(tmp_path), ConsensusRule(change_minutes=60 * 24 * 40))
    each(obs.where("false"), 0)
    each(obs, 1)
    each(obs.limit(5), 2)
    assert spark.read.parquet(each.promoted).where("batch = 1").count() > 0


def _drain(spark, stream, tmp_path, name):
    out = str(tmp_path / f"out-{name}")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out)


def test_once_per_key(spark, tmp_path):
    rows = [(i % 7, T0 + dt.timedelta(seconds=i)) for i in range(50)]
    _write(spark, str(tmp_path / "in"), rows, "id long, at timestamp")
    stream = P.file_stream(spark, str(tmp_path / "in"), "id long, at timestamp", 1)
    assert sorted(r["id"] for r in _drain(spark, P.once_per_key(stream, ["id"], "at"), tmp_path, "once").collect()) == list(range(7))


def test_cooldown(spark, tmp_path):
    hours = [0, 10, 47, 48, 60, 100]
    rows = [(1, "en", T0 + dt.timedelta(hours=h)) for h in hours] + [(2, "en", T0)]
    _write(spark, str(tmp_path / "in"), rows, "entity long, locale string, promoted_at timestamp", 1)
    stream = P.file_stream(spark, str(tmp_path / "in"), "entity long, locale string, promoted_at timestamp").withWatermark("promoted_at", "1 hour")
    got = sorted((r["entity"], r["promoted_at"]) for r in _drain(spark, P.cooldown(stream), tmp_path, "cool").collect())
    assert got == [(1, T0), (1, T0 + dt.timedelta(hours=48)), (1, T0 + dt.timedelta(hours=100)), (2, T0)]


def test_incidents(spark, tmp_path):
    oks = [True, False, False, False, False, True, False, True]
    rows = [("r", ok, T0 + dt.timedelta(minutes=i)) for i, ok in enumerate(oks)]
    _write(spark, str(tmp_path / "in"), rows, "role string, ok boolean, at timestamp", 1)
    stream = P.file_stream(spark, str(tmp_path / "in"), "role string, ok boolean, at timestamp")
    got = [(r["event"], r["failures"]) for r in _drain(spark, P.incidents(stream), tmp_path, "inc").orderBy("at").collect()]
    assert got == [("opened", 3), ("recovered", 4)]


def test_buffer_and_feed(spark):
    schema = "domain string, link string, status string, state string, retries int, fetched_at timestamp"
    buffer = spark.createDataFrame([("d", "1", "hit", "pending", 0, T0), ("d", "2", "hit", "pending", 3, T0), ("d", "3", "miss", "pending", 0, T0)], schema)
    assert [r["link"] for r in P.take_pending(buffer).collect()] == ["1"]
    after = P.settle(buffer, spark.createDataFrame([("d", "1", False)], "domain string, link string, ok boolean"))
    assert {r["link"]: (r["state"], r["retries"]) for r in after.collect()}["1"] == ("pending", 1)
    outbox = spark.createDataFrame([(1, "a", T0), (2, "b", T0), (3, "a", T0 + dt.timedelta(1))], "id long, entity string, at timestamp")
    assert [(r["entity"], r["id"]) for r in P.change_feed(outbox, (F.lit(T0), 0), 10).collect()] == [("b", 2), ("a", 3)]


def test_supervisor(spark):
    left = [5]

    def step(chosen):
        left[0] -= 2
        return chosen

    out = P.Supervisor().run(lambda n: spark.range(3), step, lambda: left[0])
    assert out["ok"] and out["leaks"] == 0 and out["after"] == 3
    lost = P.Supervisor(retries=0).run(lambda n: spark.range(3), lambda c: c.where("id > 0"), lambda: 0)
    assert not lost["ok"]


def test_windowed_counts(spark, tmp_path):
    rows = [(i % 2, T0 + dt.timedelta(seconds=20 * i)) for i in range(12)] + [(9, T0 + dt.timedelta(days=1))]
    _write(spark, str(tmp_path / "in"), rows, "k long, at timestamp", 1)
    stream = P.file_stream(spark, str(tmp_path / "in"), "k long, at timestamp")
    got = _drain(spark, P.windowed_counts(stream, "k", "at", "1 minute"), tmp_path, "win")
    want = pd.Series(rows[:-1]).map(lambda r: (r[1].replace(second=0), r[0])).value_counts().to_dict()
    assert {(r["start"], r["k"]): r["n"] for r in got.collect() if r["k"] != 9} == want
