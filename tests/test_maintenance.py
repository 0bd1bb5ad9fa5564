"""Rows kept up to date: only touched ones are written."""

import datetime as dt

from pyspark.sql import functions as F

from lexora.operators import gate
from lexora.operators import maintenance as M

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
LEGACY = "id string, type string, name string, status string, locked boolean, qualifier string"
PROJECTED = "id string, type string, subtype string, name string, origin string, write_owner string, status string, locked boolean, qualifier string, revision long, updated_at timestamp"


def test_projection(spark):
    before = [(i, "drama", "n", "active", False, None) for i in ("same", "named", "typed", "gone", "taken", "theirs", "lockt", "goneX", "blank", "unknown")]
    after = [
        ("same", "drama", "n", "active", False, " "), ("named", "drama", "m", "active", False, None), ("typed", "person", "n", "merged", False, "q "), ("taken", "drama", "x", "active", False, None),
        ("theirs", "drama", "x", "active", False, None), ("lockt", "drama", "n", "active", True, None), ("blank", "drama", "n", "active", None, ""), ("fresh", "term", None, "odd", None, None), ("unknown", "drama", "z", "active", False, None),
    ]
    held = lambda i, origin="legacy", owner="legacy": (i, "work", "film", "n", origin, owner, "active", False, None, 4, T0)
    projected = [held(i) for i in ("same", "named", "typed", "gone", "blank")] + [held("taken", "other"), held("theirs", owner="them"), held("lockt", owner="them"), held("goneX", owner="them"), held("alone", "other", "other")]
    table, faults = M.sync_projection(spark.createDataFrame(projected, PROJECTED), spark.createDataFrame(before, LEGACY), spark.createDataFrame(after, LEGACY), F.lit(T1))
    assert [tuple(r) for r in faults.collect()] == [("taken", "other")]
    got = {r["id"]: (r["type"], r["subtype"], r["name"], r["write_owner"], r["status"], r["locked"], r["qualifier"], r["revision"], r["updated_at"]) for r in table.collect()}
    kept = lambda owner="legacy": ("work", "film", "n", owner, "active", False, None, 4, T0)
    assert got == {
        "same": kept(), "blank": kept(), "taken": kept(), "theirs": kept("them"), "goneX": kept("them"), "alone": kept("other"), "named": ("work", "film", "m", "legacy", "active", False, None, 5, T1),
        "typed": ("person", None, "n", "legacy", "retired", False, "q", 5, T1), "gone": ("work", "film", "n", "legacy", "retired", False, None, 5, T1), "lockt": ("work", "film", "n", "them", "active", True, None, 5, T1),
        "fresh": ("concept", None, None, "legacy", "retired", False, None, 1, T1), "unknown": ("work", None, "z", "legacy", "active", False, None, 1, T1),
    }
    assert table.dtypes == spark.createDataFrame(projected, PROJECTED).dtypes


def test_hashes_of_touched_parents(spark):
    parents = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, None, "old")], "id long, name string, input_hash string")
    one, two = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "w")], "id long, v string"), spark.createDataFrame([(1, 5)], "id long, n int")
    touched = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "id long")
    refresh = lambda first: {r["id"]: r["input_hash"] for r in M.refresh_hashes(parents, touched, "id", ["id", "name"], [(first, ["v"]), (two, ["n"])]).collect()}
    got = refresh(one)
    assert got[2] == "old" and "old" not in (got[1], got[3])
    assert refresh(one.orderBy(F.desc("v"))) == got
    assert refresh(one.where("v <> 'y' or v is null"))[1] != got[1] and refresh(one.where("v <> 'y'"))[3] == got[3]
    whole = {r["id"]: r["input_hash"] for r in M.input_hashes(parents, "id", ["id", "name"], [(one, ["v"]), (two, ["n"])]).collect()}
    assert (got[1], got[3]) == (whole[1], whole[3])


def test_types_from_evidence(spark):
    rows = [
        ("asked", " Drama ", "소비자 type힌트=movie", ["Q1"], "가수"), ("noted", "odd", "a 소비자 type힌트=movie b", ["Q1"], "가수"), ("claim", None, "소비자 type힌트=odd", [None, "Q9", "Q1"], "가수"),
        ("cue", "", None, None, "영화 드라마 개봉"), ("tie", "", "", [], "드라마 앨범"), ("none", None, None, [], None),
    ]
    df = spark.createDataFrame(rows, "id string, asked string, notes string, classes array<string>, text string")
    found = gate.type_from_evidence(F.col("asked"), F.col("notes"), F.col("classes"), {"Q1": "school"}, F.col("text"))
    got = {r["id"]: tuple(r["f"]) for r in df.select("id", found.alias("f")).collect()}
    assert got == {
        "asked": ("drama", 0.8, "consumer-type", "requested"), "noted": ("movie", 0.75, "consumer-type", "noted"), "claim": ("school", 0.85, "wikidata-p31", "Q1"), "cue": ("movie", 0.55, "context-cue", "cue"),
        "tie": ("drama", 0.55, "context-cue", "cue"), "none": ("unknown", 0.0, "", ""),
    }
