"""Queries use every row of their tables."""

import datetime

from lexora.plans import catalogue


def run(spark, tmp_path, name, **tables):
    """Rows of a query over small tables; tables: (schema, rows)."""
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{table}.parquet"))
    return sorted((tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()), key=str)


PART = "p_partkey long, p_name string, p_type string, p_brand string, p_size long, p_retailprice double"


def test_components(spark, tmp_path):
    rows = [(k, f"name{k * 7 % 90}", f"type{k % 2}", f"brand{k % 23}", k * k % 31, 1.0) for k in range(150, 450)]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for n, a in enumerate(rows):
        for b in rows[:n]:
            if a[1:3] == b[1:3] or a[3:5] == b[3:5]:
                linked |= {a[0], b[0]}
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    assert run(spark, tmp_path, "components", part=(PART, rows)) == sorted(((k, find(k)) for k in linked), key=str)
    assert max(linked) > 300


def test_exact_picker(spark, tmp_path):
    rows = [(199, "low", "t", "b", 1, 1.0), (200, "high", "t", "b", 1, 2.0), (9001, "higher", "t", "b", 1, 2.0)]
    got = run(spark, tmp_path, "exact_picker", part=(PART, rows))
    assert [(r[0], r[2]) for r in got] == [("high", 200), ("higher", 9001), ("low", 199)]


def test_extraction_votes(spark, tmp_path):
    rows = [(0, 1, "view"), (10, 1, "click"), (11, 1, "click"), (20, 2, "error")]
    got = run(spark, tmp_path, "extraction_votes", events=("event_id long, user_id long, event_type string", rows))
    assert got == [(1, "click", 2, True), (2, "error", 1, False)]


def test_references_of_all_lines(spark, tmp_path):
    lines = ("l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_linenumber long, l_quantity double", [(1, 1, 1, "A", 1, 5.0), (1, 1, 7, "A", 2, 50.0), (2, 2, 1, "A", 7, 50.0), (2, 3, 39, "A", 3, 1.0)])
    tables = {"lineitem": lines, "supplier": ("s_suppkey long, s_nationkey long", [(1, 4), (2, 4), (3, 5)])}
    assert run(spark, tmp_path, "quorum_identity", **tables) == [(1, 1)]
    assert run(spark, tmp_path, "provider_conflict_pairs", **tables) == [(1, 2, 1, 1)]
    columns = ["provider", "external_id", "entity", "accepted"]
    refs = catalogue.queries()["reserved_ids"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, refs)) == [("A", 1, 1, True), ("A", 1, 2, False), ("A", 7, 1, True), ("A", 39, 3, True)]
    assert run(spark, tmp_path, "relation_both_ways", **tables) == [(1, "A", "in", 1, 2), (1, "A", "out", 1, 7), (2, "A", "out", 1, 1), (3, "A", "out", 1, 39), (39, "A", "in", 1, 3), (7, "A", "in", 1, 1)]


def test_claims_of_all_parts(spark, tmp_path):
    rows = [(3, "one", "t", "x", 1, 1.0), (5, "one", "t", "y", 2, 1.0), (8, "two", "t", "z", 3, 1.0)]
    assert run(spark, tmp_path, "name_split_audit", part=(PART, rows)) == [("one", "x", "y")]
    assert run(spark, tmp_path, "sole_alias_owner", part=(PART, rows)) == [("one2", "y"), ("two3", "z")]


def test_queue_and_entities_of_all_rows(spark, tmp_path):
    day = datetime.datetime(2000, 1, 1)
    tables = {
        "customer": ("c_custkey long, c_acctbal double", [(950, 5.0), (1001, -5.0), (1110, -5.0), (1199, 1.0)]),
        "orders": ("o_orderkey long, o_custkey long", [(7, 110), (9, 599)]),
        "lineitem": ("l_orderkey long, l_returnflag string, l_shipdate timestamp_ntz", [(9, "A", datetime.datetime(2001, 6, 1)), (7, "A", day)]),
    }
    # Names 350 (950 % 600), 401, 510 and 599 are asked for; 950, 1001, 1110 and 1199 hold 150, 201, 310 and 399.
    got = run(spark, tmp_path, "readiness_funnel", **tables)
    assert dict(got) == {"unknown": 4}
    tables["customer"] = ("c_custkey long, c_acctbal double", [(1200, 5.0), (1310, 1.0), (1310, -1.0)])
    assert dict(run(spark, tmp_path, "readiness_funnel", **tables)) == {"served": 1, "partly": 1}
    assert run(spark, tmp_path, "retry_gate", **tables) == [(110, 7)]


def test_text_match_docs_has_no_limit(spark, tmp_path):
    words = [f"word{i}x" for i in range(1200)]
    tables = {"documents": ("doc_id long, text string", [(1, " ".join(words))]), "benchmark": ("item_id long, text string", list(enumerate(words)))}
    assert len(run(spark, tmp_path, "text_match_docs", **tables)) == 1200
