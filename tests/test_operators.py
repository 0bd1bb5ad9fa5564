"""Operators on small fixtures: rewrites, guards, joins against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexora.operators import fuzzy, matching, quality, resolve
from lexora.operators import relational as R
from lexora.operators.components import connected_components
from lexora.operators.consensus import consensus, vote

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_written_edges(spark, monkeypatch):
    """Edges that are written already are not written again; repeated ones, loops, nulls and none at all included."""
    from lexora.operators import components

    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(df.columns) or cut(df))
    edges = [(5, 2), (5, 2), (2, 9), (4, 4), (None, 1), (8, 7), (7, 9), (20, 21)]
    for own, want in ((edges, {2: 2, 5: 2, 7: 2, 8: 2, 9: 2, 20: 20, 21: 20}), ([], {})):
        written.clear()
        found = connected_components(cut(spark.createDataFrame(own, "src long, dst long")))
        assert {r["node"]: r["component"] for r in found.collect()} == want
        assert written[0] == ["u", "r"]


def test_one_page_under_three_media_is_no_consensus(spark):
    schema = "entity long, locale string, spelling string, norm string, parent long, page string, trust double, confidence double, observed_at timestamp, domain string"
    base = [(1, "en", "A", "a", p, "same", 1.0, 0.9, T0, "d") for p in (1, 2, 3)]
    as_of = F.lit(T0 + dt.timedelta(days=1))
    assert consensus(spark.createDataFrame(base, schema), as_of).count() == 0
    assert consensus(spark.createDataFrame([*base, (1, "en", "A", "a", 4, "other", 1.0, 0.9, T0, "d")], schema), as_of).count() == 1
    assert consensus(spark.createDataFrame([], schema), as_of).count() == 0
    unsure = spark.createDataFrame([*base, (1, "en", "A", "a", 4, "other", 1.0, None, T0, "d")], schema)
    assert consensus(unsure, as_of).count() == 0
    old = [(1, "en", "old", "a", 1, "p", 1.0, 0.9, T0 - dt.timedelta(days=200), "d")] * 9
    good = spark.createDataFrame([*base, *old, (1, "en", "A", "a", None, "", 1.0, 0.9, T0, "e"), (1, "en", "A", "a", None, None, 1.0, 0.9, T0, "f")], schema)
    won = consensus(good, as_of).first()
    assert (won["spelling"], won["parents"], won["pages"]) == ("A", 5, 3)
    hangul = spark.createDataFrame([(1, "en", "가", "가", p, f"p{p}", 1.0, 0.9, T0, "d") for p in (1, 2)], schema)
    assert consensus(hangul, as_of).count() == 0
    held = lambda source, locked: spark.createDataFrame([(1, "en", "B", source, locked)], "entity long, locale string, value string, source string, locked boolean")
    assert consensus(good, as_of, stored=held("llm-provisional", False)).count() == 1
    assert consensus(good, as_of, stored=held("operator", False)).count() == consensus(good, as_of, stored=held("llm-provisional", True)).count() == 0


def test_gram_join_against_brute_force(spark):
    random.seed(4)
    names = sorted({"".join(random.choice("ab c") for _ in range(random.randint(1, 9))).strip() for _ in range(150)} - {""})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for n in (None, 2):
        got = rows(fuzzy.gram_join(df.select(F.col("n").alias("lid"), F.col("n").alias("lname")), df.select(F.col("n").alias("rid"), F.col("n").alias("rname")), 0.6, n=n).select("lid", "rid"))

        def grams(s):
            if n:
                return {s} if len(s) < n else {s[i:i + n] for i in range(len(s) - n + 1)}
            return {p[i:i + 3] for w in s.split() for p in [f"  {w} "] for i in range(len(p) - 2)}

        want = sorted((a, b) for a in names for b in names if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6)
        assert got == want


MENTIONS = ["아이유", "아이유가", "서울", "Red Velvet", "뷔", "온다", "사랑", "사랑이 온다", "정", "방탄소년단", "Zico", "BTS", "이름 없음"]


@pytest.mark.parametrize("most", [1000, 0])
def test_match_texts(spark, most):
    """An automaton, and the join for any dictionary, find what the predicate finds on all pairs."""
    draw = random.Random(5)
    pieces = [*MENTIONS, "은", "가", "에서", " ", "나라", "x", "한", ",", "이", "랑"]
    made = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 9))) for _ in range(150)]
    texts = spark.createDataFrame(list(enumerate(["오늘 아이유가 서울에 왔다", "한아이유나라", "아이유는", "아이유나", None, "", *made])), "text_id long, text string")
    names = spark.createDataFrame(list(enumerate([*MENTIONS, "아이유"], 10)), "id long, n string")
    want = rows(texts.crossJoin(names).where(matching.boundary(F.col("text"), F.col("n"))).select("text_id", "id", F.length("n")))
    got = matching.match_texts(texts, names, "text", "text_id", "n", "id", limit=None, most=most)
    assert rows(got.select("text_id", "id", "fragment")) == want and {(0, 10), (0, 12), (2, 10)} <= {r[:2] for r in want} and not any(r[0] in (1, 3) for r in want)
    assert matching.match_texts(texts, names.where("false"), "text", "text_id", "n", "id", most=most).count() == 0


def test_alias_cascade(spark):
    hints = spark.createDataFrame([("유퀴즈",), ("Red-Velvet",)], "hint string")
    names = spark.createDataFrame([(1, "유 퀴즈 온 더 블럭"), (2, "red velvet"), (3, "Red Velvets")], "id long, name string")
    got = {(r["hint"], r["id"], r["how"]) for r in fuzzy.alias_cascade(hints, names).collect()}
    assert ("유퀴즈", 1, "abbreviation") in got and ("Red-Velvet", 2, "alias") in got and ("Red-Velvet", 3, "similar") in got


def test_homonyms(spark):
    schema = "a struct<agency:string,birth_year:int,role:string,works:array<string>>, b struct<agency:string,birth_year:int,role:string,works:array<string>>, conflict boolean"
    none = ("", 0, "", [])
    cases = [
        (none, none, False), (("YG", 0, "", []), ("SM", 0, "", []), True), (("YG", 0, "", []), ("yg", 0, "", []), False), (("YG", 0, "", []), none, False),
        (("", 1980, "", []), ("", 1990, "", []), True), (("", 0, "director", []), ("", 0, "singer", []), True), (("", 0, "other", []), ("", 0, "singer", []), False),
        (("", 0, "", ["x"]), ("", 0, "", ["y"]), True), (("", 0, "", ["x", "y"]), ("", 0, "", ["Y "]), False), ((None, None, None, None), ("YG", 1, "a", ["x"]), False),
    ]
    out = spark.createDataFrame(cases, schema).select("conflict", resolve.conflict("a", "b").alias("got")).collect()
    assert all(r["conflict"] == r["got"] for r in out)


def test_redirect_chains(spark):
    redirects = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old string, survivor string")
    flat = resolve.flatten_redirects(redirects)
    assert rows(flat) == [("a", "c"), ("b", "c"), ("x", "y")]
    moved = resolve.apply_redirects(spark.createDataFrame([("a", 1), ("q", 2)], "id string, n long"), flat, "id")
    assert rows(moved) == [("c", 1), ("q", 2)]


def test_merge_plan_and_gate(spark):
    plan = spark.createDataFrame([("a", "distinct", None), ("b", "same", "a"), ("c", "same", "b"), ("c", "same", "b"), ("z", "distinct", None)], "id string, verdict string, same_as string")
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(resolve.plan_faults(plan, members)) == [("c", "repeated"), ("c", "survivor_not_distinct"), ("z", "outside")]
    winners = spark.createDataFrame([("1", "A", ["B"])], "id string, name string, aliases array<string>")
    losers = spark.createDataFrame([("1", "C", ["A", "D"])], "id string, name string, aliases array<string>")
    assert resolve.merge_names(winners, losers).first()["aliases"] == ["B", "C", "D"]


def test_overlaps_meet_in_stretches(spark):
    draw, day = random.Random(3), dt.timedelta(days=1)
    spans = [(i, i % 3, T0 + draw.randrange(400) * day) for i in range(90)]
    spans = [(i, k, s, s + draw.choice([-1, 0, 3, 40, 200]) * day) for i, k, s in spans]
    got = rows(R.overlaps(spark.createDataFrame(spans, "id long, k long, s timestamp, e timestamp"), ["k"], "s", "e", "id"))
    assert got == sorted((k, i, j) for i, k, s, e in spans for j, q, t, u in spans if k == q and i < j and s <= e and t <= u and s <= u and t <= e)


def test_running_sum(spark):
    got = R.running_sum(spark.createDataFrame([(f"t{i:03}",) for i in range(100)], "t string").repartition(4), "t", F.length("t"), "s").orderBy("t").collect()
    assert [r["s"] for r in got] == [4 * (i + 1) for i in range(100)]


def test_surrogate_ids_are_consecutive(spark):
    df = spark.createDataFrame([(random.Random(i).random(),) for i in range(500)], "v double")
    got = [r["n"] for r in R.surrogate_ids(df, ["v"], "n").orderBy("v").collect()]
    assert got == list(range(1, 501))


def test_overlap_window_equals_pairs(spark):
    random.seed(5)
    df = spark.createDataFrame([(i, i % 5, s := random.randrange(100), s + random.randrange(8)) for i in range(60)], "id long, k long, s long, e long")
    later = {r["b"] if True else None for r in R.overlaps(df, ["k"], "s", "e", "id").collect()} | {r["a"] for r in R.overlaps(df, ["k"], "s", "e", "id").collect()}
    assert {r["id"] for r in R.has_overlap(df, ["k"], "s", "e").collect()} <= later


def test_guards(spark):
    names = spark.createDataFrame([("n1", True, "e1"), ("n2", True, "e2"), ("n3", False, None)], "name string, verified boolean, evidence_id string")
    evidence = spark.createDataFrame([("e1", True, True, False), ("e2", True, False, True)], "evidence_id string, verified boolean, exportable boolean, withdrawn boolean")
    assert [r["name"] for r in quality.unverified_names(names, evidence).collect()] == ["n2"]
    assert {r["name"]: r["verified"] for r in quality.withdraw(names, evidence).collect()} == {"n1": True, "n2": False, "n3": False}
    runs = spark.createDataFrame([("r1", "completed", 2), ("r2", "completed", 1), ("r3", "open", 9)], "run string, status string, expected long")
    records = spark.createDataFrame([("r1", "done"), ("r1", "planned"), ("r2", "done")], "run string, disposition string")
    assert [r["run"] for r in quality.run_faults(runs, records).collect()] == ["r1"]


def test_votes(spark):
    votes = spark.createDataFrame([(1, "A"), (1, "A"), (1, "A"), (2, "B"), (2, "C"), (3, "D"), (3, "D")], "id long, form string")
    texts = spark.createDataFrame([(1, "said a here"), (3, "none")], "id long, text string")
    got = {r["id"]: (r["form"], r["accepted"], r["strong"]) for r in vote(votes, texts).collect()}
    assert got == {1: ("A", True, True), 2: ("B", False, False), 3: ("D", True, False)}


def test_snapshot_import_is_idempotent(spark):
    from lexora.sources.sinks import import_bindings

    current = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, v string")
    batch = spark.createDataFrame([("b", "3"), ("c", "4")], "id string, v string")
    changes, new = import_bindings(current, batch, ["id"], ["v"])
    assert rows(changes) == [("insert", 1), ("update", 1)] and rows(new) == [("a", "1"), ("b", "3"), ("c", "4")]
    again, _ = import_bindings(new, batch, ["id"], ["v"])
    assert rows(again) == [("unchanged", 2)]


def test_cascade(spark):
    target = spark.createDataFrame([(1, None), (2, "own"), (3, None)], "id long, en string")
    layers = [("music", spark.createDataFrame([(1, "m")], "id long, en string")), ("film", spark.createDataFrame([(1, "f"), (3, "g")], "id long, en string"))]
    assert rows(resolve.cascade(target, layers, "id", ["en"])) == [(1, "m", "music"), (2, "own", "own"), (3, "g", "film")]


def test_facade(spark):
    from lexora.plans.api import Catalogue

    e = spark.createDataFrame([(1, "Red Velvet", "group", "active", 0.9, False, ["RV"], T0, "Red Velvet", "tmdb"), (2, "Red Velvet", "song_album", "active", 0.8, True, [], T0, None, None)], "id long, name string, type string, status string, confidence double, locked boolean, names array<string>, updated_at timestamp, canonical_en string, canonical_en_source string")
    c = Catalogue(e)
    assert [r["id"] for r in c.list("rv").collect()] == [1]
    assert c.lookup(spark.createDataFrame([("red velvet",), ("none",)], "term string")).orderBy("term").collect()[1]["status"] == "ambiguous"
    assert c.patch(spark.createDataFrame([(1, "x"), (2, "y")], "id long, canonical_en string"), ["canonical_en"]).orderBy("id").select("canonical_en").collect() == [("x",), (None,)]
    assert c.spellings().count() == 3
    matched = c.match(spark.createDataFrame([(7, "we saw Red Velvet")], "text_id long, text string")).collect()
    assert len(matched) == 2 and all(r["ambiguous"] for r in matched)
