"""Stored preparations against a plain state machine."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexora.operators import preparations as P

AT = dt.datetime(2024, 1, 1)
STATES = "id string, ordinal int, locale string, state string, value string, reason string, observed_at timestamp"


def request(arrival, owner="o", key="k", catalog=None, terms=(("a", None, None, None),), locales=None, url=None, article=None):
    return (arrival, owner, key, catalog, list(terms), locales, url, article, None)


def test_faults(spark):
    term = ("a", None, None, None)
    cases = {
        None: request(0), "catalog": request(1, catalog="other"), "terms": request(2, terms=()), "locale": request(3, locales=["en", "xx"]), "term": request(4, terms=[term, (" ", None, None, None)]),
        "metadata": request(5, url="u" * 2049), "owner": request(6, owner=None), "key": request(7, key="k" * 201),
    }
    got = {r["arrival"]: r["fault"] for r in P.normalized(spark.createDataFrame(list(cases.values()), P.REQUEST)).collect()}
    assert got == {row[0]: fault for fault, row in cases.items()}
    more = [request(0, terms=[term] * 201), request(1, terms=[("가" * 200, "t" * 50, "c" * 2000, None)]), request(2, terms=[("가" * 201, None, None, None)]), request(3, terms=[("a", None, None, "no-uuid")]), request(4, terms=[("a", None, None, "0" * 8 + "-0000-0000-0000-" + "0" * 12)]), request(5, terms=[None])]
    got = {r["arrival"]: r["fault"] for r in P.normalized(spark.createDataFrame(more, P.REQUEST)).collect()}
    assert got == {0: "terms", 1: None, 2: "term", 3: "term", 4: "term", 5: "term"}


def test_locales_and_digest(spark):
    rows = [request(0, locales=["zh-TW", " EN ", "zh_hant", "pt-BR"]), request(1, locales=[]), request(2, catalog="common", locales=["zh-TW", "pt_br", "ko"]), request(3, terms=[(" a ", "", "", None)], locales=["en"]), request(4, terms=[("a", None, "c", None)])]
    got = {r["arrival"]: r for r in P.normalized(spark.createDataFrame(rows, P.REQUEST)).collect()}
    assert [got[i]["locales"] for i in range(3)] == [["en", "pt_br", "zh_hant"], ["en"], ["ko", "pt-BR", "zh-TW"]]
    assert got[1]["digest"] == got[3]["digest"] != got[4]["digest"]


def test_create_once(spark):
    empty = spark.createDataFrame([], P.PREPARATION)
    batch = [request(2, key="k"), request(1, key="k", terms=[("b", None, None, None), ("c", None, None, None)], locales=["zh-tw", "en"]), request(3, key="k", terms=[("b", None, None, None), ("c", None, None, None)], locales=["en", "zh_hant"]), request(4, key=""), request(5, key=None), request(6, owner="p", key="k"), request(7, terms=())]
    made = P.create(empty, spark.createDataFrame(batch, P.REQUEST), F.lit(AT))
    answers = {r["arrival"]: (r["outcome"], r["id"]) for r in made.answers.collect()}
    assert {a: o for a, (o, _) in answers.items()} == {1: "created", 2: "conflict", 3: "replayed", 4: "created", 5: "created", 6: "created", 7: "invalid_terms"}
    assert answers[3][1] == answers[1][1] and len({answers[a][1] for a in (1, 4, 5, 6)}) == 4 and answers[2][1] is None
    assert made.preparations.dtypes == empty.dtypes and made.preparations.count() == 4
    assert {(r["ordinal"], r["term"]) for r in made.items.where(F.col("id") == answers[1][1]).collect()} == {(0, "b"), (1, "c")}
    assert {(r["ordinal"], r["locale"]) for r in made.states.where(F.col("id") == answers[1][1]).collect()} == {(0, "en"), (0, "zh-Hant"), (1, "en"), (1, "zh-Hant")}
    again = P.create(made.preparations, spark.createDataFrame([request(9, key="k"), request(10, owner="p", key="k")], P.REQUEST), F.lit(AT))
    assert {r["arrival"]: r["outcome"] for r in again.answers.collect()} == {9: "conflict", 10: "replayed"}
    assert again.preparations.count() == again.items.count() == again.states.count() == 0
    nothing = P.create(empty, spark.createDataFrame([], P.REQUEST), F.lit(AT))
    assert nothing.answers.count() == nothing.preparations.count() == 0


def test_get(spark):
    made = P.create(spark.createDataFrame([], P.PREPARATION), spark.createDataFrame([request(1, terms=[("b", None, None, None), ("a", None, None, None)], locales=["ja", "en"])], P.REQUEST), F.lit(AT))
    own = made.answers.first()["id"]
    asks = spark.createDataFrame([("o", own), ("o", own), ("other", own), ("o", None)], "owner string, id string")
    got = {(r["owner"], r["id"]): r for r in P.get(made.preparations, made.items, made.states, asks).collect()}
    assert {k: r["found"] for k, r in got.items()} == {("o", own): True, ("other", own): False, ("o", None): False}
    items = got["o", own]["items"]
    assert [i["term"] for i in items] == ["b", "a"] and [[s["locale"] for s in i["states"]] for i in items] == [["en", "ja"]] * 2
    assert got["other", own]["items"] is None


def test_cancel_against_a_state_machine(spark):
    random.seed(5)
    table = {f"p{i}": ["o", 1 + i % 3, "cancelled" if i % 5 == 0 else "preparing"] for i in range(30)}
    stored = spark.createDataFrame([(i, o, i, "d", "", s, r, ["en"], "", "", "", AT, AT, None) for i, (o, r, s) in table.items()], P.PREPARATION)
    states = spark.createDataFrame([(i, 0, "en", "ready", "v", "", AT) for i in table], STATES)
    asks = [(n, random.choice(["o", "o", "o", "x"]), f"p{random.randrange(33)}", random.choice([None, 0, 1, 2, 3, 4]), random.choice(["why", "why", " ", None, "r" * 1001])) for n in range(400)]
    want, why = {}, {}
    for n, owner, key, revision, reason in asks:
        row = table.get(key)
        if not (reason or "").strip() or len(reason) > 1000 or (revision or 0) < 1:
            want[n] = "invalid"
        elif row is None or row[0] != owner:
            want[n] = "not_found"
        elif row[1] != revision:
            want[n] = "stale"
        elif row[2] == "cancelled":
            want[n] = "already_cancelled"
        else:
            want[n], why[key] = "cancelled", reason
            row[1:] = [revision + 1, "cancelled"]
    answers, after, locales = P.cancel(stored, states, spark.createDataFrame(asks, "arrival long, owner string, id string, revision long, reason string"), F.lit(AT))
    assert {r["arrival"]: r["outcome"] for r in answers.collect()} == want
    assert {r["id"]: [r["owner"], r["revision"], r["status"]] for r in after.collect()} == table
    assert {r["id"]: (r["state"], r["value"], r["reason"]) for r in locales.collect()} == {i: ("cancelled", "", why[i]) if i in why else ("ready", "v", "") for i in table}
    assert after.dtypes == stored.dtypes and locales.dtypes == states.dtypes and "cancelled" in want.values()


def test_correction_status(spark):
    rows = spark.createDataFrame([(1, "queued", "en", "s", None, None)], "id long, status string, locale string, suggested string, proposed string, resolution string")
    got = {r["id"]: (r["found"], r["status"]) for r in P.correction_status(rows, spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")).collect()}
    assert got == {1: (True, "queued"), 2: (False, None), None: (False, None)}
