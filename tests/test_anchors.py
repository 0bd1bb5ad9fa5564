"""Anchors, feed discovery and conversion by rule tables and recorded bodies."""

import json

from pyspark.sql import functions as F

from lexora.operators import anchors
from lexora.sources import connectors, feeds

ENTRY = "struct<names:array<string>,classes:array<string>,countries:array<string>,descriptions:map<string,string>,titles:map<string,string>>"
ALLOWED = {"Q1": ["company"], "Q2": ["school", "organization"]}


def verdicts(spark, rows, column):
    df = spark.createDataFrame(rows, f"id string, name string, kind string, entry {ENTRY}, known boolean")
    return {r["id"]: r["v"] for r in df.select("id", column.alias("v")).collect()}


def test_organizations(spark):
    entry = lambda names=("A-B",), classes=("Q2",), countries=None, said=None: (list(names), list(classes), countries, said, None)
    rows = [
        ("none", "ab", "school", None, None), ("self", "ab", "school", entry(classes=["Q2", "Q202444"]), None), ("name", "abc", "school", entry(), None), ("blank", " - ", "school", entry(names=["."]), None), ("type", "ab", "school", entry(classes=["Q9", "Q1"]), None),
        ("unknown", "ab", "school", entry(classes=["Q9"]), None), ("home", "a b", "school", entry(classes=["Q1", "Q2"], countries=["Q17", "Q884"]), None), ("foreign", "ab", "school", entry(countries=["Q17"], said={"en": "korean school"}), None),
        ("told", "ab", "school", entry(countries=[], said={"ko": "K-POP 학교"}), None), ("hold", "ab", "school", entry(said={"fr": "k-pop"}), None), ("nulls", "ab", "school", (None, None, None, None, None), None),
    ]
    got = verdicts(spark, rows, anchors.organization_anchor(F.col("name"), F.col("kind"), F.col("entry"), ALLOWED, ["Q202444"], ["k-pop"]))
    assert {k: tuple(v) for k, v in got.items()} == {
        "none": ("skip", "fetch-failed"), "self": ("skip", "name-element"), "name": ("skip", "name-mismatch"), "blank": ("skip", "name-mismatch"), "type": ("skip", "type-mismatch"), "unknown": ("skip", "type-unknown"),
        "home": ("promote", "country-kr"), "foreign": ("skip", "foreign"), "told": ("promote", "country-desc"), "hold": ("hold", "country-unknown"), "nulls": ("skip", "name-mismatch"),
    }


def test_institutions(spark):
    entry = lambda classes=("Q9",), countries=None, said=None, title=None: ([], list(classes), countries, {"en": said}, {"kowiki": title})
    rows = [
        ("type", "ab", "school", entry(["Q2", "Q1"], ["Q884"], None, "ab"), True), ("nowhere", "ab", "school", entry(), True), ("foreign", "ab", "school", entry(countries=["Q884"], said="North Korean school"), True), ("known", "ab", "school", entry(said="school in Korea"), True),
        ("untitled", "ab", "school", entry(countries=["Q884"]), False), ("second", "FC 서울", "sports_team", entry(countries=["Q884"], title="FC 서울 B"), None), ("same", "FC서울", "sports_team", entry(countries=[None, "Q884"], title="FC 서울 (축구단)"), False), ("part", "f(x)", "group", entry(countries=["Q884"], title="f(x)"), False),
    ]
    got = verdicts(spark, rows, anchors.institution_anchor(F.col("name"), F.col("kind"), F.col("entry"), ALLOWED, F.col("known")))
    assert got == {"type": "type", "nowhere": "korea", "foreign": "korea", "known": None, "untitled": "title", "second": "title", "same": None, "part": None}


def test_discovery(spark):
    item = "<rss><channel><item><title>t</title><link>http://i</link></item></channel></rss>"
    link = lambda href, title="": f'<link title="{title}" rel="alternate" type="application/rss+xml" href="{href}">'
    web = {
        "https://a.org/": link("/dead") + link("/dead") + link("sub/live", "Live") + link("/late"), "https://a.org/dead": "<html/>", "https://a.org/sub/live": item, "https://a.org/late": item,
        "https://b.org/": "<link rel='icon' href='/x'>", "https://www.b.org/": link("//cdn.org/f"), "https://cdn.org/f": item, "https://c.org/rss.xml": item, "https://c.org/feed.xml": item,
        "https://d.org/": link("https://d.org/empty"), "https://d.org/empty": "<rss><channel></channel></rss>", "https://d.org/atom.xml": '<feed><entry><title>t</title><link href="http://e"/></entry></feed>',
    }
    asked = spark.createDataFrame([("a.org",), ("b.org/",), ("c.org",), ("d.org",), ("e.org",), (" ",), ("a.org",), (None,)], "domain string")
    got = {r["domain"]: (r["url"], r["title"]) for r in feeds.discover(asked, lambda urls: [web.get(u) for u in urls]).collect()}
    assert got == {"a.org": ("https://a.org/sub/live", "Live"), "b.org": ("https://cdn.org/f", ""), "c.org": ("https://c.org/rss.xml", ""), "d.org": ("https://d.org/atom.xml", ""), "e.org": (None, None)}


def test_conversion(spark):
    answers = {"鱿鱼": "<div><p>魷魚\n</p></div>", "长": "x" * 201, "空": "<p></p>"}

    def transport(names):
        assert "plain" not in names
        return [json.dumps({"parse": {"text": {"*": answers[n]}}}) if n in answers else None for n in names]

    rows = spark.createDataFrame([(1, " 鱿鱼 "), (2, "plain"), (3, "长"), (4, "空"), (5, "败"), (6, None), (7, "鱿鱼")], "id long, name string")
    assert {r["id"]: r["converted"] for r in connectors.convert_variant(rows, "name", transport).collect()} == {1: "魷魚", 2: "plain", 3: None, 4: None, 5: None, 6: None, 7: "魷魚"}
