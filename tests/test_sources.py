"""Feeds, requests and recorded service bodies."""

from pyspark.sql import functions as F

from lexora.sources import connectors, feeds, sinks

RSS = "<rss><channel><item><title>A &amp;amp; B</title><link>http://x/1</link><description>&lt;p&gt;text&lt;/p&gt;</description><pubDate>now</pubDate></item><item><title>C</title><link>http://x/2</link><description>d</description><pubDate>now</pubDate></item></channel></rss>"
ATOM = '<feed><entry><title>T</title><link href="http://y/self" rel="self"/><link href="http://y/1" rel="alternate"/><summary>s</summary><updated>u</updated></entry><entry><title>U</title><link href="http://y/2" rel="alternate"/><summary>s</summary><updated>u</updated></entry></feed>'


def test_feeds(spark):
    raw = spark.createDataFrame([("x", RSS), ("y", ATOM), ("z", "broken")], "domain string, body string")
    got = {(r["domain"], r["link"], r["title"]) for r in feeds.parse_feeds(raw).collect()}
    assert {("x", "http://x/1"), ("x", "http://x/2"), ("y", "http://y/1"), ("y", "http://y/2")} == {g[:2] for g in got}


def test_poll(spark):
    items = spark.createDataFrame([("x", "1", "Red Velvet sings", ""), ("x", "2", "nothing", ""), ("x", "3", "old", "")], "domain string, link string, title string, description string")
    buffer = spark.createDataFrame([("x", "3")], "domain string, link string")
    names = spark.createDataFrame([("Red Velvet",), ("z",)], "name string")
    assert {r["link"]: r["status"] for r in feeds.poll(items, buffer, names).collect()} == {"1": "hit", "2": "miss"}


def test_bulk_queries(spark):
    body = '["a", {"q": "b", "type": "group"}, {"term": "c", "context": "d"}, ""]'
    got = [(r["term"], r["type"], r["context"]) for r in feeds.bulk_queries(spark.createDataFrame([(1, body), (2, None)], "id long, body string")).orderBy("at").collect()]
    assert got == [("a", "person", None), ("b", "group", None), ("c", "person", "d")]


def test_recorded_services(spark):
    bodies = spark.createDataFrame([(1, '{"artists":[{"id":"a","name":"N","score":100}]}')], "id long, body string")
    assert connectors.records(bodies, "artists").first()["name"] == "N"
    xml = spark.createDataFrame([(1, "<dbs><db><mt20id>P1</mt20id><prfnm>Show</prfnm></db><db><mt20id>P2</mt20id><prfnm>Other</prfnm></db></dbs>")], "id long, body string")
    assert {r["prfnm"] for r in connectors.records(xml, "performances").collect()} == {"Show", "Other"}
    entry = '{"id":"Q1","labels":{"en":{"language":"en","value":"E"}},"aliases":{"en":[{"language":"en","value":"F"}]},"sitelinks":{"enwiki":{"site":"enwiki","title":"E"}},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":"Q5"}}}]}}'
    claims = connectors.entity_claims(spark.createDataFrame([(entry,)], "body string"))
    assert {(r["kind"], r["value"]) for r in claims.collect()} == {("label", "E"), ("alias", "F"), ("sitelink", "E"), ("claim", "Q5")}


def test_fetch_retries_and_models(spark):
    def transport(requests):
        return [None if "bad" in r else '{"x": 1}' for r in requests]

    asked = spark.createDataFrame([("ok",), ("bad",)], "url string")
    got = {r["url"]: (r["body"], r["attempts"]) for r in connectors.fetch(asked, "url", transport).collect()}
    assert got == {"ok": ('{"x": 1}', 1), "bad": (None, 3)}
    assert connectors.call_model(asked, F.col("url"), transport, "x int").where("url = 'ok'").first()["answer"]["x"] == 1


def test_extractor(spark):
    def model(articles):
        return ['[{"locale": "en", "spelling": "S", "hint": "h", "confidence": 0.8}]' for _ in articles]

    spark.udtf.register("extract_spellings", connectors.spelling_extractor(model))
    assert spark.sql("SELECT * FROM extract_spellings('text')").first()["spelling"] == "S"


def test_translate_cache(spark):
    terms, cache = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "term string"), spark.createDataFrame([("a", "A")], "term string, value string")
    got = {r["term"]: (r["value"], r["cached"]) for r in connectors.translate_cached(terms, cache, lambda xs: [x.upper() for x in xs], quota=3).collect()}
    assert got == {"a": ("A", True), "bb": ("BB", False)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "1"), ("d", "2")], "domain string, link string")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_new(spark.createDataFrame([("d", "2"), ("d", "3"), ("d", "3")], rows.schema), str(tmp_path / "log"), ["domain", "link"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    sinks.export_csv(rows, str(tmp_path / "csv"))
    assert sinks.import_csv(spark, str(tmp_path / "csv"), "domain string, link string").count() == 2
    cache = sinks.ResultCache(10)
    assert cache.get((1,), lambda: 5, 0.0) == (5, False) and cache.get((1,), lambda: 6, 5.0) == (5, True) and cache.get((1,), lambda: 7, 11.0) == (7, False)
