"""Feeds, requests and other text sources, parsed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions.text import clean_html, contains_word, url_host
from lexora.operators.relational import insert_absent
from lexora.sources.connectors import Transport, fetch

#: Fixed value: bytes of a feed that are read.
MOST_BYTES = 5 << 20

_RSS = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>>"
_ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,updated:string>>>"


def parse_feeds(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of RSS 2.0 or, where a body has no RSS items, Atom: all columns but the body, title, link, description, published."""
    text = F.substring(F.col(body), 1, MOST_BYTES)
    rss = F.from_xml(text, _RSS)["channel"]["item"]
    atom = F.from_xml(text, _ATOM)["entry"]
    plain = F.transform(rss, lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["description"].alias("description"), i["pubDate"].alias("published")))
    chosen = lambda links: F.coalesce(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), links)
    other = F.transform(atom, lambda e: F.struct(e["title"].alias("title"), F.try_element_at(chosen(e["link"]), F.lit(1))["_href"].alias("link"), e["summary"].alias("description"), e["updated"].alias("published")))
    rest = [c for c in raw.columns if c != body]
    items = F.when(text.contains("<rss"), plain).otherwise(other)
    rows = raw.select(*rest, F.explode(items).alias("item")).select(*rest, "item.*")
    return rows.withColumn("title", clean_html(F.col("title"))).withColumn("description", clean_html(F.col("description"))).where(F.coalesce(F.trim("link"), F.lit("")) != "")


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    """The feeds to poll, in order."""
    return feeds.where(F.col("enabled") & (F.coalesce(F.trim("url"), F.lit("")) != "")).orderBy("domain", "url")


def poll(items: DataFrame, buffer: DataFrame, names: DataFrame) -> DataFrame:
    """New items with the verdict of a dictionary: hit if a known name occurs as a whole word.

    items: domain, link, title, description; buffer: domain, link of what is stored; names: name.
    """
    fresh = insert_absent(buffer, items, ["domain", "link"])
    text = F.concat_ws(" ", "title", "description")
    words = fresh.select("domain", "link", text.alias("t"), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("w"))
    first = names.select("name", F.element_at(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), 1).alias("w")).where("length(name) >= 2")
    hits = words.join(first, "w").where(contains_word(F.lower("t"), F.lower("name"))).groupBy("domain", "link").agg(F.array_sort(F.collect_set("name")).alias("hints"))
    return fresh.join(hits, ["domain", "link"], "left").withColumn("status", F.when(F.col("hints").isNull(), "miss").otherwise("hit"))


def entity_names(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """The dictionary of confident entities: (id, name) of canonical names and aliases of two characters or more."""
    names = F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.where(F.col("confidence") >= least).select("id", F.explode(names).alias("name")).where("length(name) >= 2").distinct()


def feed_links(html: Column) -> Column:
    """Feed addresses that a page announces."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<link[^>]+type="application/(?:rss|atom)\+xml"[^>]+href="([^"]+)"'), 1)


# Where feeds are looked for that no page announces, and how many announced ones are tried.
FEED_PATHS = ["/feed", "/feed/", "/rss", "/rss/", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml"]
MOST_LINKS = 5


def announced(html: Column, base: Column) -> Column:
    """Up to ``MOST_LINKS`` structs (url, title) of feeds that a page at ``base``, which ends with a slash, announces, absolute and without repeats."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\s[^>]*>)"), 1), lambda t: t.rlike("""(?i)rel=["']alternate["']""") & t.rlike("""(?i)type=["']application/(?:rss|atom)\\+xml["']"""))
    root = F.regexp_extract(base, "^(https?:)//[^/]*", 0)

    def link(tag: Column) -> Column:
        href = F.trim(F.regexp_extract(tag, """(?i)href=["']([^"']+)["']""", 1))
        whole = (
            F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href))
            .when(href != "", F.concat(base, F.regexp_replace(href, r"^(\./)+", "")))
        )
        return F.struct(whole.alias("url"), F.regexp_extract(tag, """(?i)title=["']([^"']+)["']""", 1).alias("title"))

    found = F.filter(F.transform(tags, link), lambda x: x["url"].isNotNull())
    first = F.filter(found, lambda x, i: ~F.array_contains(F.transform(F.slice(found, F.lit(1), i), lambda y: y["url"]), x["url"]))
    return F.slice(first, 1, MOST_LINKS)


def discover(domains: DataFrame, transport: Transport) -> DataFrame:
    """(domain, url, title) of each domain's feed: the first that has items, of those its home page announces, else of ``FEED_PATHS``.

    The page below ``www.`` is asked only where the plain one announces none. All domains go through each step together; the usual
    paths are tried only for domains still without a feed. Domains without one have no url; blank ones are passed over.
    """
    # Fetched bodies are kept: what is asked of the network once is not asked again by a later step.
    named = domains.select(F.regexp_replace(F.trim("domain"), "/$", "").alias("domain")).where("domain <> ''").distinct()

    def pages(rows: DataFrame, place: Column) -> DataFrame:
        bodies = fetch(rows.withColumn("url", place), "url", transport)
        links = bodies.select("domain", F.posexplode(announced(F.col("body"), F.col("url"))).alias("place", "l"))
        return links.select("domain", "place", F.col("l.url").alias("url"), F.col("l.title").alias("title")).persist()

    def working(candidates: DataFrame) -> DataFrame:
        bodies = fetch(candidates, "url", transport).select("domain", "place", "url", "title", "body")
        items = parse_feeds(bodies.select("domain", "place", F.col("url").alias("feed"), F.col("title").alias("feed_title"), "body"))
        return items.groupBy("domain").agg(F.min(F.struct("place", F.col("feed").alias("url"), F.col("feed_title").alias("title"))).alias("f")).select("domain", "f.url", "f.title").persist()

    plain = pages(named, F.concat(F.lit("https://"), "domain", F.lit("/")))
    below = pages(named.join(plain.select("domain").distinct(), "domain", "left_anti"), F.concat(F.lit("https://www."), F.regexp_replace("domain", r"^www\.", ""), F.lit("/")))
    told = working(plain.unionByName(below))
    left = named.join(told.select("domain"), "domain", "left_anti").select("domain", F.posexplode(F.array(*map(F.lit, FEED_PATHS))).alias("place", "path"))
    usual = working(left.select("domain", "place", F.concat(F.lit("https://"), "domain", "path").alias("url"), F.lit("").alias("title")))
    return named.join(told.unionByName(usual), "domain", "left")


def site_queries(entities: DataFrame, domains: DataFrame) -> DataFrame:
    """One search for each entity and domain of its locale."""
    return entities.join(domains, "locale").select("id", "domain", F.concat(F.lit("site:"), F.col("domain"), F.lit(' "'), F.col("name"), F.lit('"')).alias("query"))


def site_hits(results: DataFrame) -> DataFrame:
    """Search results on the domain asked for that mention the entity. results: id, name, domain, url, title, snippet."""
    host = url_host(F.col("url"))
    on = (host == F.col("domain")) | F.endswith(host, F.concat(F.lit("."), F.col("domain")))
    return results.where(on & F.contains(F.lower(F.concat_ws(" ", "title", "snippet")), F.lower("name")))


def bulk_queries(bodies: DataFrame, body: str = "body", kind: str = "person") -> DataFrame:
    """Elements of JSON arrays that hold strings or objects: (term, type, context), each body's other columns kept."""
    rest = [c for c in bodies.columns if c != body]
    each = bodies.select(*rest, F.posexplode(F.from_json(body, "array<string>")).alias("at", "e"))
    obj = F.from_json("e", "struct<q:string,term:string,type:string,context:string>")
    given = F.startswith(F.trim("e"), F.lit("{"))
    term = F.when(given, F.coalesce(obj["term"], obj["q"])).otherwise(F.col("e"))
    return each.select(*rest, "at", F.trim(term).alias("term"), F.coalesce(F.when(given, obj["type"]), F.lit(kind)).alias("type"), F.when(given, obj["context"]).alias("context")).where("term != ''")
