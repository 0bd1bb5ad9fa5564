"""Queries over the catalogue's operations, merges, feeds and services: tables stand in for entities, requests and bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions import rank as K
from lexora.functions import text as T
from lexora.operators import consensus, matching, resolve
from lexora.operators import quality as Q
from lexora.plans.api import Catalogue
from lexora.plans.registry import query
from lexora.plans.values import choose
from lexora.sources import connectors, feeds, sinks
from lexora.sources.tables import table
from lexora.streaming import pipeline


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_acctbal") > 0, "active").otherwise("candidate").alias("status"), ((k % 10) / 10).alias("confidence"),
        (k % 9 == 0).alias("locked"), F.array(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"))).alias("names"), F.col("c_nationkey").alias("updated_at"),
        F.when(k % 3 > 0, F.concat(F.lit("en "), "c_name")).alias("canonical_en"), F.when(k % 5 == 0, F.lit("")).otherwise("ja").alias("canonical_ja"),
    )


# The same in SQL.
PEOPLE = """people AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'candidate' END AS status, (c_custkey % 10) / 10 AS confidence, c_custkey % 9 = 0 AS locked,
  c_mktsegment || '-' || c_nationkey AS alias, c_nationkey AS updated_at, CASE WHEN c_custkey % 3 > 0 THEN 'en ' || c_name END AS canonical_en, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'ja' END AS canonical_ja FROM customer)"""


@query(f"""WITH {PEOPLE} SELECT id, CASE WHEN contains(lower(name), '12') THEN 2 ELSE 3 END AS rank FROM people
  WHERE type = 'BUILDING' AND status = 'active' AND confidence >= 0.5 AND (contains(name, '12') OR contains(alias, '12')) ORDER BY rank, confidence DESC, updated_at DESC, id LIMIT 100""")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a type that hold a term, most relevant first; a limit over the greatest is cut to it."""
    return Catalogue(_people(spark, sf_dir)).list("12", limit=500, kind="BUILDING", least=0.5).select("id", "rank")


@query(f"""WITH {PEOPLE} SELECT id, 'ko' AS locale, name AS value FROM people UNION ALL SELECT id, 'en', canonical_en FROM people WHERE canonical_en IS NOT NULL UNION ALL SELECT id, 'ja', canonical_ja FROM people WHERE canonical_ja <> ''""")
def entity_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of every entity."""
    return Catalogue(_people(spark, sf_dir)).spellings().select("id", "locale", "value")


@query("""SELECT l_suppkey AS entity, l_returnflag AS provider, l_partkey AS external_id, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 5000 GROUP BY ALL""")
def entity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids of some suppliers."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("provider"), F.col("l_partkey").alias("external_id"))
    ids = table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("id"))
    return Catalogue(ids, refs=refs).references(ids).groupBy("entity", "provider", "external_id").agg(F.count("*").alias("n"))


@query(f"""WITH {PEOPLE} SELECT id, name, agency FROM people LEFT JOIN (SELECT c_custkey AS entity, c_mktsegment AS agency FROM customer WHERE c_nationkey < 10) ON entity = id""")
def entity_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their personal details, where they have some."""
    persons = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("agency"))
    return Catalogue(_people(spark, sf_dir), persons=persons).with_person().select("id", "name", "agency")


@query(f"""WITH {PEOPLE} SELECT id, CASE WHEN id % 4 = 0 AND NOT locked AND id % 8 = 0 THEN 'new' ELSE canonical_en END AS canonical_en, CASE WHEN id % 4 = 0 AND NOT locked THEN 'neu' ELSE canonical_ja END AS canonical_ja, locked OR id % 6 = 0 AS locked FROM people""")
def entity_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after a batch of changes, which pass over locked ones, and then a batch of locks."""
    people = _people(spark, sf_dir)
    changes = people.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "new").alias("canonical_en"), F.lit("neu").alias("canonical_ja"))
    patched = Catalogue(people).patch(changes, ["canonical_en", "canonical_ja"])
    return Catalogue(patched).lock(people.where("id % 6 = 0")).select("id", "canonical_en", "canonical_ja", "locked")


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, 'entity' AS layer FROM customer UNION ALL SELECT p_partkey, p_name, 'part' FROM part UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier)
  SELECT * FROM a WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = 'coldwidget'""")
def entity_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a term in every layer."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    others = {"part": parts, "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}
    return Catalogue(_people(spark, sf_dir)).find("Cold-Widget", others)


@query(f"""WITH {PEOPLE} SELECT id, 'in' AS side FROM people WHERE status = 'active' AND type = 'MACHINERY' AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT id, 'out' FROM people WHERE status = 'candidate' AND updated_at >= 12 AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def entity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a scope that are assigned, and others that are not."""
    catalogue = Catalogue(_people(spark, sf_dir))
    assigned = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    inside, outside = catalogue.scope("MACHINERY", "active", assigned=assigned), catalogue.scope(None, "candidate", since="12", assigned=assigned, unassigned=True)
    return inside.select("id", F.lit("in").alias("side")).unionByName(outside.select("id", F.lit("out").alias("side")))


@query(f"""WITH {PEOPLE} SELECT id, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 140000) THEN 0 WHEN canonical_en IS NULL THEN 1 ELSE 2 END AS turn FROM people ORDER BY turn, updated_at, id LIMIT 90""")
def entity_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to check next among entities."""
    asked = table(spark, sf_dir, "orders").where("o_totalprice > 140000").select(F.col("o_custkey").alias("id"))
    return Catalogue(_people(spark, sf_dir)).work(asked, 90).select("id", "turn")


CODES = ["ko", "ja", "zh", "en"]


@query(f"""SELECT id FROM (SELECT c_custkey AS id, ({CODES})[c_custkey % 4 + 1] AS locale, c_custkey % 3 AS kind FROM customer) WHERE kind = 0 OR kind = 1 AND locale = 'ko'""")
def work_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported spellings whose script fits their locale: Latin ones, Hangul, and with a mark that is not seen."""
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "가나").otherwise(F.concat(F.lit("a​b"), "c_name"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), choose(k, CODES).alias("locale"), value.alias("value"))
    return Catalogue(rows).work_result(rows).select("id")


# A type that is not known is inferred from the cue in the context, where there is one.
@query("""WITH t AS (SELECT p_partkey AS k, p_name AS term, length(split_part(p_name, ' ', 1)) >= 4 AND length(split_part(p_name, ' ', 2)) <= 4 AS odd, p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) AS known,
    p_partkey % 7 = 0 AND p_partkey % 3 > 0 AS untyped, p_partkey % 5 > 0 AND p_partkey % 2 = 0 AS sourced FROM part)
  SELECT term, CASE WHEN k % 7 = 0 THEN 'unheard' ELSE 'person' END AS type, CASE WHEN known THEN 'pass' WHEN untyped THEN 'reject' WHEN NOT odd AND sourced AND k % 3 = 0 THEN 'pass' ELSE 'review' END AS verdict,
    CASE WHEN known THEN 'existing_entity' WHEN untyped THEN 'latin_passthrough' WHEN odd THEN 'type_shape_conflict' WHEN NOT sourced THEN 'missing_source_evidence' WHEN k % 3 = 2 THEN 'missing_exact_context' WHEN k % 3 = 1 THEN 'missing_type_context_cue'
    ELSE 'typed_context_evidence' END AS reason, count(*) AS n FROM t GROUP BY ALL""")
def intake_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdicts on part names as requested terms."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    context = F.when(k % 3 == 0, F.concat(F.lit("가수 "), "p_name")).when(k % 3 == 1, F.col("p_name")).otherwise("nothing")
    terms = part.select(F.col("p_name").alias("term"), F.when(k % 7 == 0, "unheard").otherwise("person").alias("type"), context.alias("context"), F.when(k % 5 > 0, "https://example.org/x").otherwise("javascript:x").alias("url"), (k % 2 == 0).alias("trusted"))
    known = part.where("p_partkey % 50 = 0").select(F.col("p_name").alias("name"))
    return Catalogue(known).enqueue(terms).groupBy("term", "type", "verdict", "reason").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'out_of_scope' WHEN c_custkey % 7 = 0 THEN 'new' WHEN c_custkey % 10 = 0 AND c_custkey % 20 > 0 THEN 'preparing' WHEN c_nationkey % 3 = 0 THEN 'ready' WHEN c_custkey % 2 >= c_nationkey % 3 THEN 'unfillable' ELSE 'preparing' END AS status
  FROM customer""")
def prepared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each customer's name as a term to prepare; some names have a second owner of another type."""
    k, rows = F.col("c_custkey"), table(spark, sf_dir, "customer")
    owner = lambda d, kind: rows.select((k + d).alias("id"), F.col("c_name").alias("name"), kind.alias("type"), F.lit(False).alias("locked"), F.lit(0.5).alias("confidence"))
    entities = owner(0, F.col("c_mktsegment")).unionByName(owner(10**12, F.lit("another")).where("id % 10 = 0"))
    term = F.when(k % 7 == 0, F.concat(F.lit("nobody "), k.cast("string"))).otherwise(F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")))
    terms = rows.select(term.alias("term"), F.when(k % 20 == 0, F.col("c_mktsegment")).otherwise("none").alias("hint"), k.alias("k"))
    ready = rows.select(k.alias("id"), (F.col("c_nationkey") % 3).alias("missing"), (k % 2).alias("exhausted"))
    done = Catalogue(entities).prepare(terms.select("term", "hint"), ready, terms.where("k % 11 = 0").select("term"))
    return done.join(terms.select("term", "k"), "term").select("k", "status")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'survivor_inactive' WHEN s_suppkey % 5 = 0 THEN 'type_unknown' WHEN s_nationkey % 4 = 0 THEN 'type_differs' WHEN s_nationkey % 3 = 0 THEN 'provider_conflict' WHEN s_acctbal < 0 THEN 'no_shared_id' END AS why FROM supplier""")
def merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each supplier must not merge with another record, if so."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    why = resolve.merge_gate(F.when(k % 5 > 0, "a"), F.when(n % 4 > 0, "a").otherwise("b"), k % 7 > 0, F.when(n % 3 == 0, 2).otherwise(0), F.when(F.col("s_acctbal") >= 0, 1).otherwise(0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", why.alias("why"))


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 9 = 0 DESC, c_custkey % 4 DESC, c_custkey % 3 DESC, c_acctbal, c_custkey) AS r FROM customer) WHERE r = 1""")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each nation as a cluster keeps."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumns({"locked": k % 9 == 0, "refs": k % 4, "urls": k % 3})
    return resolve.survivor_order(rows, "c_nationkey", "locked", "refs", "urls", "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS own, p_partkey - p_partkey % 3 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS same_as FROM part)
  SELECT id, 'repeated' AS fault FROM p WHERE id % 40 = 0 UNION ALL SELECT id, 'outside' FROM p WHERE id % 50 = 0 UNION ALL SELECT id, 'survivor_not_distinct' FROM p WHERE NOT own AND same_as NOT IN (SELECT id FROM p WHERE own)""")
def merge_plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a plan that merges two of three parts into the third."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    plan = part.select(k.alias("id"), F.when(k % 3 == 0, "distinct").otherwise("same").alias("verdict"), (k - k % 3 + F.when(k % 5 == 0, 1).otherwise(0)).alias("same_as"))
    return resolve.plan_faults(plan.unionByName(plan.where("id % 40 = 0")), part.where("p_partkey % 50 > 0").select(k.alias("id")))


@query("""WITH o AS (SELECT CASE WHEN o_custkey % 4 = 1 THEN o_custkey - 1 ELSE o_custkey END AS id, count(*) AS orders FROM orders GROUP BY 1)
  SELECT c.c_custkey AS id, coalesce(orders, 0) AS orders, array_to_string(list_sort(list_distinct(list_filter([c.c_mktsegment, x.c_name, x.c_mktsegment, c.c_name], lambda v: v IS NOT NULL AND v <> c.c_name))), '|') AS aliases
  FROM customer c LEFT JOIN customer x ON x.c_custkey = c.c_custkey + 1 LEFT JOIN o ON o.id = c.c_custkey WHERE c.c_custkey % 4 = 0""")
def merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after the next one of some merged into them: whose orders they have, and the names carried over."""
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    redirects = rows.where("c_custkey % 4 = 1").select(k.alias("old"), (k - 1).alias("survivor"))
    orders = resolve.apply_redirects(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), redirects, "id").groupBy("id").agg(F.count("*").alias("orders"))
    named = lambda c: [c.alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases")]
    merged = resolve.merge_names(rows.where("c_custkey % 4 = 0").select(*named(k)), rows.where("c_custkey % 4 = 1").select(*named(k - 1)))
    return merged.join(orders, "id", "left").select("id", F.coalesce("orders", F.lit(0)).alias("orders"), F.array_join("aliases", "|").alias("aliases"))


@query("""SELECT o_orderkey AS old, o_custkey AS survivor FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice < 20000 OR o_orderkey % 9 = 0""")
def unapplied_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects without an applied merge of the same ends."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    operations = o.select(F.when(F.col("o_totalprice") < 20000, "split").otherwise("merge").alias("kind"), (F.col("o_orderstatus") == "F").alias("applied"), k.alias("old"), (F.col("o_custkey") + F.when(k % 9 == 0, 1).otherwise(0)).alias("survivor"))
    return Q.stray_redirects(o.select(k.alias("old"), F.col("o_custkey").alias("survivor")), operations)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'first' WHEN c_custkey % 5 = 0 THEN 'second' END AS en_source, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'x' WHEN c_custkey % 5 = 0 THEN 'y' END AS en,
  CASE WHEN c_custkey % 7 = 0 THEN 'own' WHEN c_custkey % 5 = 0 THEN 'second' END AS ja_source FROM customer""")
def filled_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing names filled from two sources in order, with where each came from."""
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    target = rows.select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("en"), F.when(k % 7 == 0, F.col("c_name")).alias("ja"))
    first, second = rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit("x").alias("en")), rows.where("c_custkey % 5 = 0").select("c_custkey", F.lit("y").alias("en"), F.lit("z").alias("ja"))
    return resolve.cascade(target, [("first", first), ("second", second)], "c_custkey", ["en", "ja"]).select("c_custkey", "en_source", "en", "ja_source")


@query("""WITH o AS (SELECT p_name || p_size AS name, count(DISTINCT p_brand) AS owners, min(p_brand) AS owner FROM part GROUP BY 1)
  SELECT p_partkey AS spelling, CASE WHEN p_partkey % 6 = 0 THEN 'skip' WHEN owners = 1 THEN 'append' ELSE 'ambiguous' END AS action, CASE WHEN p_partkey % 6 > 0 AND owners = 1 THEN owner END AS entity FROM part JOIN o ON name = p_name || p_size""")
def observed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's name, as observed, does to the brands that are known by it."""
    part, name = table(spark, sf_dir, "part"), F.concat("p_name", F.col("p_size").cast("string"))
    seen = part.select(F.when(F.col("p_partkey") % 6 == 0, "nothing").otherwise(name).alias("name"), F.col("p_partkey").alias("spelling"))
    return consensus.observe(part.select(name.alias("name"), F.col("p_brand").alias("entity")), seen).select("spelling", "action", "entity")


@query("""SELECT o_orderkey, o_orderstatus AS state, 'F' AS now FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 > 0 ORDER BY o_orderkey LIMIT 500""")
def reconciled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stored states that a recomputation contradicts."""
    o = table(spark, sf_dir, "orders")
    computed = o.where("o_orderkey % 3 > 0").select("o_orderkey", F.lit("F").alias("state"))
    return pipeline.reconcile(o.select("o_orderkey", F.col("o_orderstatus").alias("state")), computed, ["o_orderkey"], 500)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts > TIMESTAMP '2024-01-10' OR ts = TIMESTAMP '2024-01-10' AND event_id > 5)
  SELECT event_id AS id, user_id AS entity FROM e WHERE r = 1 ORDER BY ts, event_id LIMIT 51""")
def invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the latest change of each user behind a cursor, and one more."""
    outbox = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("user_id").alias("entity"))
    return pipeline.change_feed(outbox, (F.lit("2024-01-10").cast("timestamp_ntz"), 5), 50).select("id", "entity")


@query("""WITH b AS (SELECT event_id AS link, event_type AS domain, ts, user_id % 5 AS retries, value > 100 AS hit, event_id % 4 > 0 AS pending FROM events),
  t AS (SELECT link FROM b WHERE hit AND pending AND retries < 3 ORDER BY ts, domain, link LIMIT 30)
  SELECT link, CASE WHEN link IN (SELECT link FROM t) AND link % 2 = 0 THEN 'done' WHEN pending THEN 'pending' ELSE 'done' END AS state, retries + CASE WHEN link IN (SELECT link FROM t) AND link % 2 = 1 THEN 1 ELSE 0 END AS retries FROM b""")
def swept_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of feed items after one sweep of its oldest pending hits, half of which fail."""
    k = F.col("event_id")
    buffer = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("domain"), k.alias("link"), F.col("ts").alias("fetched_at"), F.when(F.col("value") > 100, "hit").otherwise("miss").alias("status"),
        F.when(k % 4 > 0, "pending").otherwise("done").alias("state"), (F.col("user_id") % 5).alias("retries"),
    )
    outcomes = pipeline.take_pending(buffer).select("domain", "link", (F.col("link") % 2 == 0).alias("ok"))
    return pipeline.settle(buffer, outcomes).select("link", "state", "retries")


@query("""SELECT 7 AS cycle, count(*) AS items, count_if(value > 100) AS hits, count(DISTINCT event_type) AS feeds FROM events""")
def polled_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit row of a cycle."""
    return pipeline.cycle_audit(7, table(spark, sf_dir, "events").select(F.when(F.col("value") > 100, "hit").otherwise("miss").alias("status"), F.col("event_type").alias("domain")))


@query("""SELECT page_id, 'http://x/' || page_id || '/' || n AS link, 'A & B ' || n AS title FROM pages, (SELECT unnest([1, 2]) AS n) WHERE page_id % 3 < 2""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a feed of each page: of one format, of the other, or broken."""
    k = F.col("page_id")
    link = lambda n: F.concat(F.lit("http://x/"), k.cast("string"), F.lit(f"/{n}"))
    rss = [F.concat(F.lit(f"<item><title>A &amp;amp; &lt;b&gt;B&lt;/b&gt; {n}</title><link>"), link(n), F.lit("</link><description>d</description></item>")) for n in (1, 2)]
    atom = [F.concat(F.lit(f'<entry><title>A &amp;amp; B {n}</title><link href="'), link(n), F.lit('" rel="alternate"/><link href="http://y" rel="self"/></entry>')) for n in (1, 2)]
    body = F.when(k % 3 == 0, F.concat(F.lit("<rss><channel>"), *rss, F.lit("</channel></rss>"))).when(k % 3 == 1, F.concat(F.lit("<feed>"), *atom, F.lit("</feed>"))).otherwise("<broken")
    return feeds.parse_feeds(table(spark, sf_dir, "pages").select("page_id", body.alias("body"))).select("page_id", "link", "title")


@query("""SELECT DISTINCT c_custkey AS id, unnest([c_name, c_mktsegment]) AS name FROM customer WHERE c_custkey % 10 >= 5 AND c_custkey % 4 > 0 UNION SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 >= 5 AND c_custkey % 4 = 0""")
def dictionary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of confident entities with their aliases; one character is no name."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("canonical"), F.when(k % 4 == 0, F.array(F.lit("x"))).otherwise(F.array("c_mktsegment", "c_name")).alias("aliases"), ((k % 10) / 10).alias("confidence"))
    return feeds.entity_names(rows)


@query("""SELECT s_suppkey AS id, 'n' || n_nationkey || '.org' AS domain, 'site:n' || n_nationkey || '.org "' || s_name || '"' AS query, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS held FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5""")
def site_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for each supplier on the domains of its locale, and whether the answer is one: on the domain, with the name."""
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 5).cast("int").alias("locale"))
    domains = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("locale"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".org")).alias("domain"))
    asked = feeds.site_queries(entities, domains)
    place = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://www."), "domain", F.lit("/a"))).when(F.col("id") % 3 == 1, F.concat(F.lit("https://not"), "domain")).otherwise("https://else.org")
    results = asked.join(entities, "id").select("id", "name", "domain", "query", place.alias("url"), F.lit("t").alias("title"), F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise("").alias("snippet"))
    hits = feeds.site_hits(results).select("id", "domain", F.lit(True).alias("held"))
    return asked.join(hits, ["id", "domain"], "left").select("id", "domain", "query", F.coalesce("held", F.lit(False)).alias("held"))


@query("""SELECT p_partkey, 0 AS at, p_name AS term, 'person' AS type FROM part UNION ALL SELECT p_partkey, 1, p_brand, p_type FROM part UNION ALL SELECT p_partkey, 2, p_type, 'person' FROM part WHERE p_partkey % 2 = 0""")
def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests out of each part's JSON array of strings and objects; blank ones are passed over."""
    one, two = F.to_json(F.struct(F.col("p_brand").alias("term"), F.col("p_type").alias("type"))), F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_type").alias("q")))).otherwise('" "')
    body = F.concat(F.lit('["'), "p_name", F.lit('",'), one, F.lit(","), two, F.lit("]"))
    return feeds.bulk_queries(table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))).select("p_partkey", "at", "term", "type")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'write [mail] now' WHEN 1 THEN 'call [number]' ELSE 'Customer#[number]' END AS keyword FROM customer""")
def audited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords as the request log keeps them: addresses and long numbers masked."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "write a.b@example.org\nnow").when(k % 3 == 1, F.lit("call  010-1234-5678")).otherwise(F.col("c_name"))
    return sinks.audit(table(spark, sf_dir, "customer").select("c_custkey", said.alias("keyword")))


@query("""SELECT page_id, 'http://f/' || page_id AS link FROM pages WHERE page_id % 2 = 0""")
def announced_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that pages announce in their heads."""
    k = F.col("page_id").cast("string")
    tag = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<LINK rel="alternate" type="application/rss+xml" title="x" href="http://f/'), k, F.lit('"/>'))).otherwise('<link rel="icon" href="/i"/>')
    return table(spark, sf_dir, "pages").select("page_id", F.explode(feeds.feed_links(F.concat(F.coalesce("html", F.lit("")), tag))).alias("link"))


@query("""SELECT 'Q' || s_suppkey AS qid, 'label' AS kind, 'en' AS key, s_name AS value FROM supplier UNION ALL SELECT 'Q' || s_suppkey, 'alias', 'ja', unnest([s_name || 'x', s_name || 'y']) FROM supplier
  UNION ALL SELECT 'Q' || s_suppkey, 'sitelink', 'enwiki', s_name FROM supplier UNION ALL SELECT 'Q' || s_suppkey, 'claim', 'P31', 'Q5' FROM supplier WHERE s_suppkey % 2 = 0""")
def knowledge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a knowledge base says of each supplier, out of one body each."""
    name = F.col("s_name")
    said = lambda locale, value: F.struct(F.lit(locale).alias("language"), value.alias("value"))
    claim = F.struct(F.struct(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "Q5").alias("value")).alias("datavalue")).alias("mainsnak"))
    entry = F.struct(
        F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("id"), F.create_map(F.lit("en"), said("en", name)).alias("labels"), F.create_map(F.lit("ja"), F.array(said("ja", F.concat(name, F.lit("x"))), said("ja", F.concat(name, F.lit("y"))))).alias("aliases"),
        F.create_map(F.lit("enwiki"), F.struct(F.lit("enwiki").alias("site"), name.alias("title"))).alias("sitelinks"), F.create_map(F.lit("P31"), F.array(claim)).alias("claims"),
    )
    return connectors.entity_claims(table(spark, sf_dir, "supplier").select(F.to_json(entry).alias("body")))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS place FROM part""")
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three services in order answers for each part."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return connectors.first_answer([rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), rows], "id")


@query("""SELECT event_type AS source, count(*) AS calls, count_if(user_id % 4 = 0 OR user_id % 7 = 0) AS failures FROM events GROUP BY 1""")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and failures of each event type as a service; a call without a status failed."""
    status = F.when(F.col("user_id") % 7 == 0, None).when(F.col("user_id") % 4 == 0, 500).otherwise(200)
    return connectors.health(table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), status.alias("status")))


@query("""WITH t AS (SELECT DISTINCT p_name AS term FROM part), c AS (SELECT term, substr(term, 1, 1) < 'h' AS cached FROM t), s AS (SELECT term, sum(length(term)) OVER (ORDER BY term) AS s FROM c WHERE NOT cached)
  SELECT term, CASE WHEN cached THEN 'held' ELSE upper(term) END AS value, cached FROM c LEFT JOIN s USING (term) WHERE cached OR s <= 150""")
def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with cached translations, and others translated while a month's quota of characters lasts."""
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    cache = terms.where("substr(term, 1, 1) < 'h'").withColumn("value", F.lit("held"))
    return connectors.translate_cached(terms, cache, lambda requests: [r.upper() for r in requests], month_used=50, quota=200)


@query("""SELECT p_partkey, regexp_replace(lower(p_name || '_' || p_brand || ' (x)'), '[ _()]', '', 'g') AS compared, 'en-us' AS locale, p_type AS note, CASE WHEN p_size % 2 = 0 THEN p_type END AS prefix,
  p_brand AS spelled, p_size % 3 = 0 AS covered, sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') AS mark FROM part""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, locale codes, notes, glosses, context spellings, title numbers and fingerprints of each part."""
    k, name = F.col("p_partkey"), F.col("p_name")
    gloss = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "(가나)").otherwise("(no)"))
    context = F.concat(F.lit("so "), name, F.lit(" ("), "p_brand", F.lit(") went"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.key_match(F.concat(name, F.lit("_"), "p_brand", F.lit(" (x)"))).alias("compared"), T.locale_code(F.lit(" EN_us ")).alias("locale"), T.qualifier(F.concat(F.lit(" (("), "p_type", F.lit(")"))).alias("note"),
        T.prefix_latin_name(gloss).alias("prefix"), T.context_spelling(name, context).alias("spelled"), T.markers_covered(F.concat(name, F.lit(" 2")), F.concat(F.lit("part "), (F.col("p_size") % 3 + 2).cast("string"))).alias("covered"),
        K.json_fingerprint(k, name).alias("mark"),
    )


@query("""SELECT c_custkey, c_custkey % 4 <> 3 AS open, c_custkey % 4 < 2 AS phrase FROM customer""")
def requestable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's term may be asked for again, by its status and the reason noted behind a mark."""
    k = F.col("c_custkey")
    notes = F.when(k % 4 < 2, "[old] x [gate] no context yet [end] y").otherwise("[gate] spam [end] no context")
    status = F.when(k % 4 == 2, "active").otherwise("rejected")
    return table(spark, sf_dir, "customer").select("c_custkey", T.not_tombstone(status, notes, "[gate]", ["no context"]).alias("open"), T.phrase_in_segment(notes, "[gate]", ["no context", "other"]).alias("phrase"))


@query("""SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY' AND contains(p_name, 'widget')""")
def names_hidden_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a name that a filter by type hides."""
    named = table(spark, sf_dir, "part").where("contains(p_name, 'widget')")
    return matching.hidden_by_type(named, named.where("p_type = 'ECONOMY'"), "p_partkey").select("p_partkey")
