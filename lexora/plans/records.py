"""Queries over stored requests, rows kept up to date, types from evidence and picked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions import rank as K
from lexora.operators import gate, maintenance, preparations
from lexora.plans.registry import query
from lexora.plans.values import choose
from lexora.sources import connectors, picks
from lexora.sources.tables import table


def _string(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("""WITH r AS (SELECT o_orderkey AS arrival, o_custkey AS owner, CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderpriority END AS key, o_orderstatus AS term, o_orderkey % 97 = 0 AS bad FROM orders),
  f AS (SELECT owner, key, min(arrival) AS first, arg_min(term, arrival) AS said FROM r WHERE NOT bad GROUP BY ALL)
  SELECT arrival, CASE WHEN bad THEN 'invalid_locale' WHEN key = '' OR arrival = first THEN 'created' WHEN term = said THEN 'replayed' ELSE 'conflict' END AS outcome FROM r LEFT JOIN f USING (owner, key)""")
def stored_preparations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each order as a request for preparation: a customer's priority is its key, the status its term."""
    o = table(spark, sf_dir, "orders")
    term = F.struct(F.col("o_orderstatus").alias("term"), F.lit("person").alias("type"), F.lit("").alias("context"), F.lit("").alias("entity_id"))
    requests = o.select(
        F.col("o_orderkey").alias("arrival"), _string("o_custkey").alias("owner"), F.when(~F.startswith("o_orderpriority", F.lit("5")), F.col("o_orderpriority")).alias("key"), F.lit("").alias("catalog"), F.array(term).alias("terms"),
        F.array(F.when(F.col("o_orderkey") % 97 == 0, "xx").otherwise("en")).alias("locales"), F.lit("").alias("source_url"), F.lit("").alias("article_id"), F.lit("").alias("article_version"),
    )
    return preparations.create(spark.createDataFrame([], preparations.PREPARATION), requests, F.lit("2024-01-01")).answers.select("arrival", "outcome")


@query("""WITH p AS (SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS now, o_orderstatus = 'F' AS gone FROM orders),
  a AS (SELECT l_orderkey * 10 + l_linenumber AS arrival, l_orderkey AS id, l_linenumber % 5 AS revision, l_returnflag <> 'R' AND l_linenumber % 5 >= 1 AS fit FROM lineitem),
  m AS (SELECT * FROM a LEFT JOIN p USING (id)), d AS (SELECT id, min(arrival) AS done FROM m WHERE fit AND NOT gone AND revision = now GROUP BY 1)
  SELECT arrival, CASE WHEN NOT fit THEN 'invalid' WHEN now IS NULL THEN 'not_found' WHEN revision <> now + CASE WHEN arrival > done THEN 1 ELSE 0 END THEN 'stale' WHEN gone OR arrival > done THEN 'already_cancelled' ELSE 'cancelled' END AS outcome
  FROM m LEFT JOIN d USING (id)""")
def cancelled_preparations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each line of an order as a cancellation of that order as a preparation."""
    k, line = F.col("o_orderkey"), F.col("l_linenumber")
    stored = table(spark, sf_dir, "orders").select(F.lit("o").alias("owner"), k.alias("id"), (k % 3 + 1).alias("revision"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("preparing").alias("status"))
    asks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("arrival"), F.lit("o").alias("owner"), F.col("l_orderkey").alias("id"), (line % 5).cast("long").alias("revision"), F.when(F.col("l_returnflag") != "R", "why").otherwise(" ").alias("reason"))
    states = spark.createDataFrame([], "id long, state string, value string, reason string, observed_at timestamp")
    return preparations.cancel(stored, states, asks, F.lit("2024-01-01"))[0].select("arrival", "outcome")


@query("""WITH a AS (SELECT DISTINCT l_orderkey + 1 AS id FROM lineitem)
  SELECT id, o_orderkey IS NOT NULL AS found, o_orderstatus AS status, o_orderpriority AS locale FROM a LEFT JOIN orders ON o_orderkey = id""")
def correction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the orders, as corrections, whose ids follow those of all lines."""
    none = F.lit("")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("locale"), none.alias("suggested"), none.alias("proposed"), none.alias("resolution"))
    return preparations.correction_status(rows, table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("id"))).select("id", "found", "status", "locale")


REQUESTED = [" Game", "unheard", "", "term"]
TEXTS = ["연극 공연 무대", "FC 공연", "no cue", "월간 화보"]


@query("""SELECT p_partkey, CASE WHEN q = 0 THEN 'game' WHEN q = 3 THEN 'term' WHEN n = 0 THEN 'drama' WHEN p_size % 5 = 0 THEN 'movie' WHEN p_size % 5 = 1 THEN 'group' WHEN t = 0 THEN 'musical_play' WHEN t = 1 THEN 'event_tour' WHEN t = 3 THEN 'publication' ELSE 'unknown' END AS type,
  CASE WHEN q IN (0, 3) OR n = 0 THEN 'consumer-type' WHEN p_size % 5 < 2 THEN 'wikidata-p31' WHEN t = 2 THEN '' ELSE 'context-cue' END AS source
  FROM (SELECT p_partkey, p_size, p_partkey % 4 AS q, p_partkey % 3 AS n, (p_partkey // 12) % 4 AS t FROM part)""")
def typed_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each part and what it is taken from: a request, a note, claimed classes, cues in a text."""
    k = F.col("p_partkey")
    notes = F.when(k % 3 == 0, "x 소비자 type힌트=drama y").otherwise("소비자 type힌트=other")
    classes = F.array(F.lit(None).cast("string"), F.lit("Q0"), F.concat(F.lit("Q"), _string(F.col("p_size") % 5 + 1)))
    found = gate.type_from_evidence(choose(k, REQUESTED), notes, classes, {"Q1": "movie", "Q2": "group"}, choose(F.floor(k / 12), TEXTS))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.type", "f.source")


@query("""WITH m AS (SELECT o_custkey AS c_custkey, count(*) || ':' || sum(CAST('0x' || substr(md5(o_orderkey || '|' || o_orderstatus), 1, 15) AS BIGINT)) AS mark FROM orders GROUP BY 1)
  SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN md5(c_custkey || '|' || c_name || '|' || coalesce(mark, '')) ELSE 'old' END AS input_hash FROM customer LEFT JOIN m USING (c_custkey)""")
def refreshed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of customers with their orders, made again where an order in progress counts as changed."""
    children = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    parents = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("old").alias("input_hash"))
    return maintenance.refresh_hashes(parents, children.where("o_orderstatus = 'P'"), "c_custkey", ["c_custkey", "c_name"], [(children, ["o_orderkey", "o_orderstatus"])]).select("c_custkey", "input_hash")


OLDER = ["drama", "school", "brand_place"]


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 7 <> 0 AS had, s_suppkey % 5 <> 0 AS has, s_suppkey % 8 = 0 AS lock, s_suppkey % 6 = 0 AS merged, s_suppkey % 11 <> 0 AS own, s_suppkey % 13 <> 0 AS wrote,
    CASE s_suppkey % 3 WHEN 1 THEN 'organization' ELSE 'work' END AS old, CASE (s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 3 WHEN 1 THEN 'organization' ELSE 'work' END AS new,
    s_suppkey % 4 = 0 AS moved FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey % 5 <> 0),
  a AS (SELECT *, CASE WHEN NOT had THEN 'insert' WHEN NOT has AND wrote THEN 'retire' WHEN NOT has THEN 'keep' WHEN NOT (moved OR lock OR merged) THEN 'keep' WHEN NOT own THEN 'fault' WHEN NOT wrote AND lock THEN 'lock' WHEN NOT wrote THEN 'keep'
    WHEN old <> new OR lock OR merged THEN 'update' ELSE 'keep' END AS act FROM s)
  SELECT id, CASE WHEN act IN ('insert', 'update') THEN new ELSE old END AS type, CASE WHEN act = 'insert' OR act = 'update' AND old <> new THEN NULL ELSE 's' END AS subtype,
    CASE WHEN act = 'retire' OR act IN ('insert', 'update') AND merged THEN 'retired' ELSE 'active' END AS status, act = 'lock' OR act IN ('insert', 'update') AND lock AS locked, CASE WHEN act IN ('update', 'retire', 'lock') THEN 2 ELSE 1 END AS revision FROM a""")
def synced_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a projection of an older table, after rows of that table came, changed and went."""
    k, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    none, day = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    before = rows.where("s_suppkey % 7 <> 0").select(k.alias("id"), choose(k, OLDER).alias("type"), F.col("s_name").alias("name"), F.lit("active").alias("status"), F.lit(False).alias("locked"), none.alias("qualifier"))
    after = rows.where("s_suppkey % 5 <> 0").select(k.alias("id"), choose(k + F.when(k % 4 == 0, 1).otherwise(0), OLDER).alias("type"), F.col("s_name").alias("name"), F.when(k % 6 == 0, "merged").otherwise("active").alias("status"), (k % 8 == 0).alias("locked"), F.lit(" ").alias("qualifier"))
    owner = lambda n, other: F.when(F.col("id") % n == 0, other).otherwise("legacy")
    projected = before.select(
        "id", K.common_type(F.col("type")).alias("type"), F.lit("s").alias("subtype"), "name", owner(11, "other").alias("origin"), owner(13, "platform").alias("write_owner"), "status", "locked", "qualifier",
        F.lit(1).cast("long").alias("revision"), day.alias("updated_at"),
    )
    return maintenance.sync_projection(projected, before, after, day)[0].select("id", "type", "subtype", "status", "locked", F.col("revision").cast("int").alias("revision"))


KINDS = ["brand_place", "company", "term", "event_tour", "game", "unknown", "school", "group", "location"]
COMMON = ["work", "company", "concept", "event", "work", "unknown", "organization", "organization", "location"]


@query(f"""SELECT s_suppkey, ({COMMON})[s_suppkey % 9 + 1] AS common FROM supplier""")
def common_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common type of each supplier's older type."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.common_type(choose(F.col("s_suppkey"), KINDS)).alias("common"))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 3 ELSE 2 END AS film FROM part WHERE p_size % 3 < 2""")
def picked_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a film service's answer that is named as asked, for each part; none where no record is."""
    film = lambda n, shown, original: F.struct(F.lit(n).alias("id"), shown.alias("title"), original.alias("original_title"))
    size, name = F.col("p_size") % 3, F.col("p_name")
    other = F.concat(name, F.lit(" two"))
    listed = F.array(film(1, F.col("p_brand"), other), film(2, other, F.when(size == 1, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(other)), film(3, F.when(size == 2, other).otherwise(F.upper(name)), other))
    bodies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(name, F.lit("!")).alias("wanted"), F.to_json(F.struct(listed.alias("results"))).alias("body"))
    return picks.pick_film(connectors.records(bodies, "film_titles", "position", "record_")).select("id", F.col("film").cast("int").alias("film"))


@query("""SELECT page_id AS id, CASE WHEN contains(regexp_replace(html, '<[^>]+>', '', 'g'), CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'qqq' END) THEN 'confirmed' ELSE 'review' END AS verdict FROM pages WHERE html IS NOT NULL""")
def role_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page, as an encyclopedia entry, tells a role of the type asked for."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    entries = pages.select(F.col("page_id").alias("id"), F.lit(0).alias("position"), F.col("url").alias("title"), F.col("html").alias("description"))
    asked = pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("type"))
    return picks.role_verdict(entries, asked, {"even": ["a"], "odd": ["qqq"]}).select("id", "verdict")
