"""Queries over the event log: consensus, demand, coverage, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.functions.text import url_host
from lexora.operators import consensus as C
from lexora.operators import demand as D
from lexora.operators.relational import page_after, top_per_key
from lexora.plans.registry import query
from lexora.sources.tables import observations, table

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


OBSERVATIONS = """obs AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity,
    coalesce(CAST(n_regionkey AS VARCHAR), '-') AS locale, event_type AS spelling, lower(event_type) AS norm,
    n_name AS domain, CAST(n_nationkey % 8 AS BIGINT) AS parent, user_id AS page, 0.5 + (n_nationkey % 5) / 10 AS trust,
    CASE WHEN value < 400 THEN least(1.0, value / 50) END AS confidence, ts AS observed_at
  FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey)"""
WEIGHED = f"""weighed AS (
  SELECT entity, locale, norm, count(DISTINCT coalesce(parent::VARCHAR, domain)) AS parents,
    count(DISTINCT coalesce(nullif(page::VARCHAR, ''), 'domain:' || domain)) AS pages,
    sum(CAST(coalesce(trust, 1.0) * confidence AS DECIMAL(18, 6)))::DOUBLE AS weight
  FROM obs WHERE observed_at > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND confidence >= 0.7
  GROUP BY ALL)"""
MODES = f"""modes AS (
  SELECT entity, locale, norm, spelling FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, locale, norm ORDER BY c DESC, spelling) AS n
    FROM (SELECT entity, locale, norm, spelling, count(*) AS c FROM obs
      WHERE observed_at > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND confidence >= 0.7 GROUP BY ALL)) WHERE n = 1)"""
WINNER = """SELECT entity, locale, norm, parents, pages, round(weight, 3) AS weight, spelling FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, locale ORDER BY weight DESC, parents DESC, norm) AS n
  FROM weighed WHERE parents >= 2 AND pages >= 2 AND weight >= 1.5) JOIN modes USING (entity, locale, norm) WHERE n = 1"""


@query(f"WITH {OBSERVATIONS}, {WEIGHED}, {MODES} {WINNER}")
def consensus_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence-weighted consensus per page key and region."""
    return C.consensus(observations(spark, sf_dir), as_of()).withColumn("weight", F.round("weight", 3))


@query(f"""WITH {OBSERVATIONS}, {WEIGHED} SELECT entity, locale, norm, parents, pages, round(weight, 3) AS weight,
  parents >= 2 AND pages >= 2 AND weight >= 1.5 AS passes FROM weighed WHERE parents > pages OR pages < 2 OR parents < 2""")
def consensus_pages_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that media or pages alone would pass: none of them reaches consensus."""
    w = C.weigh(observations(spark, sf_dir), as_of())
    passes = (F.col("parents") >= 2) & (F.col("pages") >= 2) & (F.col("weight") >= 1.5)
    return w.drop("spelling").where("parents > pages OR pages < 2 OR parents < 2").withColumn("passes", passes).withColumn("weight", F.round("weight", 3))


@query(f"""WITH {OBSERVATIONS}, due AS (
  SELECT DISTINCT entity, locale FROM obs WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2135 MINUTE),
  resting AS (SELECT DISTINCT entity, locale FROM obs WHERE spelling = 'signup' AND observed_at > TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR),
  kept AS (SELECT * FROM obs SEMI JOIN due USING (entity, locale) ANTI JOIN resting USING (entity, locale)),
  {WEIGHED.replace("FROM obs", "FROM kept")}, {MODES} {WINNER}""")
def consensus_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus for pairs that changed lately and are not resting; a signup stands for a promotion."""
    obs = observations(spark, sf_dir)
    rule = C.ConsensusRule(change_minutes=2135)
    promoted = obs.where("spelling = 'signup'").select("entity", "locale", F.col("observed_at").alias("promoted_at"))
    return C.sweep(obs, promoted, as_of(), rule).withColumn("weight", F.round("weight", 3))


@query(f"""WITH {OBSERVATIONS} SELECT entity, locale, norm, count(DISTINCT domain) AS domains, count(*) AS uses FROM obs
  WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL HAVING count(DISTINCT domain) >= 2
  ORDER BY domains DESC, uses DESC, entity, locale, norm LIMIT 100""")
def consensus_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings that most domains used in the last 30 days."""
    return C.screen(observations(spark, sf_dir), as_of())


@query(f"""WITH {OBSERVATIONS}, cand AS (SELECT entity, count(DISTINCT domain) AS media FROM obs WHERE domain IS NOT NULL GROUP BY entity)
  SELECT entity, media FROM cand SEMI JOIN (SELECT entity FROM obs WHERE spelling = 'purchase' AND confidence = 1.0) a USING (entity) WHERE media >= 2""")
def candidate_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page keys that several media report and a full-confidence purchase anchors."""
    obs = observations(spark, sf_dir)
    found = obs.where("domain IS NOT NULL").groupBy("entity").agg(F.collect_set("domain").alias("domains"))
    return C.promotable(found, obs.where("spelling = 'purchase' AND confidence = 1.0")).select("entity", F.size("domains").cast("long").alias("media"))


@query("""SELECT event_type AS term, s.hosts, s.days, m.shown FROM (
    SELECT event_type, count(DISTINCT user_id) AS hosts, count(DISTINCT date_trunc('day', ts)) AS days FROM events
    WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 60 DAY GROUP BY 1 HAVING count(DISTINCT user_id) >= 2 AND count(DISTINCT date_trunc('day', ts)) >= 3) s
  JOIN (SELECT event_type, k AS shown FROM (
    SELECT event_type, props AS k, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, props) AS n FROM events GROUP BY event_type, props) WHERE n = 1) m USING (event_type)""")
def demand_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that several hosts asked for on several days, with the form most used."""
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("term"), F.col("user_id").alias("host"), F.col("props").alias("form"), F.col("ts").alias("at"))
    return D.demand_evidence(asked, as_of())


@query("""SELECT regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) AS host, count(*) AS pages,
  string_agg(page_id::VARCHAR, ',' ORDER BY page_id) FILTER (WHERE n <= 3) AS first_pages FROM (
  SELECT *, row_number() OVER (PARTITION BY regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) ORDER BY page_id) AS n FROM pages) GROUP BY 1""")
def demand_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, with the first three."""
    rows = table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host"), "page_id")
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    first = top_per_key(rows, ["host"], [F.asc("page_id")], 3).groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), ",").alias("first_pages"))
    return total.join(first, "host")


GAP_TERMS = "SELECT 'user-' || (user_id * 11) AS term, event_type AS kind FROM events"
GAP_KNOWN = "SELECT 'user-' || c_custkey FROM customer"


@query(f"""WITH t AS ({GAP_TERMS}), per AS (SELECT kind, term, count(*) AS asked FROM t WHERE term NOT IN ({GAP_KNOWN}) GROUP BY ALL)
  SELECT kind, count(*) AS terms, sum(asked)::BIGINT AS asked, string_agg(term, ',' ORDER BY n) FILTER (WHERE n <= 10) AS examples FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY asked DESC, term) AS n FROM per) GROUP BY kind""")
def unmet_gap_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for terms that no customer answers, by kind, with the ten most asked."""
    terms = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), (F.col("user_id") * 11).cast("string")).alias("term"), F.col("event_type").alias("kind"))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("name"))
    return D.unmet(terms, known)


@query("""WITH l AS (SELECT c_mktsegment AS type, unnest(['name', 'segment', 'balance']) AS locale,
    unnest([CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END, CASE WHEN c_acctbal > 0 THEN c_acctbal::VARCHAR END]) AS v FROM customer)
  SELECT type, locale, count(*) AS rows, count(v) AS filled, count(*) - count(v) AS missing, round(100.0 * count(v) / count(*), 1)::DOUBLE AS pct FROM l GROUP BY ALL""")
def locale_gap_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled and missing values of each attribute and type, in one pass."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("type"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
    )
    return D.locale_gaps(rows, ["type"], {"name": "name", "segment": "segment", "balance": "balance"})


@query("""SELECT event_type AS locale, count(*) AS asked, count_if(c_custkey IS NOT NULL AND c_acctbal > 0) AS answered,
  round(100.0 * count_if(c_custkey IS NOT NULL AND c_acctbal > 0) / count(*), 1)::DOUBLE AS pct
  FROM events LEFT JOIN customer ON c_custkey = user_id * 11 GROUP BY 1""")
def answer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of requests answered, by event type."""
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("locale"), (F.col("user_id") * 11).alias("key"))
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("answered"))
    return D.answer_matrix(asked, held, "key", "locale")


@query("""SELECT bucket, count(*) AS terms FROM (
  SELECT e.user_id, CASE min(CASE WHEN c_custkey IS NULL THEN 4 WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal < 0 THEN 2 ELSE 3 END)
    WHEN 1 THEN 'answerable' WHEN 2 THEN 'rejected' WHEN 3 THEN 'candidate' ELSE 'none' END AS bucket
  FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN customer ON c_custkey % 150 = e.user_id GROUP BY 1) GROUP BY 1""")
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best bucket that the entities of each term reach."""
    terms = table(spark, sf_dir, "events").select(F.col("user_id").alias("term")).distinct()
    state = F.when(F.col("c_acctbal") > 5000, "answerable").when(F.col("c_acctbal") < 0, "rejected").otherwise("candidate")
    held = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 150).alias("term"), state.alias("state"))
    return D.coverage(terms, held)


RUNS = "SELECT event_type AS lane, date_trunc('day', ts) AS day_at, count(*) AS scanned, count_if(value > 250) AS applied FROM events GROUP BY ALL"


@query(f"""WITH r AS ({RUNS}), n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY day_at DESC) AS n FROM r),
  s AS (SELECT *, sum(CASE WHEN NOT (scanned > 0 AND applied = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY n) AS broken FROM n WHERE n <= 10)
  SELECT lane, count(*) AS runs, count_if(broken = 0) AS streak, count_if(broken = 0) >= 3 AS silent, sum(scanned)::BIGINT AS scanned, sum(applied)::BIGINT AS applied FROM s GROUP BY lane""")
def silent_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes whose latest runs scan rows and apply none."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lane"), F.date_trunc("day", "ts").alias("at")).agg(F.count("*").alias("scanned"), F.count_if(F.col("value") > 250).alias("applied"))
    return D.silent_lanes(runs)


@query("""WITH s AS (SELECT user_id AS role, event_id, ts, event_type = 'error' AS failed,
    sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
  SELECT role, island, count(*) AS failures, min(event_id) AS first_event, max(event_id) AS last_event FROM s WHERE failed GROUP BY ALL HAVING count(*) >= 3""")
def incident_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more errors of a user in a row, closed by the next success."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("role"), "event_id", F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return D.incidents(rows)


@query("""SELECT user_id AS key, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS calls, count(*) > 1 AS limited FROM events GROUP BY ALL""")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user in each minute, a tumbling window, against a limit."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return D.rate_windows(rows, "1 minute", 1)


@query("""SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def dedup_keep_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest request of each type and user."""
    return top_per_key(table(spark, sf_dir, "events"), ["event_type", "user_id"], [F.asc("ts"), F.asc("event_id")]).select("event_type", "user_id", "event_id")


@query("""WITH t AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
  o AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS last_order FROM orders GROUP BY 1)
  SELECT user_id, event_id, event_type, status, last_order FROM t LEFT JOIN o ON o_custkey = user_id WHERE n = 1""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's latest event with the latest order, as one join of keyed firsts."""
    last = top_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max("o_orderkey").alias("last_order"))
    return last.join(orders, "user_id", "left")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey > 100)
  ORDER BY o_orderdate, o_orderkey LIMIT 51""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders behind a cursor, and one more row."""
    at = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey", (at, 100), 50).select("o_orderkey", "o_custkey")


@query("""SELECT o_custkey, o_orderkey, total, shown FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS total,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n,
  max_by(o_orderstatus, o_orderkey) OVER (PARTITION BY o_custkey) AS shown FROM orders) WHERE n = 1""")
def window_total_with_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer beside the count and the last status."""
    all_ = Window.partitionBy("o_custkey")
    latest = all_.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumns({"total": F.count("*").over(all_), "shown": F.max_by("o_orderstatus", "o_orderkey").over(all_), "n": F.row_number().over(latest)})
    return rows.where("n = 1").select("o_custkey", "o_orderkey", "total", "shown")


@query("""SELECT entity, form, votes, votes >= 2 AS accepted FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY votes DESC, form) AS n FROM (
    SELECT user_id AS entity, event_type AS form, count(*) AS votes FROM events GROUP BY ALL)) WHERE n = 1""")
def extraction_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that most independent extractions agree on."""
    return _voted(table(spark, sf_dir, "events"))


def _voted(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("id"), F.col("event_type").alias("form"))
    texts = rows.select("id").distinct().withColumn("text", F.lit(""))
    return C.vote(rows, texts).select(F.col("id").alias("entity"), "form", "votes", "accepted")


@query("""SELECT status, count(*) AS terms, sum(asked)::BIGINT AS asked FROM (SELECT user_id, count(*) AS asked,
  CASE min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END)
    WHEN 1 THEN 'purchase' WHEN 2 THEN 'signup' WHEN 3 THEN 'click' WHEN 4 THEN 'view' ELSE 'error' END AS status FROM events GROUP BY user_id) GROUP BY 1""")
def best_status_per_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's best status by a fixed order, tallied."""
    order = ["purchase", "signup", "click", "view", "error"]
    best = D.best_status(table(spark, sf_dir, "events"), "user_id", "event_type", order)
    return best.groupBy("status").agg(F.count("*").alias("terms"), F.sum("asked").alias("asked"))
