"""Queries over queues, runs and guards, and parity queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions import rank as K
from lexora.functions import text as T
from lexora.operators import gate
from lexora.operators import quality as Q
from lexora.plans.registry import query
from lexora.sources.tables import table

AS_OF = "2001-08-02"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


QUEUE = "queue AS (SELECT o_orderkey, o_orderdate AS created, max(l_shipdate) AS finished FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"""WITH {QUEUE}, t AS (SELECT epoch(finished - created)::BIGINT AS took FROM queue WHERE finished >= created)
  SELECT count(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY took)::DOUBLE AS median, round(avg(took), 3) AS mean, count_if(took > 86400 * 365) AS over FROM t""")
def sla_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, mean and overruns from order to last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("finished"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(last, "o_orderkey")
    return Q.latency(rows, "o_orderdate", "finished", 86400 * 365).withColumn("mean", F.round("mean", 3))


@query(f"""SELECT condition, count(*) AS waiting, count_if(age > 1500) AS late, max(age) AS oldest_days FROM (
  SELECT date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') AS age, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'urgent' END, CASE WHEN o_totalprice > 400000 THEN 'large' END], lambda x: x IS NOT NULL)) AS condition FROM orders) GROUP BY 1""")
def backlog_ageing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting, late and oldest rows of each named condition, in one pass."""
    conditions = {"pending": F.col("o_orderstatus") == "P", "urgent": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F"), "large": F.col("o_totalprice") > 400000}
    rows = Q.backlogs(table(spark, sf_dir, "orders"), "o_orderdate", _as_of(), conditions, 1500)
    return rows.withColumn("oldest_days", F.col("oldest_days").cast("long"))


@query("""WITH e AS (SELECT c_custkey % 400 AS name, c_acctbal > 0 AS ready FROM customer), q AS (SELECT DISTINCT o_custkey % 500 AS name FROM orders),
  h AS (SELECT name, count(*) AS n, bool_or(ready) AS partly, bool_and(ready) AS every FROM e GROUP BY 1)
  SELECT CASE WHEN every THEN 'served' WHEN partly THEN 'partly' WHEN n > 0 THEN 'preparing' WHEN q.name IS NOT NULL THEN 'queued' ELSE 'unknown' END AS state, count(*) AS names
  FROM (SELECT DISTINCT c_custkey % 600 AS name FROM customer) t LEFT JOIN h USING (name) LEFT JOIN q USING (name) GROUP BY 1""")
def readiness_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by how far they are served."""
    customer = table(spark, sf_dir, "customer")
    return _funnel(customer, customer, table(spark, sf_dir, "orders"))


def _funnel(customer: DataFrame, entities: DataFrame, queued: DataFrame) -> DataFrame:
    held = entities.select((F.col("c_custkey") % 400).alias("name"), (F.col("c_acctbal") > 0).alias("ready"))
    waiting = queued.select((F.col("o_custkey") % 500).alias("name"))
    return Q.funnel(customer.select((F.col("c_custkey") % 600).alias("name")), held, waiting)


@query("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS used, count(*) AS calls FROM orders GROUP BY 1""")
def monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of each month."""
    return table(spark, sf_dir, "orders").groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("used"), F.count("*").alias("calls"))


@query("""SELECT c_nationkey, count(*) AS rows, count_if(v IS NULL) AS missing, count_if(v IS NULL AND ok AND NOT b) AS fillable, count_if(v IS NULL AND b) AS blocked, count_if(v IS NULL AND NOT ok) AS ineligible
  FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN c_name END AS v, c_custkey % 5 = 0 AS b, c_mktsegment <> 'BUILDING' AS ok FROM customer) GROUP BY 1""")
def supply_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of each nation by what stops them."""
    rows = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return Q.supply(rows, ["c_nationkey"], "v", F.col("c_custkey") % 5 == 0, F.col("c_mktsegment") != "BUILDING")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND greatest(o_orderdate, CASE WHEN o_orderkey % 10 = 0 THEN TIMESTAMP '2001-07-20' ELSE o_orderdate END) < TIMESTAMP '2001-08-02' - INTERVAL 21 DAY""")
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders whose clock ran out; every tenth was reopened late."""
    notes = F.when(F.col("o_orderkey") % 10 == 0, "seen [reopened:1999-01-02] again [reopened:2001-07-20]")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created"), notes.alias("notes"))
    return Q.expired(rows, "created", "notes", F.lit(AS_OF).cast("timestamp")).select("o_orderkey")


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS k FROM orders), r AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS k FROM orders)
  SELECT k, 'lost' AS leak FROM s WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT DISTINCT k, 'extra' FROM r WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT k, 'twice' FROM r GROUP BY k HAVING count(*) > 1""")
def item_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids selected but not reported, reported but not selected, or reported twice; some orders stand for each."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    selected = orders.select(F.when(key % 11 == 0, -key).otherwise(key).alias("k"))
    reported = orders.select(F.when(key % 13 == 0, key + 1).otherwise(key).alias("k"))
    return Q.conservation(selected, reported, "k")


@query("""SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A' AND l_shipdate > TIMESTAMP '2001-01-01')""")
def retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows not yet tried with the same input inside the revisit window."""
    return _due(spark, sf_dir, table(spark, sf_dir, "orders"))


def _due(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    rows = orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("input_hash"))
    tried = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_orderkey").alias("input_hash"), F.col("l_shipdate").alias("last_at"), F.lit(True).alias("exhausted"))
    return Q.retry_due(rows, tried, ["o_orderkey"], F.lit("2001-01-02").cast("timestamp_ntz"), 1).select("o_custkey", "o_orderkey")


@query("""SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal > 9000 THEN 'authoritative' WHEN n > 700 THEN 'evidenced' ELSE 'unverified' END AS tier FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1) ON l_suppkey = s_suppkey
  WHERE CASE WHEN s_acctbal > 9000 THEN 'authoritative' WHEN n > 700 THEN 'evidenced' ELSE 'unverified' END <> CASE WHEN s_suppkey % 2 = 0 THEN 'evidenced' ELSE 'unverified' END""")
def tier_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose verification tier changed."""
    n = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    evidence = F.when(F.col("n") > 700, 1).otherwise(0)
    computed = supplier.join(n, "s_suppkey", "left").select("s_suppkey", K.verification_tier(F.when(F.col("s_acctbal") > 9000, 1).otherwise(0), evidence).alias("tier"))
    stored = supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "evidenced").otherwise("unverified").alias("tier"))
    changed = Q.tier_changes(stored, computed, "s_suppkey")
    return changed.join(supplier, "s_suppkey").select("s_suppkey", "s_acctbal", F.col("now").alias("tier"))


@query("""SELECT status, attempts, count(*) AS rows FROM (SELECT CASE WHEN stale AND a >= 3 THEN 'failed' WHEN stale THEN 'pending' ELSE status END AS status, a AS attempts FROM (
  SELECT *, n + CASE WHEN stale THEN 1 ELSE 0 END AS a FROM (SELECT CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderkey % 4 AS n, o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 10 MINUTE AS stale FROM orders))) GROUP BY ALL""")
def lease_reaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows after stale leases were freed."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("leased_at"), (F.col("o_orderkey") % 4).alias("attempts"))
    return Q.leases(rows, _as_of()).groupBy("status", "attempts").agg(F.count("*").alias("rows"))


@query("""SELECT id, turn FROM (SELECT o_orderkey AS id, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS turn FROM orders) ORDER BY turn, o_orderdate, id LIMIT 500""")
def qa_work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 500 rows to check."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("requested"), (F.col("o_orderstatus") == "P").alias("unfilled"), F.col("o_orderdate").alias("updated"))
    return Q.work_order(rows, 500).select("id", "turn")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'duplicate' WHEN c_custkey % 5 = 0 AND c_custkey % 40 <= 30 AND c_custkey % 3 > 0 THEN 'reuse_' || CASE WHEN c_custkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END
  WHEN c_custkey % 17 = 0 THEN 'reject_charset' WHEN c_nationkey < 5 THEN 'auto_apply' WHEN c_acctbal > 5000 AND c_mktsegment = 'BUILDING' THEN 'fill_blank' WHEN c_acctbal > 5000 THEN 'verify' ELSE 'queue' END AS action FROM customer""")
def correction_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each submitted correction goes."""
    k = F.col("c_custkey")
    facts = table(spark, sf_dir, "customer").select(
        "c_custkey", (k % 13 == 0).alias("in_flight"), F.when(k % 5 == 0, F.when(k % 2 == 0, "accepted").otherwise("rejected")).alias("prior_verdict"), (k % 40).alias("prior_days"), (k % 3 == 0).alias("new_evidence"),
        (k % 17 != 0).alias("valid_charset"), (F.col("c_nationkey") < 5).alias("corroborated"), (F.col("c_acctbal") > 5000).alias("trusted"), (F.col("c_mktsegment") == "BUILDING").alias("blank"),
    )
    return Q.correction_decision(facts).select("c_custkey", "action")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN 'identity_unproven' WHEN c_acctbal <= 0 AND c_custkey % 4 = 0 THEN 'unfillable' WHEN c_acctbal <= 0 THEN 'missing' WHEN c_mktsegment = 'MACHINERY' THEN 'policy_blocked'
  WHEN c_custkey % 9 = 0 THEN 'ambiguous' WHEN c_nationkey < 6 THEN 'machine_only' WHEN c_nationkey < 12 THEN 'unverified' ELSE 'ready' END AS state FROM customer""")
def locale_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness of each customer's name."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    state = Q.readiness(F.when(F.col("c_acctbal") > 0, F.col("c_name")), n >= 12, n < 6, k % 4 == 0, F.col("c_mktsegment") != "MACHINERY", k % 31 != 0, k % 9 != 0)
    return table(spark, sf_dir, "customer").select("c_custkey", state.alias("state"))


LABELS = ["operator", "media-consensus", "rss-observation:x", "tmdb", "wikidata-label", "kowiki-hanja", "opencc", "gtranslate", "llm-provisional", "other"]
RANKS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 99]


@query(f"""WITH r AS (SELECT event_id, ({LABELS})[event_id % 10 + 1] AS own, ({LABELS})[event_id // 10 % 10 + 1] AS fresh, ({RANKS})[event_id % 10 + 1] AS a, ({RANKS})[event_id // 10 % 10 + 1] AS b, event_id % 3 = 0 AS same FROM events)
  SELECT own, fresh, a, b, own <> 'operator' AND b < a AS replaces, own <> 'operator' AND b = a AND NOT same AS drift, count(*) AS n FROM r GROUP BY ALL""")
def source_priority_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two sources wins, and where equal ones drift apart."""
    labels = F.array(*map(F.lit, LABELS))
    at = lambda c: F.element_at(labels, (c + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(at(F.col("event_id") % 10).alias("own"), at(F.floor(F.col("event_id") / 10) % 10).alias("fresh"), F.when(F.col("event_id") % 3 == 0, "x").otherwise("y").alias("v"))
    decided = rows.select("own", "fresh", K.source_priority(F.col("own")).alias("a"), K.source_priority(F.col("fresh")).alias("b"), K.replace_decision(F.col("own"), F.lit("x"), F.col("fresh"), F.col("v")).alias("d"))
    return decided.groupBy("own", "fresh", "a", "b", F.col("d.replace").alias("replaces"), F.col("d.drift").alias("drift")).agg(F.count("*").alias("n"))


ASCII_TEXT = "regexp_replace(text, '[^ -~]', '', 'g')"


@query(f"""SELECT doc_id, md5(regexp_replace(lower(trim(a)), '[[:space:][:punct:]]+', '', 'g')) AS posix, md5(regexp_replace(lower(a), '[\\s''"`]', '', 'g')) AS cluster,
  md5(trim(regexp_replace(lower(replace(a, '-', ' ')), '\\s+', ' ', 'g'))) AS spelling FROM (SELECT doc_id, {ASCII_TEXT} AS a FROM documents)""")
def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three normalised keys of every document's ASCII text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("a"))
    digest = lambda c: F.md5(c.cast("binary"))
    return rows.select("doc_id", digest(T.key_posix(F.col("a"))).alias("posix"), digest(T.key_cluster(F.col("a"))).alias("cluster"), digest(T.spelling(F.col("a"))).alias("spelling"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("body"))


@query(r"""SELECT doc_id, lang, trim(text) <> '' AND NOT regexp_matches(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]') AND
  CASE lang WHEN 'en' THEN NOT regexp_matches(text, '[가-힣]|\p{Han}|\p{Hiragana}|\p{Katakana}') WHEN 'es' THEN NOT regexp_matches(text, '[가-힣]|\p{Han}|\p{Hiragana}|\p{Katakana}') ELSE true END AS ok FROM documents""")
def charset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text's scripts fit its language."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.valid_for_locale(F.col("text"), F.col("lang")).alias("ok"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^a-zA-Z0-9]+')) AS term FROM documents)
  SELECT term, CASE WHEN term = '' OR NOT regexp_matches(lower(term), '[a-z]') OR mash OR length(term) > 20 THEN 'reject' WHEN regexp_matches(term, '[0-9]') OR length(term) = 1 THEN 'review' ELSE 'pass' END AS verdict,
    CASE WHEN term = '' THEN 'empty' WHEN NOT regexp_matches(lower(term), '[a-z]') THEN 'no_letter' WHEN mash THEN 'mash' WHEN length(term) > 20 THEN 'len_gt_max' WHEN regexp_matches(term, '[0-9]') THEN 'digits' WHEN length(term) = 1 THEN 'single_char' ELSE 'plain' END AS reason
  FROM (SELECT term, regexp_matches(lower(term), 'MASH') OR regexp_matches(lower(term), '[bcdfghjklmnpqrstvwxz]{7}') AS mash FROM w)""".replace("MASH", "|".join(T.KEY_RUNS)))
def intake_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Latin part of the intake gate over the Latin words of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", "[^a-zA-Z0-9]+"))).alias("term")).distinct()
    return words.select("term", gate.latin_gate(F.col("term")).alias("g")).select("term", "g.verdict", "g.reason")


@query(r"""SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) AS host, regexp_matches(lower(url), '^[a-z]+://([^/:?#]*\.)?example\.(com|org)([/:?#]|$)') AS trusted FROM pages""")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, and whether they are on a trusted domain."""
    trusted = T.trusted_domain(F.col("url"), ["example.com", "example.org"])
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), trusted.isNotNull().alias("trusted"))


@query("""SELECT o_orderkey, CASE p WHEN 0 THEN make_date(y, m, d) WHEN 1 THEN make_date(y, m, 1) WHEN 2 THEN make_date(y, 1, 1) END::VARCHAR AS first_day,
  CASE p WHEN 0 THEN make_date(y, m, d) WHEN 1 THEN last_day(make_date(y, m, 1)) WHEN 2 THEN make_date(y, 12, 31) END::VARCHAR AS last_day
  FROM (SELECT o_orderkey, o_orderkey % 4 AS p, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)""")
def possible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that dates of lower precision can mean."""
    precision = F.element_at(F.array(*map(F.lit, ["day", "month", "year", "open"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    parts = (precision, F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.possible_range(*parts).cast("string").alias("first_day"), K.possible_range(*parts, end=True).cast("string").alias("last_day"))
