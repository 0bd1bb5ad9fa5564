"""Queries over values, guards and verdicts: names' variants, sources of shown values, anchors, repairs, refused writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions import rank as K
from lexora.functions import text as T
from lexora.operators import matching, resolve
from lexora.operators import quality as Q
from lexora.operators import relational as R
from lexora.plans.registry import query
from lexora.sources.tables import table


def choose(c: Column, values: list) -> Column:
    """One of some values by a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


@query("""SELECT p_name, p_brand, p_name || ' (' || p_brand || ')|' || p_name || '|' || p_brand AS variants, p_name AS stripped,
  CASE WHEN regexp_full_match(kind, '[A-Za-z][A-Za-z .&-]*') THEN kind END AS latin
  FROM (SELECT DISTINCT p_name, replace(p_brand, '#', ' no ') AS p_brand, split_part(p_type, ' ', 1) AS kind FROM part)""")
def name_variant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name with its parenthesised gloss: its variants, the name without the gloss, and a Latin name in parentheses."""
    part = table(spark, sf_dir, "part").select("p_name", F.replace("p_brand", F.lit("#"), F.lit(" no ")).alias("p_brand"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind")).distinct()
    shown = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    latin = T.paren_latin_name(F.concat("p_name", F.lit(" ("), "kind", F.lit(")")))
    stripped = T.strip_annotation(F.concat("p_name", F.lit(" (Source)")), ["source"])
    return part.select("p_name", "p_brand", F.array_join(T.name_variants(shown), "|").alias("variants"), stripped.alias("stripped"), latin.alias("latin"))


@query("""SELECT doc_id, length(q) >= 10 AND contains(t, q) AS grounded FROM (SELECT doc_id,
  regexp_replace(lower(text), '[ \\t\\n\\v\\f\\r''"‘’“”]+', '', 'g') AS t, regexp_replace(lower(substr(text, 5, doc_id % 40 + 1)), '[ \\t\\n\\v\\f\\r''"‘’“”]+', '', 'g') AS q FROM documents)""")
def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote of each document is long enough and stands in it."""
    quote = F.substring("text", F.lit(5), (F.col("doc_id") % 40 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.quote_grounded(quote, F.col("text")).alias("grounded"))


SOURCES = ["operator", "wikidata-label", "tmdb", "musicbrainz", "gtranslate", "kana-rule", "llm-provisional", "opencc"]
CLASSES = ["operator", "knowledge_base", "film_database", "music_database", "translation", "rule", "machine", "rule"]
MACHINES = ["gtranslate", "kana-rule", "llm-provisional", "opencc"]


@query(f"""WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ({SOURCES})[c_custkey % 8 + 1] ELSE 'wikidata-label' END AS shown, CASE WHEN c_acctbal > 0 THEN c_name END AS value, ({SOURCES})[c_custkey % 8 + 1] AS own,
    CASE WHEN c_nationkey < 8 THEN 'authoritative' WHEN c_nationkey < 16 THEN 'evidenced' ELSE 'unverified' END AS tier, c_custkey % 3 = 0 AS exhausted FROM customer)
  SELECT c_custkey, shown, ({CLASSES})[list_position({SOURCES}, shown)] AS class, shown NOT IN ({", ".join(f"'{m}'" for m in MACHINES)}) AND tier <> 'unverified' AS verified,
    CASE WHEN value IS NOT NULL THEN NULL WHEN own IN ({", ".join(f"'{m}'" for m in MACHINES)}) THEN 'machine_only' WHEN exhausted THEN 'exhausted' ELSE 'not_collected' END AS absent FROM v""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each shown value comes from, how it came about, whether it counts as verified, and why it is absent."""
    n = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("value"), choose(F.col("c_custkey"), SOURCES).alias("own"), K.verification_tier(F.when(n < 8, 1).otherwise(0), F.when(n < 16, 1).otherwise(0)).alias("tier"))
    shown = K.effective_source(F.col("value"), F.col("own"), F.lit("wikidata-label"))
    rows = rows.withColumn("shown", shown)
    return rows.select(
        "c_custkey", "shown", K.provenance_class(F.col("shown"), F.array().cast("array<string>")).alias("class"), K.verified_value(F.col("shown"), F.col("tier")).alias("verified"),
        K.absence_reason(F.col("value"), F.col("own"), F.lit(False), F.col("c_custkey") % 3 == 0).alias("absent"),
    )


KINDS = ["person", "drama", "agency", "brand_place", "event_tour", "unheard"]
COMMON = ["person", "work", "organization", "place", "event", "other"]


@query(f"""SELECT s_suppkey, ({COMMON})[s_suppkey % 6 + 1] AS common, CASE s_suppkey % 3 WHEN 0 THEN 'films' WHEN 1 THEN 'music' ELSE 'x-other' END AS provider,
  CASE WHEN s_suppkey % 2 = 0 THEN 'female' WHEN s_suppkey % 5 = 0 THEN 'male' END AS gender,
  CASE WHEN s_acctbal > 0 THEN '' ELSE 'en,' END || CASE WHEN s_nationkey % 2 = 0 THEN '' ELSE 'ja,' END || 'zh' AS gaps FROM supplier""")
def entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common type, provider, gender and missing locales of each supplier as an entity."""
    k = F.col("s_suppkey")
    source = F.when(k % 3 == 0, "tmdb-7").when(k % 3 == 1, "musicbrainz:x").otherwise("x-other")
    claims = F.array(F.lit("Q0"), F.when(k % 2 == 0, "Q2").otherwise("Q3"), F.when(k % 5 == 0, "Q1").otherwise("Q4"))
    values = F.map_from_arrays(F.array(F.lit("en"), F.lit("ja"), F.lit("zh")), F.array(F.when(F.col("s_acctbal") > 0, F.col("s_name")), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")), F.lit(" ")))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", K.common_type(choose(k, KINDS), dict(zip(KINDS, COMMON, strict=True)), "other").alias("common"), K.provider_of(source, {"tmdb": "films", "musicbrainz": "music"}).alias("provider"),
        K.first_known(claims, {"Q1": "male", "Q2": "female"}).alias("gender"), F.array_join(K.locale_gaps(values, ["en", "ja", "zh"]), ",").alias("gaps"),
    )


@query("""SELECT p_partkey, CASE WHEN NOT eq THEN 'name_differs' WHEN known OR fits THEN 'accept' ELSE 'class_conflict' END AS verdict, p_size % 3 > 0 AND NOT fits AS disjoint FROM (
  SELECT p_partkey, p_size, p_partkey % 4 > 0 AS eq, p_partkey % 7 = 0 AS known, split_part(p_type, ' ', 1) IN ('STANDARD', 'SMALL') AS fits FROM part)""")
def anchor_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a knowledge-base entry anchors each part, and whether its classes are disjoint from the expected ones."""
    k, kind = F.col("p_partkey"), F.split_part("p_type", F.lit(" "), F.lit(1))
    names = F.array(F.when(k % 4 > 0, F.upper("p_name")).otherwise("another"), F.lit("x"))
    kinds = F.array(F.lit("STANDARD"), F.lit("SMALL"))
    expected = F.when(F.col("p_size") % 3 > 0, F.array(kind)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", resolve.anchor_verdict(F.col("p_name"), names, kind, kinds, k % 7 == 0).alias("verdict"), resolve.class_conflict(expected, kinds).alias("disjoint"))


@query("""WITH o AS (SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'film' WHEN 'click' THEN 'film' WHEN 'purchase' THEN 'music' WHEN 'signup' THEN 'music' END AS domain FROM events),
  c AS (SELECT id, domain, count(*) AS n FROM o WHERE domain IS NOT NULL GROUP BY ALL)
  SELECT id, domain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, CASE domain WHEN 'music' THEN 1 ELSE 2 END) AS r FROM c) WHERE r = 1""")
def occupation_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain that most of a user's occupations, here event types, belong to; music comes first in ties."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("occupation"))
    return resolve.domain_vote(rows, {"view": "film", "click": "film", "purchase": "music", "signup": "music"}, ["music", "film"])


@query("""WITH w AS (SELECT s_suppkey AS id, s_suppkey % 50 AS k FROM supplier), t AS (SELECT p_partkey AS track, p_size % 50 AS k, p_brand AS artist, p_retailprice AS released FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 2 = 0))
  SELECT id, track FROM (SELECT id, track, row_number() OVER (PARTITION BY id ORDER BY released, track) AS r FROM w JOIN t ON w.k = t.k) WHERE r = 1""")
def picked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest track of a title by an artist of the roster; titles differ in case, marks and spaces."""
    part = table(spark, sf_dir, "part")
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Song, No. "), (F.col("s_suppkey") % 50).cast("string")).alias("title"))
    tracks = part.select(F.col("p_partkey").alias("track"), F.concat(F.lit("song no "), (F.col("p_size") % 50).cast("string")).alias("title"), F.col("p_brand").alias("artist"), F.col("p_retailprice").alias("released"))
    return resolve.pick_track(wanted, tracks, part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("artist")))


@query("""SELECT page_id FROM pages WHERE contains(lower(url || ' ' || html), lower('Page ' || page_id)) OR contains(lower(url || ' ' || html), 'example')""")
def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold one of a name's variants in their address or text."""
    hits = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("snippet"))
    variants = F.array(F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.lit("EXAMPLE"), F.lit(""))
    return resolve.relevant_hits(hits, variants).select("page_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 >= 2 AND c_custkey % 3 = 2 THEN 'swap' WHEN c_custkey % 4 = 3 THEN 'convert' WHEN c_custkey % 4 = 2 OR c_custkey % 3 = 2 THEN 'hold' ELSE 'keep' END AS action FROM customer""")
def variant_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with columns of two scripts: letters stand for characters of either; one has no entry in the table."""
    k = F.col("c_custkey")
    simplified = F.when(k % 4 == 3, "aX").when(k % 4 == 2, "aY").otherwise("ab")
    traditional = F.when(k % 3 == 2, "x").otherwise("A")
    action = resolve.repair_variants(simplified, traditional, "XY", "x", {"X": "x"})["action"]
    return table(spark, sf_dir, "customer").select("c_custkey", action.alias("action"))


RANKED = ["operator", "media-consensus", "tmdb", "gtranslate", "llm-provisional"]
RANKS = [1, 2, 4, 8, 9]


@query(f"""SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 = 0 OR ({RANKS})[s_suppkey // 5 % 5 + 1] > ({RANKS})[s_suppkey % 5 + 1] OR s_nationkey < 3""")
def refused_name_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that a lock, a stronger source or a reversed validity forbids."""
    k = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    current = supplier.select("s_suppkey", (k % 9 == 0).alias("locked"), choose(k, RANKED).alias("source"))
    day = F.to_date(F.lit("2020-01-01"))
    writes = supplier.select("s_suppkey", choose(F.floor(k / 5), RANKED).alias("source"), day.alias("valid_from"), F.when(F.col("s_nationkey") < 3, F.date_sub(day, 1)).when(F.col("s_nationkey") < 9, day).alias("valid_to"))
    return Q.refused_writes(current, writes, "s_suppkey").select("s_suppkey")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS verified, o_orderstatus = 'F' AND NOT coalesce(o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0), false) AS after,
  o_orderstatus = 'F' AND NOT coalesce(o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey > 5), false) AS unproven FROM orders""")
def withdrawn_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that lose their verification with their evidence, and verified ones without evidence that may be exported."""
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("evidence_id"), (F.col("o_orderstatus") == "F").alias("verified"))
    evidence = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evidence_id"), (F.col("c_acctbal") < 0).alias("withdrawn"), (F.col("c_acctbal") >= 0).alias("verified"), (F.col("c_nationkey") > 5).alias("exportable"))
    after = Q.withdraw(names, evidence).select("o_orderkey", F.col("verified").alias("after"))
    faults = Q.unverified_names(names, evidence).select("o_orderkey", F.lit(True).alias("unproven"))
    return names.select("o_orderkey", "verified").join(after, "o_orderkey").join(faults, "o_orderkey", "left").withColumn("unproven", F.coalesce("unproven", F.lit(False)))


@query("""WITH r AS (SELECT o_orderkey AS run, o_orderkey % 8 AS expected FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT l_orderkey AS run, count(*) AS recorded, count_if(l_returnflag = 'R') AS planned FROM lineitem GROUP BY 1)
  SELECT run, expected, coalesce(recorded, 0) AS recorded, coalesce(planned, 0) AS planned FROM r LEFT JOIN c USING (run) WHERE coalesce(recorded, 0) <> expected OR coalesce(planned, 0) > 0""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed runs whose records do not add up, or that still hold planned ones."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), (F.col("o_orderkey") % 8).alias("expected"))
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_returnflag") == "R", "planned").otherwise("done").alias("disposition"))
    return Q.run_faults(runs, records)


@query("""SELECT o_custkey AS entity, o_orderpriority AS locale, o_orderstatus AS value, max(CAST(o_orderkey % 5 AS VARCHAR)) AS verdict, count(*) AS rulings
  FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY GROUP BY ALL""")
def ruling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings of the last 30 days on each value; the greatest verdict stands for the latest."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("locale"), F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 5).cast("string").alias("verdict"), F.col("o_orderdate").alias("at"))
    latest = F.lit("2001-08-01").cast("timestamp_ntz")
    kept = rows.where(F.col("at") >= F.lit("2001-08-02").cast("timestamp_ntz") - F.expr("interval 30 days"))
    moments = kept.select("entity", "locale", "value", "verdict", (latest + F.make_dt_interval(secs=F.col("verdict").cast("decimal(18,6)"))).alias("resolved_at"))
    return Q.prior_decisions(moments, F.lit("2001-08-02").cast("timestamp_ntz"))


@query("""SELECT p_partkey, CASE WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = 'hotring' THEN 'exact' ELSE 'related' END AS side FROM part""")
def exact_and_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts one of whose names equals a term by key, and the others."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("~none~"), F.col("p_name")).alias("names"))
    exact, related = matching.split_exact(rows, "names", "Hot-Ring")
    return exact.select("p_partkey", F.lit("exact").alias("side")).unionByName(related.select("p_partkey", F.lit("related").alias("side")))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_brand, p_type, p_name], lambda x: x <> ''))), '|') AS added,
  array_to_string(list_sort(list_distinct(list_filter([p_brand, p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)], lambda x: x <> split_part(p_name, ' ', 1)))), '|') AS others FROM part""")
def alias_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases with one added, and the names of two records without their own."""
    own = F.split("p_name", " ")
    added = R.array_add(F.array("p_brand", F.lit(""), "p_type", "p_brand"), F.col("p_name"))
    others = R.array_minus_self(F.array("p_brand", "p_type"), F.slice(own, 1, 2), own[0])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(added), "|").alias("added"), F.array_join(F.array_sort(others), "|").alias("others"))


@query("""SELECT c_custkey, least(length(s), 7) AS size, s = substr(c_name, 1, 7) AS whole FROM (SELECT c_custkey, c_name, substr(c_name, 1, 7) AS s FROM customer)""")
def truncated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut to some bytes: as many characters, as these are ASCII."""
    cut = T.truncate_bytes(F.col("c_name"), 7)
    return table(spark, sf_dir, "customer").select("c_custkey", F.length(cut).cast("long").alias("size"), (cut == F.substring("c_name", 1, 7)).alias("whole"))


@query("""SELECT doc_id, count(*) AS held FROM documents JOIN (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)) ON contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || word || ' ') GROUP BY 1""")
def words_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of part names each document holds as whole words."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    texts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
    return texts.join(words, "word").groupBy("doc_id").agg(F.count("*").alias("held"))
