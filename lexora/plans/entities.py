"""Queries over entity-like tables: names, matches, duplicates, references, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.functions.rank import fingerprint, source_priority, trust_tier
from lexora.functions.text import grams, jaccard, key_cluster, key_posix
from lexora.operators import fuzzy, matching, resolve
from lexora.operators import relational as R
from lexora.plans.registry import query
from lexora.sources.tables import table


@query("""SELECT p_name, count(*) AS members, min(p_partkey) AS first, max(p_retailprice) AS top, bool_or(p_size > 45) AS cooling,
  string_agg(p_partkey::VARCHAR, ',' ORDER BY p_retailprice DESC, p_partkey) AS ids FROM part GROUP BY 1 HAVING count(*) > 1""")
def dup_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names held by several parts, with their ids by price."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("p"), F.col("p_partkey").alias("k")))), lambda r: r["k"].cast("string"))
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(
        F.count("*").alias("members"), F.min("p_partkey").alias("first"), F.max("p_retailprice").alias("top"), F.bool_or(F.col("p_size") > 45).alias("cooling"), F.array_join(ids, ",").alias("ids")
    )
    return rows.where("members > 1")


@query("""SELECT w AS alias, p_type, count(DISTINCT p_name) AS holders FROM (SELECT p_name, p_type, unnest(string_split(p_name, ' ')) AS w FROM part)
  GROUP BY ALL HAVING count(DISTINCT p_name) > 1""")
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that several names of a type hold."""
    rows = table(spark, sf_dir, "part").select("p_name", "p_type", F.explode(F.split("p_name", " ")).alias("alias"))
    return R.shared_values(rows, "p_name", "alias", ["p_type"]).select("alias", "p_type", "holders")


@query("""SELECT n_regionkey AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS entities, count_if(c_acctbal > 0) AS in_scope, grouping(n_regionkey, n_name, c_mktsegment) AS level
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), (n_name), (c_mktsegment), ())""")
def catalogue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by region, nation and segment in one grouping."""
    for name in ("customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"breakdown_{name}")
    return spark.sql("""SELECT n_regionkey AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS entities, count_if(c_acctbal > 0) AS in_scope,
      grouping_id() AS level FROM breakdown_customer JOIN breakdown_nation ON c_nationkey = n_nationkey
      GROUP BY GROUPING SETS ((n_regionkey), (n_name), (c_mktsegment), ())""")


@query("""SELECT n_nationkey, n_name, count(s_suppkey) AS entities FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY ALL""")
def catalogue_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each domain, empty domains too."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000")
    nation = table(spark, sf_dir, "nation")
    return nation.join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("entities"))


@query("""WITH d AS (SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS domains FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09 GROUP BY 1),
  t AS (SELECT s_nationkey, CASE WHEN s_acctbal > 9500 OR coalesce(domains, 0) >= 3 THEN 'confirmed' WHEN s_suppkey % 4 = 0 THEN 'verified' WHEN coalesce(domains, 0) >= 1 OR s_suppkey % 4 = 1 THEN 'observed' ELSE 'llm' END AS tier
    FROM supplier LEFT JOIN d ON l_suppkey = s_suppkey)
  SELECT s_nationkey, count_if(tier = 'confirmed') AS confirmed, count_if(tier = 'verified') AS verified, count_if(tier = 'observed') AS observed, count_if(tier = 'llm') AS llm FROM t GROUP BY 1""")
def trust_tier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation by trust tier."""
    media = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.09").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag", "l_linestatus").alias("domains"))
    source = F.element_at(F.array(F.lit("tmdb"), F.lit("rss-observation:x"), F.lit("gtranslate"), F.lit("codex-fallback")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    tier = trust_tier(F.col("s_acctbal") > 9500, F.coalesce("domains", F.lit(0)), F.array(source))
    rows = table(spark, sf_dir, "supplier").join(media, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_nationkey", tier.alias("tier"))
    return rows.groupBy("s_nationkey").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("confirmed", "verified", "observed", "llm")])


@query("""SELECT split_part(p_name, ' ', 1) AS head, count(*) AS members, max_by(p_brand, w) AS brand, string_agg(p_name, ',' ORDER BY p_name) FILTER (WHERE n <= 3) AS samples FROM (
    SELECT p_name, split_part(p_name, ' ', 1) AS h, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_name) AS n FROM (SELECT DISTINCT p_name FROM part)) d
  JOIN (SELECT h, p_brand, c * 1000 - CAST(substr(p_brand, 7) AS INT) AS w FROM (SELECT split_part(p_name, ' ', 1) AS h, p_brand, count(*) AS c FROM part GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY h ORDER BY w DESC) = 1) b USING (h) GROUP BY 1 HAVING count(*) >= 5""")
def chain_head_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of names with five or more members, three samples and the most frequent brand."""
    part = table(spark, sf_dir, "part").withColumn("head", F.split_part("p_name", F.lit(" "), F.lit(1)))
    names = part.select("head", "p_name").distinct()
    heads = names.groupBy("head").agg(F.count("*").alias("members")).where("members >= 5")
    samples = R.top_per_key(names, ["head"], [F.asc("p_name")], 3).groupBy("head").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("samples"))
    weight = F.count("*") * 1000 - F.substring("p_brand", 7, 9).cast("int")
    brand = part.groupBy("head", "p_brand").agg(F.first(F.substring("p_brand", 7, 9).cast("int")).alias("b"), F.count("*").alias("c")).groupBy("head").agg(F.max_by("p_brand", F.col("c") * 1000 - F.col("b")).alias("brand"))
    return heads.join(samples, "head").join(brand, "head").select("head", "members", "brand", "samples")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS n, 'K' || lpad((row_number() OVER (ORDER BY c_nationkey, c_custkey))::VARCHAR, 7, '0') AS kid FROM customer""")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable numbers for customers, without a single-task window."""
    rows = R.surrogate_ids(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], "n")
    return rows.select("c_custkey", "n", F.concat(F.lit("K"), F.lpad(F.col("n").cast("string"), 7, "0")).alias("kid"))


@query("""SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_name = 'hot ring' THEN 0 WHEN regexp_replace(lower(trim(p_name)), '[[:space:][:punct:]]+', '', 'g') = 'hotring' THEN 1
    WHEN contains(lower(p_name), 'hot ring') THEN 2 ELSE 3 END AS rank FROM part) WHERE rank < 3 OR contains(lower(p_name), 'ring') ORDER BY rank, p_retailprice DESC, p_partkey LIMIT 60""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by relevance to a term."""
    rank = matching.search_rank(F.col("p_name"), "hot ring")
    rows = table(spark, sf_dir, "part").where((rank < 3) | F.contains(F.lower("p_name"), F.lit("ring"))).withColumn("rank", rank)
    return rows.orderBy("rank", F.desc("p_retailprice"), "p_partkey").limit(60).select("p_partkey", "p_name", "rank")


@query(r"""SELECT doc_id, item_id, length(b.text) AS fragment FROM documents d JOIN benchmark b ON length(b.text) >= 4 AND contains(d.text, b.text)""")
def text_match_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that documents contain, by one automaton over the passages."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return matching.match_texts(docs, items, "text", "doc_id", "passage", "item_id", limit=None).select("doc_id", "item_id", F.col("fragment").cast("long").alias("fragment"))


@query("""WITH names AS (SELECT DISTINCT substr(text, 3, 6) AS name FROM benchmark WHERE length(substr(text, 3, 6)) >= 4)
  SELECT doc_id, name FROM documents JOIN names ON contains(text, name)""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin and end inside words, wherever documents hold them."""
    names = table(spark, sf_dir, "benchmark").select(F.substring("text", 3, 6).alias("name")).where("length(name) >= 4").distinct()
    found = matching.match_texts(table(spark, sf_dir, "documents"), names.withColumn("key", F.col("name")), "text", "doc_id", "name", "key", limit=None)
    return found.select("doc_id", F.col("key").alias("name"))


@query(r"""SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
  WHERE word <> '' AND word NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part) AND word NOT IN (SELECT p_name FROM part) GROUP BY 1 HAVING count(*) >= 20""")
def array_name_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words that are neither a part's name nor one of its words: one equi anti join over the name set."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where("word != ''")
    names = R.names_of(table(spark, sf_dir, "part").withColumn("aliases", F.split("p_name", " ")), "p_partkey", "p_name", "aliases")
    counted = words.groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 20")
    return R.unknown_terms(counted, names, "word")


CLAIMS = """claims AS (SELECT DISTINCT p_name AS name, p_brand AS entity, 'canonical' AS kind FROM part WHERE p_partkey % 3 = 0
  UNION SELECT DISTINCT p_name, p_brand, 'alias' FROM part WHERE p_partkey % 3 > 0)"""


def _claims(part: DataFrame, name: Column) -> DataFrame:
    return part.select(name.alias("name"), F.col("p_brand").alias("entity"), F.when(F.col("p_partkey") % 3 == 0, "canonical").otherwise("alias").alias("kind")).distinct()


@query(f"WITH {CLAIMS} SELECT DISTINCT o.name, o.entity AS a, x.entity AS b FROM claims o JOIN claims x ON o.name = x.name AND o.entity <> x.entity WHERE o.kind = 'canonical' AND x.kind = 'alias'")
def name_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are one brand's own and another's alias; two parts of three claim theirs as an alias."""
    return resolve.name_splits(_claims(table(spark, sf_dir, "part"), F.col("p_name")))


@query(f"""WITH {CLAIMS.replace('p_name', "p_name || p_size")} SELECT name, min(entity) AS owner FROM claims GROUP BY 1 HAVING count_if(kind = 'canonical') = 0 AND count_if(kind = 'alias') = 1""")
def sole_alias_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that exactly one brand claims, as an alias; two parts of three claim theirs as an alias."""
    return resolve.sole_alias_owner(_claims(table(spark, sf_dir, "part"), F.concat("p_name", F.col("p_size").cast("string"))))


@query("SELECT p_partkey, p_type, p_name, p_size, count(*) OVER (PARTITION BY p_type, p_name, p_size) > 1 AS ambiguous FROM part")
def ambiguous_shown_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part shares its shown name and type with another."""
    return R.ambiguous(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size"), ["p_type", "p_name", "p_size"], "ambiguous")


REFS = "refs AS (SELECT DISTINCT l_suppkey AS entity, l_returnflag AS provider, l_partkey % 40 AS external_id FROM lineitem)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("provider"), (F.col("l_partkey") % 40).alias("external_id")).distinct()


@query(f"""WITH {REFS}, pairs AS (SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey // 20 = b.s_suppkey // 20 AND a.s_suppkey < b.s_suppkey)
  SELECT a, b, count_if(x.external_id <> y.external_id) AS conflicts, count_if(x.external_id = y.external_id) AS shared
  FROM pairs JOIN refs x ON x.entity = a JOIN refs y ON y.entity = b AND x.provider = y.provider GROUP BY ALL""")
def provider_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids of one provider that differ or agree, for suppliers of a nation whose keys are neighbours."""
    s = table(spark, sf_dir, "supplier").withColumn("near", F.floor(F.col("s_suppkey") / 20))
    pairs = s.select("s_nationkey", "near", F.col("s_suppkey").alias("a")).join(s.select("s_nationkey", "near", F.col("s_suppkey").alias("b")), ["s_nationkey", "near"]).where("a < b")
    return resolve.provider_conflicts(_refs(spark, sf_dir), pairs)


@query(f"""WITH {REFS} SELECT provider, external_id, entity, entity = min(entity) OVER (PARTITION BY provider, external_id) AS accepted FROM refs""")
def reserved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first owner of each external id, and those refused."""
    return resolve.reserve_ids(_refs(spark, sf_dir), "entity")


@query("""WITH refs AS (SELECT DISTINCT l_orderkey AS entity, l_partkey % 3 AS external_id FROM lineitem)
  SELECT entity, min(external_id) AS external_id FROM refs GROUP BY 1 HAVING count(DISTINCT external_id) = 1""")
def quorum_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose references agree on one external id."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), (F.col("l_partkey") % 3).alias("external_id")).distinct()
    return resolve.quorum_ids(refs, "entity")


@query("""SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND a.o_orderdate <= b.o_orderdate + INTERVAL 20 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 20 DAY""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer whose 20-day spans overlap."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 20 days")).alias("e"))
    return R.overlaps(rows, ["o_custkey"], "s", "e", "o_orderkey")


@query("""SELECT s_nationkey AS provider, s_suppkey AS policy FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier WHERE s_acctbal > 0) WHERE n = 1""")
def current_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy now valid for each provider: the latest approved one."""
    return R.top_per_key(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")]).select(F.col("s_nationkey").alias("provider"), F.col("s_suppkey").alias("policy"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 100 AS o, l_returnflag AS p FROM lineitem WHERE l_suppkey <> l_partkey % 100)
  SELECT entity, p, direction, count(*) AS others, min(other) AS first FROM (SELECT s AS entity, o AS other, p, 'out' AS direction FROM e UNION ALL SELECT o, s, p, 'in' FROM e) GROUP BY ALL""")
def relation_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each entity seen from either end."""
    return _relations(table(spark, sf_dir, "lineitem"))


def _relations(lines: DataFrame) -> DataFrame:
    edges = lines.where("l_suppkey != l_partkey % 100").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("o"), F.col("l_returnflag").alias("p")).distinct()
    return R.both_ways(edges, "s", "o", "p").groupBy("entity", "p", "direction").agg(F.count("*").alias("others"), F.min("other").alias("first"))


TRIGRAMS = """(SELECT DISTINCT name, substr(p, i, 3) AS g FROM (SELECT name, p, unnest(range(1, length(p) - 1)) AS i FROM (
  SELECT name, '  ' || w || ' ' AS p FROM (SELECT name, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS w FROM names) WHERE w <> '')))"""


@query(f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part), g AS {TRIGRAMS}, n AS (SELECT name, count(*) AS c FROM g GROUP BY 1),
  m AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.name < y.name GROUP BY ALL)
  SELECT a, b, round(shared / (p.c + q.c - shared), 6) AS similarity FROM m JOIN n p ON p.name = a JOIN n q ON q.name = b WHERE shared / (p.c + q.c - shared) >= 0.6""")
def trigram_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names with a trigram similarity of 0.6 or more."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    left = names.select(F.col("p_name").alias("lid"), F.col("p_name").alias("lname"))
    right = names.select(F.col("p_name").alias("rid"), F.col("p_name").alias("rname"))
    return fuzzy.gram_join(left, right, 0.6).where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"), F.round("similarity", 6).alias("similarity"))


@query("""WITH names AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT DISTINCT name, substr(name, i, 2) AS g FROM (SELECT name, unnest(range(1, length(name))) AS i FROM names)),
  n AS (SELECT name, count(*) AS c FROM g GROUP BY 1), m AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.name < y.name GROUP BY ALL)
  SELECT a, b, round(shared / (p.c + q.c - shared), 6) AS similarity FROM m JOIN n p ON p.name = a JOIN n q ON q.name = b WHERE shared / (p.c + q.c - shared) >= 0.6""")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names with a bigram similarity of 0.6 or more."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    left = names.select(F.col("p_name").alias("lid"), F.col("p_name").alias("lname"))
    right = names.select(F.col("p_name").alias("rid"), F.col("p_name").alias("rname"))
    return fuzzy.gram_join(left, right, 0.6, n=2).where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"), F.round("similarity", 6).alias("similarity"))


@query("""SELECT DISTINCT split_part(a.p_name, ' ', 1) AS hint, a.p_name AS name FROM part a WHERE length(a.p_name) > length(split_part(a.p_name, ' ', 1))""")
def abbreviation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of which a part's first word is an abbreviation."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    hints = names.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("hint")).distinct()
    return fuzzy.abbreviations(hints, names.withColumnRenamed("p_name", "name")).select("hint", "name")


PEOPLE = """people AS (SELECT s_suppkey AS id, s_nationkey AS n, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Agency ' || (s_suppkey % 3) END AS agency,
  CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1980 + s_suppkey % 2 END AS birth_year, CASE s_suppkey % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'singer' ELSE 'Director' END AS role FROM supplier)"""


@query(f"""WITH {PEOPLE} SELECT a.id AS a, b.id AS b,
  (a.agency <> '' AND b.agency <> '' AND a.agency <> b.agency) OR (a.birth_year > 0 AND b.birth_year > 0 AND a.birth_year <> b.birth_year) OR (a.role <> 'other' AND b.role <> 'other' AND a.role <> b.role) AS conflict,
  (a.agency <> '' AND a.agency = b.agency) OR (a.birth_year > 0 AND a.birth_year = b.birth_year) OR (a.role <> 'other' AND a.role = b.role) AS compatible,
  CASE WHEN a.agency <> '' THEN '(' || a.agency || ')' WHEN a.role <> 'other' THEN '(' || a.role || ')' WHEN a.birth_year > 0 THEN '(' || a.birth_year || ')' ELSE '' END AS label
  FROM people a JOIN people b ON a.n = b.n AND a.id // 20 = b.id // 20 AND a.id < b.id""")
def homonym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose keys are neighbours, as namesakes: whether their signals conflict or fit, and a label."""
    key = F.col("s_suppkey")
    signals = F.struct(
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Agency "), (key % 3).cast("string"))).alias("agency"), F.when(key % 4 == 0, 0).otherwise(1980 + key % 2).alias("birth_year"),
        F.when(key % 3 == 0, "other").when(key % 3 == 1, "singer").otherwise("Director").alias("role"), F.array().cast("array<string>").alias("works"),
    )
    people = table(spark, sf_dir, "supplier").select("s_nationkey", F.floor(key / 20).alias("near"), key.alias("id"), signals.alias("s"))
    a, b = people.select("s_nationkey", "near", F.col("id").alias("a"), F.col("s").alias("sa")), people.select("s_nationkey", "near", F.col("id").alias("b"), F.col("s").alias("sb"))
    label = resolve.disambiguator(F.col("sa.agency"), F.col("sa.role"), F.col("sa.birth_year"))
    return a.join(b, ["s_nationkey", "near"]).where("a < b").select("a", "b", resolve.conflict("sa", "sb").alias("conflict"), resolve.compatible("sa", "sb").alias("compatible"), label.alias("label"))


@query()
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate clusters from two sources of edges: equal name and type, equal brand and size. Recursive SQL over
    all pairs is too slow; tests hold it against brute force."""
    return _clusters(table(spark, sf_dir, "part"))


def _clusters(part: DataFrame) -> DataFrame:
    edges = resolve.star_edges(part, "p_partkey", ["p_name", "p_type"], "name").unionByName(resolve.star_edges(part, "p_partkey", ["p_brand", "p_size"], "id"))
    return resolve.candidate_clusters(edges)


@query("""WITH t AS (SELECT DISTINCT p_name AS term, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS hint FROM part),
  m AS (SELECT t.term, t.hint, p.p_partkey AS id, p.p_type AS type, coalesce(t.hint = p.p_type, false) AS typed, p.p_retailprice AS confidence, p.p_size > 40 AS locked FROM t JOIN part p ON p.p_name = t.term),
  r AS (SELECT *, count(*) OVER w AS fits, count_if(typed) OVER w AS fits_type, row_number() OVER (PARTITION BY term, hint ORDER BY typed DESC, locked DESC, confidence DESC, id) AS n FROM m WINDOW w AS (PARTITION BY term, hint))
  SELECT term, hint, id, type, fits, fits = 1 OR (typed AND fits_type = 1) AS safe FROM r WHERE n = 1""")
def exact_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part each term means, and whether nothing else could be meant."""
    part = table(spark, sf_dir, "part")
    return _picked(part, part)


def _picked(named: DataFrame, part: DataFrame) -> DataFrame:
    terms = named.select(F.col("p_name").alias("term"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("hint")).distinct()
    entities = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), (F.col("p_size") > 40).alias("locked"), F.col("p_retailprice").alias("confidence"))
    return matching.pick_exact(terms, entities)


@query("""SELECT term, count(p_partkey) AS exact, CASE WHEN count(p_partkey) = 0 THEN 'miss' WHEN count(p_partkey) = 1 THEN 'found' ELSE 'ambiguous' END AS status
  FROM (SELECT DISTINCT p_name || ' ' || (p_size % 30) AS term FROM part) LEFT JOIN part ON p_name || ' ' || p_size = term GROUP BY 1""")
def lookup_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of many lookups at once: miss, found or ambiguous."""
    part = table(spark, sf_dir, "part")
    sized = lambda c: F.concat_ws(" ", "p_name", c.cast("string"))
    terms = part.select(sized(F.col("p_size") % 30).alias("term")).distinct()
    held = part.select(sized(F.col("p_size")).alias("term"), "p_partkey")
    return terms.join(held, "term", "left").groupBy("term").agg(F.count("p_partkey").alias("exact")).withColumn("status", matching.lookup_status(F.col("exact")))


@query("""WITH o AS (SELECT c_custkey, c_name, md5(concat_ws('|', c_custkey, c_name, c_nationkey, c_mktsegment)) AS h FROM customer),
  n AS (SELECT c_custkey, md5(concat_ws('|', c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END)) AS h FROM customer WHERE c_custkey % 11 > 0)
  SELECT CASE WHEN n.h IS NULL THEN 'delete' WHEN n.h = o.h THEN 'unchanged' ELSE 'update' END AS change, count(*) AS rows, min(o.c_custkey) AS first, min(o.h) AS least FROM o LEFT JOIN n USING (c_custkey) GROUP BY 1""")
def fingerprints_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of a table, by fingerprints."""
    old = table(spark, sf_dir, "customer")
    new = old.where("c_custkey % 11 > 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    mark = fingerprint(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment"))
    diff = R.snapshot_diff(old, new, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"]).join(old.select("c_custkey", mark.alias("h")), "c_custkey")
    return diff.groupBy("change").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first"), F.min("h").alias("least"))


@query("""SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS flags, md5(string_agg(l_orderkey || ':' || l_linenumber, '\n' ORDER BY l_orderkey || ':' || l_linenumber)) AS mark, count(*) AS n
  FROM lineitem GROUP BY 1""".replace("'\\n'", "chr(10)").replace("'\n'", "chr(10)"))
def provider_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct providers of each supplier joined in order, and a fingerprint of its lines."""
    line = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("flags"), F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("mark"), F.count("*").alias("n"))


@query("""SELECT s_nationkey, '{' || string_agg('"' || s_name || '":' || s_suppkey, ',' ORDER BY s_name) || '}' AS members FROM supplier GROUP BY 1""")
def group_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each nation as a JSON object with sorted keys."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("k"), F.col("s_suppkey").alias("v"))))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(pairs)).alias("members"))


@query("""WITH g AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS grp FROM part), n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part)
  SELECT name, grp FROM n JOIN g ON left(name, length(grp) + 1) = grp || ' '""")
def prefix_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin with a group's name and a space, without a nested-loop join."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()
    return R.prefix_matches(names, part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("grp")), "name", "grp").select("name", "grp")


@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
  h AS (SELECT p_partkey AS id, p_name AS hint, split_part(p_name, ' ', 1) AS own FROM part)
  SELECT id, max_by(name, lpad(length(name)::VARCHAR, 3, '0') || name) AS name FROM h JOIN n ON name <> own AND ' ' || hint || ' ' LIKE '% ' || name || ' %' GROUP BY 1""")
def co_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest other name in each part's name."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    hints = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("hint"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("own"))
    return matching.co_mention(hints, words)


@query("""SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN coalesce(b, c_acctbal) ELSE c_acctbal END AS patched FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS b FROM orders WHERE o_custkey % 5 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version of a table patched from a join."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("patched"))
    patch = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("patched"))
    return R.update_from(customer, patch, ["c_custkey"], ["patched"])


@query("""SELECT k, sum(n)::BIGINT AS attempts, max(day) AS last, max_by(t, day * 10000000 + id) AS outcome FROM (
  SELECT user_id AS k, 1 AS n, day(ts) AS day, event_type AS t, event_id AS id FROM events) GROUP BY 1""")
def upsert_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each key counted over an old and a new batch, with the last outcome."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.lit(1).alias("attempts"), (F.dayofmonth("ts") * 10000000 + F.col("event_id")).alias("moment"), F.col("event_type").alias("outcome"), "event_id")
    old, new = (rows.where(f"event_id % 2 = {i}").drop("event_id") for i in (0, 1))
    merged = R.upsert_counter(old, new, ["k"], "attempts", "moment", ["outcome"])
    return merged.select("k", "attempts", F.floor(F.col("moment") / 10000000).cast("int").alias("last"), "outcome")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to append so that no customer is there twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    fresh = R.top_per_key(orders.where("o_orderkey % 3 = 0"), ["o_custkey"], [F.asc("o_orderkey")])
    return R.insert_absent(orders.where("o_orderkey % 3 = 1"), fresh, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT u AS url, min(l) AS list FROM (SELECT url AS u, 0 AS l FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 1 FROM pages WHERE page_id % 3 = 0) GROUP BY 1""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hit lists merged by URL, the first list first."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    lists = [pages.where("page_id % 2 = 0").select("url", F.lit(0).alias("list")), pages.where("page_id % 3 = 0").select("url", F.lit(1).alias("list"))]
    return R.first_by_url(lists, "url")
