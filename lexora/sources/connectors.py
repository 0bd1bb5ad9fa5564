"""External services behind one interface: a transport returns bodies, JVM parsers read them.

No network is used here. A transport is any callable from a list of requests to a list of bodies; in
tests and offline runs a table of recorded bodies stands in. Bodies are fetched in Arrow batches,
with retries, and parsed with explicit schemas.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lexora.operators.relational import running_sum

Transport = Callable[[list[str]], list[str | None]]

#: What each service's body holds: a schema, and the path of its list of records.
SCHEMAS = {
    "knowledge_base_search": ("struct<search:array<struct<id:string,label:string,description:string>>>", "search"),
    "film_titles": ("struct<results:array<struct<id:long,title:string,name:string,original_title:string,original_name:string,release_date:string>>>", "results"),
    "artists": ("struct<artists:array<struct<id:string,name:string,score:int,country:string>>>", "artists"),
    "tracks": ("struct<results:array<struct<trackId:long,trackName:string,artistName:string,releaseDate:string>>>", "results"),
    "releases": ("struct<results:array<struct<id:long,title:string,year:string,country:string>>>", "results"),
    "films_national": ("struct<movieListResult:struct<movieList:array<struct<movieCd:string,movieNm:string,movieNmEn:string>>>>", "movieListResult.movieList"),
    "films_archive": ("struct<Data:array<struct<Result:array<struct<DOCID:string,title:string,titleEng:string,titleEtc:string,prodYear:string>>>>>", "Data.Result"),
    "web_search": ("struct<items:array<struct<title:string,link:string,description:string>>>", "items"),
    "artist_detail": ("struct<id:string,name:string,aliases:array<struct<name:string,locale:string,type:string,primary:boolean>>>", "aliases"),
    "film_translations": ("struct<translations:array<struct<iso_639_1:string,iso_3166_1:string,data:struct<title:string,name:string>>>>", "translations"),
    "film_alternatives": ("struct<titles:array<struct<iso_3166_1:string,title:string>>>", "titles"),
    "series_alternatives": ("struct<results:array<struct<iso_3166_1:string,title:string>>>", "results"),
    "app_store": ("struct<results:array<struct<trackId:long,trackName:string,sellerName:string,trackViewUrl:string>>>", "results"),
}
_PERFORMANCES = "struct<db:array<struct<mt20id:string,prfnm:string,prfpdfrom:string>>>"


def fetch(requests: DataFrame, url: str, transport: Transport, attempts: int = 3) -> DataFrame:
    """The requests with a body column and the attempts made; a failed request has no body."""
    schema = StructType([*requests.schema.fields, StructField("body", StringType()), StructField("attempts", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, tries = [None] * len(batch), [0] * len(batch)
            for n in range(1, attempts + 1):
                todo = [i for i, b in enumerate(bodies) if b is None]
                if not todo:
                    break
                for i, body in zip(todo, transport([batch[url].iloc[i] for i in todo]), strict=True):
                    bodies[i], tries[i] = body, n
            yield batch.assign(body=bodies, attempts=tries)

    return requests.mapInPandas(run, schema)


def records(bodies: DataFrame, service: str, place: str | None = None, prefix: str = "") -> DataFrame:
    """One row per record of a service's bodies: its fields, with its place in the body where a column is named for that.

    The films of the archive come from all parts of a body. Fields that a request's own columns are named like, as ``id``, get the prefix.
    """
    rest = [c for c in bodies.columns if c != "body"]
    if service == "performances":
        items = F.from_xml("body", _PERFORMANCES)["db"]
    else:
        schema, path = SCHEMAS[service]
        items = F.expr(f"from_json(body, '{schema}').{path}")
        if service == "films_archive":
            items = F.flatten(F.filter(items, lambda x: x.isNotNull()))
    each = bodies.select(*rest, F.posexplode(items).alias("_at", "record"))
    fields = [F.col(f"record.{c}").alias(f"{prefix}{c}" if c in rest else c) for c in each.select("record.*").columns]
    return each.select(*rest, *([F.col("_at").alias(place)] if place else []), *fields)


def entity_claims(bodies: DataFrame) -> DataFrame:
    """(qid, kind, key, value) of knowledge-base entries: labels, aliases, site links and claimed classes."""
    one = "struct<language:string,value:string>"
    schema = f"struct<id:string,labels:map<string,{one}>,aliases:map<string,array<{one}>>,sitelinks:map<string,struct<site:string,title:string>>,claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>>"
    e = bodies.select(F.from_json("body", schema).alias("e")).select("e.*")
    labels = e.select(F.col("id").alias("qid"), F.lit("label").alias("kind"), F.explode("labels").alias("key", "x")).select("qid", "kind", "key", F.col("x.value").alias("value"))
    aliases = e.select(F.col("id").alias("qid"), F.lit("alias").alias("kind"), F.explode("aliases").alias("key", "xs")).select("qid", "kind", "key", F.explode("xs.value").alias("value"))
    links = e.select(F.col("id").alias("qid"), F.lit("sitelink").alias("kind"), F.explode("sitelinks").alias("key", "x")).select("qid", "kind", "key", F.col("x.title").alias("value"))
    claims = e.select(F.col("id").alias("qid"), F.lit("claim").alias("kind"), F.explode("claims").alias("key", "xs")).select("qid", "kind", "key", F.explode("xs.mainsnak.datavalue.value").alias("value"))
    return labels.unionByName(aliases).unionByName(links).unionByName(claims).where("value is not null")


def identity_verdict(hits: DataFrame, least: int = 2) -> DataFrame:
    """(id, verdict): whether enough search hits carry both name and type cue. hits: id, name, cue, title, description."""
    body = F.lower(F.concat_ws(" ", "title", "description"))
    good = F.count_if(F.contains(body, F.lower("name")) & F.contains(body, F.lower("cue")))
    return hits.groupBy("id").agg(F.when(good >= least, "confirmed").when(good > 0, "weak").otherwise("unknown").alias("verdict"))


def first_answer(answers: list[DataFrame], key: str) -> DataFrame:
    """The answer of the first service in order that has one, with its place in the order."""
    every = None
    for place, df in enumerate(answers):
        tagged = df.withColumn("place", F.lit(place))
        every = tagged if every is None else every.unionByName(tagged)
    best = Window.partitionBy(key).orderBy("place")
    return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def translate_cached(terms: DataFrame, cache: DataFrame, translate: Transport, month_used: int = 0, quota: int = 500_000) -> DataFrame:
    """(term, value, cached): cached translations first, the rest fetched while the month's quota lasts."""
    known = terms.join(cache, "term").select("term", "value", F.lit(True).alias("cached"))
    todo = terms.join(cache.select("term"), "term", "left_anti").select("term").distinct()
    allowed = running_sum(todo, "term", F.length("term"), "_s").where(F.col("_s") + month_used <= quota).drop("_s")
    return known.unionByName(fetch(allowed, "term", translate).select("term", F.col("body").alias("value"), F.lit(False).alias("cached")))


def convert_variant(rows: DataFrame, name: str, transport: Transport, most: int = 200) -> DataFrame:
    """The rows with ``converted``: a Chinese name in the variant that a service's transport writes, whose bodies hold it as HTML.

    A name without Chinese characters is its own conversion and asks nothing; equal names ask once. A failed answer, an empty one or one
    over ``most`` bytes gives null, never the name itself: a name in the wrong variant must not be taken for a converted one.
    """
    own = F.trim(name)
    asked = rows.select(own.alias("_name")).where(F.col("_name").rlike(r"\p{IsHan}")).distinct()
    html = F.from_json("body", "parse struct<text:struct<`*`:string>>")["parse"]["text"]["*"]
    plain = F.trim(F.replace(F.trim(F.regexp_replace(html, "<[^>]+>", "")), F.lit("\n"), F.lit(" ")))
    told = fetch(asked, "_name", transport).select("_name", plain.alias("_told"))
    met = rows.withColumn("_name", own).join(told, "_name", "left")
    good = F.when((F.col("_told") != "") & (F.octet_length("_told") <= most), F.col("_told"))
    return met.select(*rows.columns, F.when(F.col("_name").rlike(r"\p{IsHan}"), good).otherwise(F.col("_name")).alias("converted"))


def health(calls: DataFrame) -> DataFrame:
    """Calls and failures of each service. calls: source, status."""
    return calls.groupBy("source").agg(F.count("*").alias("calls"), F.count_if((F.col("status") >= 400) | F.col("status").isNull()).alias("failures"))


def call_model(rows: DataFrame, prompt: Column, model: Transport, schema: str) -> DataFrame:
    """The rows with a model's JSON answer parsed by a schema; an answer that does not parse is null."""
    asked = fetch(rows.withColumn("_prompt", prompt), "_prompt", model)
    return asked.withColumn("answer", F.from_json("body", schema)).drop("_prompt", "body", "attempts")


# The locales whose spellings the second judge is shown.
JUDGED_LOCALES = ["en", "ja", "zh", "vi"]
QUESTION = (
    "Is this a proper name of a Korean person, work, organization or institution of any field? Foreign people and media, products, services, "
    'common words and sentences are not; foreign members of Korean groups are. Answer with one line of JSON: {"k_entity": true or false, "reason": "..."}'
)


def second_judge(rows: DataFrame, model: Transport, question: str = QUESTION) -> DataFrame:
    """The rows with a verdict k_entity, its reason and a fault. rows: name, type, spellings (map by locale).

    The answer may stand between other words: what is read lies between the first opening and the last closing brace. No answer,
    one without braces and one that does not parse give no verdict and the faults ``no_answer``, ``no_json``, ``bad_json``.
    """
    said = lambda locale: F.trim(F.try_element_at("spellings", F.lit(locale)))
    shown = [F.when(said(x) != "", F.concat(F.lit(f"{x}="), said(x))) for x in JUDGED_LOCALES]
    prompt = F.concat_ws(" ", F.lit(question), F.concat(F.lit("name="), "name"), F.concat(F.lit("type="), "type"), *shown)
    asked = fetch(rows.withColumn("_prompt", prompt), "_prompt", model)
    held = F.regexp_extract("body", r"(?s)(\{.*\})", 1)
    answer = F.from_json(held, "k_entity boolean, reason string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = asked.withColumn("_held", held).withColumn("_answer", answer)
    bad = F.col("_answer").isNull() | F.col("_answer._bad").isNotNull()
    fault = F.when(F.col("body").isNull(), "no_answer").when(F.col("_held") == "", "no_json").when(bad, "bad_json")
    verdict = F.coalesce("_answer.k_entity", F.lit(False))
    return read.select(*rows.columns, F.when(fault.isNull(), verdict).alias("k_entity"), F.when(fault.isNull(), F.col("_answer.reason")).alias("reason"), fault.alias("fault"))


def command_transport(command: list[str], seconds: float = 90.0) -> Transport:
    """A transport that runs a local command for each request, one after the other, with the request as its last argument.

    What the command prints is the body. A command that fails, is missing or takes too long gives none; ``fetch`` then tries again.
    """

    def run(requests: list[str]) -> list[str | None]:
        bodies = []
        for request in requests:
            try:
                done = subprocess.run([*command, request], capture_output=True, text=True, timeout=seconds, check=False)  # noqa: S603
                bodies.append(done.stdout if done.returncode == 0 else None)
            except (OSError, subprocess.TimeoutExpired):
                bodies.append(None)
        return bodies

    return run


def spelling_extractor(model: Transport):
    """A table function from an article to (locale, spelling, hint, confidence) rows, by a pluggable model."""

    class Extract:
        def eval(self, article: str):
            for x in json.loads((model([article]) or [None])[0] or "[]"):
                yield x.get("locale"), x.get("spelling"), x.get("hint"), float(x.get("confidence") or 0)

    return udtf(Extract, returnType="locale string, spelling string, hint string, confidence double")
