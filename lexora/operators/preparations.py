"""Preparations as stored requests: batches are stored, read and cancelled as new table versions.

Every function takes whole batches. Ids and digests follow from the rows alone, so a task that runs again
writes the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The locale codes that requests may use and the code each is kept under, by catalogue.
LOCALES = {"en": "en", "ja": "ja", "zh": "zh", "zh-cn": "zh", "zh-hans": "zh", "zh-tw": "zh_hant", "zh-hant": "zh_hant", "vi": "vi", "es": "es", "id": "id", "pt-br": "pt_br"}
COMMON_LOCALES = {"ko": "ko", "en": "en", "ja": "ja", "zh": "zh", "zh-hans": "zh-Hans", "zh-hant": "zh-Hant", "zh-tw": "zh-TW", "vi": "vi", "id": "id", "es": "es", "pt": "pt", "pt-br": "pt-BR"}
# The codes under which the state of a locale is kept; requests for others have no state.
STATE_LOCALES = {"de": "de", "en": "en", "es": "es", "fr": "fr", "id": "id", "ja": "ja", "ko": "ko", "ru": "ru", "th": "th", "vi": "vi", "zh": "zh", "pt-br": "pt-BR", "zh-hans": "zh-Hans", "zh-hant": "zh-Hant"}
# Limits of a request; of types, addresses and article fields in bytes.
MOST_TERMS, MOST_TERM, MOST_TYPE, MOST_CONTEXT, MOST_URL, MOST_ARTICLE, MOST_OWNER, MOST_KEY, MOST_REASON = 200, 200, 50, 2000, 2048, 200, 150, 200, 1000

TERM = "struct<term:string,type:string,context:string,entity_id:string>"
REQUEST = f"arrival long, owner string, key string, catalog string, terms array<{TERM}>, locales array<string>, source_url string, article_id string, article_version string"
PREPARATION = (
    "id string, owner string, key string, digest string, catalog string, status string, revision long, locales array<string>, source_url string, article_id string, "
    "article_version string, created_at timestamp, updated_at timestamp, cancelled_at timestamp"
)
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_NIL = "00000000-0000-0000-0000-000000000000"


class Created(NamedTuple):
    """answers: arrival, outcome, id; the rows to append to the three tables."""

    answers: DataFrame
    preparations: DataFrame
    items: DataFrame
    states: DataFrame


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _code(c: Column, table: dict[str, str]) -> Column:
    """The code a locale is kept under, or null."""
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(codes, F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")))


def _id(*parts: Column) -> Column:
    """A digest of some texts in the form of a UUID."""
    return F.regexp_replace(F.md5(F.to_json(F.struct(*parts)).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def normalized(requests: DataFrame) -> DataFrame:
    """Requests (``REQUEST``) trimmed, their locales as kept, sorted and without repeats, a digest of what they ask, and ``fault``.

    The fault is the first that holds of: catalog, terms (none, or more than ``MOST_TERMS``), locale (not known), term (blank,
    too long, or with an id that is no UUID), metadata, owner, key; null where there is none. Without locales English is asked for.
    Suggestions that come with a request are no columns here, so they do not change its digest.
    """
    terms = F.transform(
        F.coalesce("terms", F.array().cast(f"array<{TERM}>")),
        lambda t: F.struct(F.trim(_text(t["term"])).alias("term"), F.trim(_text(t["type"])).alias("type"), _text(t["context"]).alias("context"), F.lower(F.trim(_text(t["entity_id"]))).alias("entity_id")),
    )
    asked = F.when(F.size(F.coalesce("locales", F.array().cast("array<string>"))) > 0, F.col("locales")).otherwise(F.array(F.lit("en")))
    codes = F.when(_text("catalog") == "common", F.transform(asked, lambda x: _code(x, COMMON_LOCALES))).otherwise(F.transform(asked, lambda x: _code(x, LOCALES)))
    rows = requests.select(
        "arrival", _text("owner").alias("owner"), _text("key").alias("key"), _text("catalog").alias("catalog"), terms.alias("terms"), codes.alias("codes"),
        _text("source_url").alias("source_url"), _text("article_id").alias("article_id"), _text("article_version").alias("article_version"),
    )
    bad = lambda t: (t["term"] == "") | (F.length(t["term"]) > MOST_TERM) | (F.octet_length(t["type"]) > MOST_TYPE) | (F.length(t["context"]) > MOST_CONTEXT) | ((t["entity_id"] != "") & (~t["entity_id"].rlike(f"^{_UUID}$") | (t["entity_id"] == _NIL)))
    long = (F.octet_length("source_url") > MOST_URL) | (F.octet_length("article_id") > MOST_ARTICLE) | (F.octet_length("article_version") > MOST_ARTICLE)
    fault = (
        F.when(~F.col("catalog").isin("", "common"), "catalog").when(~F.size("terms").between(1, MOST_TERMS), "terms").when(F.exists("codes", lambda x: x.isNull()), "locale")
        .when(F.exists("terms", bad), "term").when(long, "metadata").when(~F.octet_length("owner").between(1, MOST_OWNER), "owner").when(F.octet_length("key") > MOST_KEY, "key")
    )
    kept = rows.withColumn("locales", F.array_sort(F.array_distinct(F.filter("codes", lambda x: x.isNotNull())))).withColumn("fault", fault).drop("codes")
    return kept.withColumn("digest", F.sha2(F.to_json(F.struct("catalog", "terms", "locales", "source_url", "article_id", "article_version")), 256))


def create(stored: DataFrame, requests: DataFrame, at: Column) -> Created:
    """Store a batch of requests, each (owner, key) once.

    ``arrival`` numbers the requests of all batches. Of requests with one key the first to arrive is ``created``; others are ``replayed``
    if they ask the same and get its id, else they are a ``conflict``. Requests without a key are always created. Faulty ones are
    ``invalid_<fault>``. An empty batch adds nothing. A key repeated many times is reduced before it is shuffled.
    """
    rows = normalized(requests)
    none = F.col("fault").isNull()
    own = F.when(F.col("key") == "", F.concat(F.lit("arrival:"), F.col("arrival").cast("string"))).otherwise(F.concat(F.lit("key:"), F.col("key")))
    good = rows.where(none).withColumn("id", _id(F.col("owner"), own))
    fields = ["arrival", "owner", "key", "catalog", "terms", "locales", "source_url", "article_id", "article_version", "digest"]
    first = good.groupBy("id").agg(F.min("arrival").alias("arrival"))
    held = stored.select("id", F.col("digest").alias("_held"))
    new = good.join(first, ["id", "arrival"], "left_semi").join(held.select("id"), "id", "left_anti").dropDuplicates(["id"]).select("id", *fields)
    known = new.select("id", F.col("digest").alias("_held"), F.col("arrival").alias("_first")).unionByName(held.withColumn("_first", F.lit(None).cast("long")))
    outcome = F.when(F.col("arrival") == F.col("_first"), "created").when(F.col("digest") == F.col("_held"), "replayed").otherwise("conflict")
    answers = good.join(known, "id").select("arrival", outcome.alias("outcome"), F.when(outcome != "conflict", F.col("id")).alias("id"))
    refused = rows.where(~none).select("arrival", F.concat(F.lit("invalid_"), F.col("fault")).alias("outcome"), F.lit(None).cast("string").alias("id"))
    moment = at.cast("timestamp")
    preparations = new.select(
        "id", "owner", "key", "digest", "catalog", F.lit("preparing").alias("status"), F.lit(1).cast("long").alias("revision"), "locales", "source_url", "article_id", "article_version",
        moment.alias("created_at"), moment.alias("updated_at"), F.lit(None).cast("timestamp").alias("cancelled_at"),
    )
    items = new.select("id", "locales", F.posexplode("terms").alias("ordinal", "t")).select("id", "ordinal", "t.*", F.lit("pending").alias("identity_state"), "locales")
    codes = F.array_distinct(F.filter(F.transform("locales", lambda x: _code(x, STATE_LOCALES)), lambda x: x.isNotNull()))
    states = items.select("id", "ordinal", F.explode(codes).alias("locale")).select("id", "ordinal", "locale", F.lit("pending").alias("state"), F.lit("").alias("value"), F.lit("").alias("reason"), moment.alias("observed_at"))
    return Created(answers.unionByName(refused), preparations, items.drop("locales"), states)


def get(preparations: DataFrame, items: DataFrame, states: DataFrame, asks: DataFrame) -> DataFrame:
    """Each asked preparation of its own owner with its items and their locales in order; ``found`` is false for others.

    asks: owner, id; asked twice, answered once. A preparation has at most ``MOST_TERMS`` items, which bounds the lists.
    """
    wanted = asks.select("owner", "id").distinct()
    rows = wanted.join(preparations, ["owner", "id"], "left")
    ids = wanted.join(preparations.select("owner", "id"), ["owner", "id"]).select("id").distinct()
    locales = states.join(ids, "id", "left_semi").groupBy("id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("locale", "state", "value", "reason"))).alias("states"))
    whole = items.join(ids, "id", "left_semi").join(locales, ["id", "ordinal"], "left")
    listed = whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "term", "type", "context", "entity_id", "identity_state", "states"))).alias("items"))
    return rows.join(listed, "id", "left").withColumn("found", F.col("status").isNotNull()).withColumn("items", F.when(F.col("found"), F.col("items")))


def cancel(preparations: DataFrame, states: DataFrame, asks: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, preparations, states) after a batch of cancellations, taken in order of arrival.

    asks: arrival, owner, id, revision, reason. The answer is ``invalid`` without a reason or with one over ``MOST_REASON`` bytes, or a
    revision below 1; ``not_found``; ``stale`` where the revision is not the present one; ``already_cancelled``; or ``cancelled``,
    which empties the values of all locales, gives the reason, and raises the revision by one.
    """
    reason, revision = _text("reason"), F.coalesce("revision", F.lit(0))
    fit = (F.trim(reason) != "") & (F.octet_length(reason) <= MOST_REASON) & (revision >= 1)
    present = preparations.select("owner", "id", F.col("revision").alias("_now"), (F.col("status") == "cancelled").alias("_gone"))
    met = asks.select("arrival", "owner", "id", revision.alias("revision"), reason.alias("reason"), fit.alias("_fit")).join(present, ["owner", "id"], "left")
    met = met.withColumn("_acts", F.col("_fit") & ~F.col("_gone") & (F.col("revision") == F.col("_now")))
    done = met.where("_acts").groupBy("owner", "id").agg(F.min("arrival").alias("_done"), F.min_by("reason", "arrival").alias("_why"))
    judged = met.join(done, ["owner", "id"], "left")
    behind = F.coalesce(F.col("arrival") > F.col("_done"), F.lit(False))
    current = F.col("_now") + behind.cast("long")
    answer = (
        F.when(~F.col("_fit"), "invalid").when(F.col("_now").isNull(), "not_found").when(F.col("revision") != current, "stale")
        .when(F.col("_gone") | behind, "already_cancelled").otherwise("cancelled")
    )
    answers = judged.select("arrival", "owner", "id", answer.alias("outcome"))
    hit = F.col("_done").isNotNull()
    changed = {"status": F.lit("cancelled"), "revision": F.col("revision") + 1, "updated_at": at.cast("timestamp"), "cancelled_at": at.cast("timestamp")}
    table = preparations.join(done, ["owner", "id"], "left")
    table = table.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in preparations.columns])
    emptied = {"state": F.lit("cancelled"), "value": F.lit(""), "reason": F.col("_why"), "observed_at": at.cast("timestamp")}
    spent = states.join(done.select("id", "_done", "_why"), "id", "left")
    return answers, table, spent.select(*[F.when(hit, emptied[c]).otherwise(F.col(c)).alias(c) if c in emptied else F.col(c) for c in states.columns])


def correction_status(corrections: DataFrame, asks: DataFrame) -> DataFrame:
    """What became of each asked correction: found, status, locale, suggested, proposed, resolution. asks: id."""
    columns = ["status", "locale", "suggested", "proposed", "resolution"]
    return asks.select("id").distinct().join(corrections.select("id", *columns), "id", "left").select("id", F.col("status").isNotNull().alias("found"), *columns)
