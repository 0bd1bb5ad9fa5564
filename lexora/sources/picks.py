"""Which of a service's records is the one meant. None of these falls back to a first result that is not named as asked.

Records carry the request's ``id``, the name ``wanted`` and their ``position`` in the body, as ``connectors.records`` gives them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that do not count when titles, and when artists' names, are compared.
TITLE_DROPS = " \t:-·.,!?'\""
ARTIST_DROPS = " \t·・-._'\","
# The locale of a translation by its language, and country where that matters; and of a title by its country alone.
TRANSLATION_LOCALES = {"en": "en", "ja": "ja", "vi": "vi", "id": "id", "es": "es", "pt-BR": "pt_br", "zh-TW": "zh_hant", "zh-HK": "zh_hant", "zh-MO": "zh_hant", "zh-CN": "zh", "zh-SG": "zh"}
COUNTRY_LOCALES = {"JP": "ja", "VN": "vi", "ID": "id", "BR": "pt_br", "TW": "zh_hant", "HK": "zh_hant", "MO": "zh_hant", "CN": "zh", "SG": "zh", "ES": "es", "MX": "es", "AR": "es", "CO": "es", "CL": "es", "PE": "es"}
# How many artists are looked at, and how many encyclopedia entries.
MOST_ARTISTS, MOST_ENTRIES = 3, 5


def title_name(c: Column) -> Column:
    """A title as titles are compared: in lower case, without spaces and marks."""
    return F.translate(F.lower(c), TITLE_DROPS, "")


def artist_name(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), ARTIST_DROPS, "")


def app_name(c: Column) -> Column:
    """A title of an app: only case and spaces are ignored, or different games would be one."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def _first(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of each id's first record; an aggregate, so a request with many records is reduced before it is shuffled."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*fields), "position").alias("_r")).select("id", "_r.*")


def _named(names: list[Column], key, wanted: Column) -> Column:
    return (key(wanted) != "") & F.coalesce(reduce(or_, [F.coalesce(key(n) == key(wanted), F.lit(False)) for n in names]), F.lit(False))


def pick_film(records: DataFrame) -> DataFrame:
    """(id, film): the first whose shown or original title, of a film or a series, is the one wanted."""
    blank = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    own = [blank("title", "name"), blank("original_title", "original_name")]
    return _first(records.where(_named(own, title_name, F.col("wanted"))).withColumn("film", F.col("record_id")), ["film"])


def pick_app(records: DataFrame) -> DataFrame:
    """(id, trackId, sellerName): the first app of exactly the wanted name."""
    return _first(records.where(_named([F.col("trackName")], app_name, F.col("wanted"))), ["trackId", "sellerName"])


def pick_artist(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, artist): the first of the leading artists whose name or any alias is the one wanted. aliases: artist, name."""
    leading = records.where(F.col("position") < MOST_ARTISTS).withColumn("artist", F.col("record_id"))
    others = leading.select("id", "position", "artist", "wanted").join(aliases.select("artist", F.col("name").alias("said")), "artist")
    every = leading.select("id", "position", "artist", "wanted", F.col("name").alias("said")).unionByName(others)
    return _first(every.where(_named([F.col("said")], artist_name, F.col("wanted"))), ["artist"])


def pick_national_film(records: DataFrame) -> DataFrame:
    """(id, code, english): the first film of exactly the wanted title that has a code or an English title."""
    code, english = F.trim(F.coalesce("movieCd", F.lit(""))), F.trim(F.coalesce("movieNmEn", F.lit("")))
    met = records.where((F.trim("movieNm") == F.trim("wanted")) & ((code != "") | (english != "")))
    return _first(met.withColumn("code", code).withColumn("english", english), ["code", "english"])


def clean_title(c: Column) -> Column:
    """A title of the archive without its highlighting marks, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "!HS|!HE", " "), r"\s+", " "))


def pick_archive_film(records: DataFrame) -> DataFrame:
    """(id, DOCID, english): the film one of whose titles is the wanted one, rather one with an English title.

    A title wholly in parentheses is a transcription and no English title. Where films of one title have different English ones,
    none is picked.
    """
    said = F.trim(F.coalesce("titleEng", F.lit("")))
    english = F.when(said.rlike(r"(?s)^\(.*\)$"), "").otherwise(said)
    others = F.transform(F.split(F.coalesce("titleEtc", F.lit("")), r"\^"), clean_title)
    wanted = F.trim(F.regexp_replace("wanted", r"\s+", " "))
    met = records.where((wanted != "") & ((clean_title(F.col("title")) == wanted) | F.array_contains(others, wanted))).withColumn("english", english)
    order = F.struct(F.col("english") == "", F.col("position"))
    told = F.when(F.col("english") != "", F.col("english"))
    best = met.groupBy("id").agg(F.min_by(F.struct("DOCID", "english"), order).alias("_r"), F.min(told).alias("_a"), F.max(told).alias("_b"))
    return best.where("_a is null or _a = _b").select("id", "_r.*")


def split_release(c: Column) -> Column:
    """struct(artist, title) of a release listed as "artist - title"; without the mark, or with nothing before it, all is the title."""
    at = F.locate(" - ", c)
    return F.struct(F.when(at > 1, F.trim(F.substring(c, F.lit(1), at - 1))).otherwise("").alias("artist"), F.trim(F.when(at > 1, F.substring(c, at + 3, F.length(c))).otherwise(c)).alias("title"))


def localized_titles(translations: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(id, locale, title) of each film. translations: id, position, language, country, title, name; alternatives: id, position, country, title.

    A locale's title is its first translation that is no copy of the English one, else its first such alternative title. Of English
    titles the first that differs from the first of all wins, else the last.
    """
    code = F.when(F.col("language").isin("pt", "zh"), F.concat_ws("-", "language", "country")).otherwise(F.col("language"))
    lookup = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)
    shown = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("title", "name")])
    said = translations.select("id", "position", F.col("language"), lookup(TRANSLATION_LOCALES, code).alias("locale"), shown.alias("title")).where("title is not null")
    english = said.where("language = 'en'").groupBy("id").agg(F.min_by("title", "position").alias("_en"))
    more = alternatives.select("id", "position", lookup(COUNTRY_LOCALES, F.col("country")).alias("locale"), F.trim("title").alias("title"), F.lit(1).alias("rank")).where("title != ''")
    every = said.select("id", "position", "locale", "title", F.lit(0).alias("rank")).unionByName(more).where("locale is not null").join(english, "id", "left")
    copy = F.coalesce(title_name(F.col("title")) == title_name(F.col("_en")), F.lit(False))
    kept = every.where((F.col("locale") == "en") | ~copy)
    turn = F.struct("rank", copy, F.when(copy, -F.col("position")).otherwise(F.col("position")))
    return kept.groupBy("id", "locale").agg(F.min_by("title", turn).alias("title"))


def role_verdict(entries: DataFrame, asked: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """(id, verdict, evidence) of each asked name: confirmed where one of its first entries tells a role of its type.

    asked: id, type; entries: id, position, title, description. Without entries the verdict is ``no_entry``; entries that tell no such role
    make it ``review`` and no refusal, as they may be of a namesake. ``roles`` gives each type its words.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))
    words = F.create_map(*[x for kind, said in roles.items() for x in (F.lit(kind), F.array(*map(F.lit, said)))])
    rows = entries.where(F.col("position") < MOST_ENTRIES).join(asked, "id").withColumn("_d", plain(F.col("description")))
    tells = F.exists(F.coalesce(F.try_element_at(words, F.col("type")), F.array().cast("array<string>")), lambda w: F.contains("_d", w))
    short = F.when(F.length("_d") > 60, F.concat(F.substring("_d", 1, 60), F.lit("…"))).otherwise(F.col("_d"))
    best = rows.groupBy("id").agg(F.bool_or(tells).alias("_ok"), F.min_by(F.concat_ws(" | ", plain(F.col("title")), short), F.struct(~tells, F.col("position"))).alias("evidence"))
    verdict = F.when(F.col("_ok"), "confirmed").when(~F.col("_ok"), "review").otherwise("no_entry")
    return asked.select("id").distinct().join(best, "id", "left").select("id", verdict.alias("verdict"), F.coalesce("evidence", F.lit("")).alias("evidence"))
