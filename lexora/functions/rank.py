"""Source ranking, trust, fingerprints and date rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each source label; 1 is strongest. Labels that begin with RSS rank 3, others 99.
SOURCE_RANKS = {
    1: ["operator-locked", "operator", "local-usage"],
    2: ["media-consensus"],
    4: ["tmdb", "kofic", "kmdb", "musicbrainz", "naver-people", "correction-verified", "netflix", "disney", "itunes", "discogs", "cube-official", "warner-japan", "melon", "genie", "bugs", "vibe", "qq-music", "netease-music", "tencent-music", "spotify", "komca", "official-page", "broadcaster-official", "ott-official", "tving", "wavve", "watcha", "coupang-play", "viki", "lollapalooza", "yes24-livehall", "wikipedia-title"],
    5: ["wikidata-label"],
    6: ["wikipedia-langlinks", "wikipedia-sitelink", "wikipedia-zh-variant", "kowiki-hanja"],
    7: ["local-search", "mydramalist", "romanization", "opencc", "tvmaze", "naver-encyc", "naver-search", "kakao-search", "youtube-official", "namuwiki", "baidu-baike", "gemini-search"],
    8: ["gtranslate", "codex-fallback", "kana-rule"],
    9: ["gtranslate-raw", "llm-provisional", "consumer-suggestion"],
}
RSS = "rss-observation"
# Labels that machines fill, and those whose agreement verifies a name.
MACHINE_FILLED = ["codex-fallback", "gtranslate", "gtranslate-raw", "kana-rule", "romanization", "opencc", "llm-provisional", "consumer-suggestion"]
AUTHORITIES = ["tmdb", "kofic", "kmdb", "musicbrainz", "naver-people", "correction-verified", "wikidata-label", "wikipedia-langlinks", "wikipedia-sitelink", "wikipedia-zh-variant"]
LOCKED = ["operator-locked", "operator"]
MEDIA_CONFIRMS = 3


def source_priority(source: Column) -> Column:
    """Rank of a source label; unknown and null are 99."""
    out = F.when(F.startswith(source, F.lit(RSS)), 3)
    for rank, labels in SOURCE_RANKS.items():
        out = out.when(source.isin(labels), rank)
    return out.otherwise(99)


def replace_decision(current: Column, value: Column, incoming: Column, offered: Column) -> Column:
    """struct(replace, drift): a strictly stronger source replaces; an equal one with another value is drift."""
    own, new = source_priority(current), source_priority(incoming)
    free = ~F.coalesce(current.isin(LOCKED), F.lit(False))
    return F.struct((free & (new < own)).alias("replace"), (free & (new == own) & ~value.eqNullSafe(offered)).alias("drift"))


def can_replace(locked: Column, current: Column, incoming: Column) -> Column:
    """The guard of a stored value: never if locked, else if the incoming source is not weaker."""
    return ~F.coalesce(locked, F.lit(False)) & (source_priority(incoming) <= source_priority(current))


def weaker_machine_sources(source: str = "") -> list[str]:
    """Machine-filled labels weaker than a source; all of them without one."""
    ranks = {label: rank for rank, labels in SOURCE_RANKS.items() for label in labels}
    own = (3 if source.startswith(RSS) else ranks.get(source, 99)) if source else -1
    return [m for m in MACHINE_FILLED if own < 0 or ranks[m] > own]


def trust_tier(locked: Column, domains: Column, sources: Column) -> Column:
    """confirmed, verified, observed or llm, from a lock, the number of media domains and the source labels."""
    return (
        F.when(F.coalesce(locked, F.lit(False)) | (domains >= MEDIA_CONFIRMS), "confirmed")
        .when(F.arrays_overlap(F.coalesce(sources, F.array()), F.array(*map(F.lit, AUTHORITIES))), "verified")
        .when((domains >= 1) | F.exists(sources, lambda s: F.startswith(s, F.lit(RSS)) | (s == "media-consensus")), "observed")
        .otherwise("llm")
    )


def verification_tier(authorities: Column, evidence: Column) -> Column:
    """authoritative over evidenced over unverified."""
    return F.when(authorities > 0, "authoritative").when(evidence > 0, "evidenced").otherwise("unverified")


def fingerprint(*parts: Column, separator: str = "|") -> Column:
    """MD5 of values joined by a separator; arrays sorted, nulls as empty."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def sorted_list(c: Column) -> Column:
    return F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")


def json_fingerprint(*columns: Column) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# Older entity types and the common type of each; all others are works.
COMMON_TYPES = {
    "person": "person", "group": "organization", "agency": "organization", "organization": "organization", "channel_outlet": "organization", "political_party": "organization",
    "government_body": "organization", "sports_team": "organization", "school": "organization", "company": "company", "location": "location", "event": "event", "product": "product",
    "character": "character", "event_tour": "event", "term": "concept", "unknown": "unknown",
}


def common_type(kind: Column, table: dict[str, str] = COMMON_TYPES, otherwise: str = "work") -> Column:
    out = F.lit(otherwise)
    for old, new in reversed(table.items()):
        out = F.when(kind == old, new).otherwise(out)
    return out


def provider_of(source: Column, prefixes: dict[str, str]) -> Column:
    """The provider whose prefix a source code begins with; else the code itself."""
    out = source
    for prefix, provider in reversed(prefixes.items()):
        out = F.when(F.startswith(source, F.lit(prefix)), provider).otherwise(out)
    return out


def ttl_clock(created: Column, notes: Column, mark: str = "reopened") -> Column:
    """The later of creation and the last date noted as [mark:YYYY-MM-DD]."""
    dates = F.regexp_extract_all(F.coalesce(notes, F.lit("")), F.lit(rf"\[{mark}:(\d{{4}}-\d{{2}}-\d{{2}})\]"), 1)
    return F.greatest(created, F.array_max(F.transform(dates, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")))))


def possible_range(precision: Column, year: Column, month: Column, day: Column, end: bool = False) -> Column:
    """First (or last) day that a date of some precision can mean; open and unknown have none."""
    first = F.when(precision == "day", F.make_date(year, month, day)).when(precision == "month", F.make_date(year, month, F.lit(1))).when(precision == "year", F.make_date(year, F.lit(1), F.lit(1)))
    if not end:
        return first
    return F.when(precision == "day", first).when(precision == "month", F.last_day(first)).when(precision == "year", F.make_date(year, F.lit(12), F.lit(31)))


def absence_reason(value: Column, source: Column, fell_back: Column, exhausted: Column) -> Column:
    """Why a locale has no value of its own."""
    return (
        F.when(fell_back, "english_fallback")
        .when((F.coalesce(value, F.lit("")) != ""), F.lit(None).cast("string"))
        .when(source.isin(MACHINE_FILLED), "machine_only")
        .when(exhausted, "exhausted")
        .otherwise("not_collected")
    )


def locale_gaps(values: Column, wanted: list[str]) -> Column:
    """The wanted locales without a value in a map of locale to value."""
    held = F.map_keys(F.map_filter(values, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return F.array_except(F.array(*map(F.lit, wanted)), held)


def first_known(claims: Column, table: dict[str, str]) -> Column:
    """The first claim that a table knows, as the table has it."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(F.filter(F.transform(claims, lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull()), F.lit(1))


def effective_source(value: Column, source: Column, english_source: Column) -> Column:
    """The source of the value shown: the locale's own, else that of the English name."""
    return F.when(F.nullif(F.trim(value), F.lit("")).isNotNull(), source).otherwise(english_source)


def provenance_class(source: Column, urls: Column) -> Column:
    """How a shown value came about."""
    wiki = F.exists(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.contains(F.lower(u), F.lit("wikipedia.org")))
    rank = source_priority(source)
    return (
        F.when(source.isin(LOCKED), "operator").when(rank == 1, "local_usage").when(rank == 2, "media_consensus").when(rank == 3, "media_observation")
        .when(source.isin("tmdb", "kofic", "kmdb"), "film_database").when(source.isin("musicbrainz", "itunes", "discogs", "spotify", "melon", "genie", "bugs", "vibe"), "music_database")
        .when(rank == 4, "official").when(rank == 5, "knowledge_base").when((rank == 6) | wiki, "encyclopedia").when(source.isin("romanization", "kana-rule", "opencc"), "rule")
        .when(rank == 7, "search").when(source.isin("gtranslate", "gtranslate-raw"), "translation").when(source.isin(MACHINE_FILLED), "machine").otherwise("unknown")
    )


def verified_value(source: Column, tier: Column) -> Column:
    """Whether a shown value counts as verified."""
    return ~F.coalesce(source.isin(MACHINE_FILLED), F.lit(False)) & tier.isin("authoritative", "evidenced")
