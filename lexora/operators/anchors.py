"""Whether an entry of a knowledge base is the organization or institution that a record means.

Entries: names (labels and aliases), classes, countries (ids), descriptions (map by locale), titles (map by site). Each record's type,
the classes that fit it and those known at all come from ``allowed``: class to the types it may stand for. A null list or map is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexora.functions.text import let
from lexora.sources.picks import artist_name

# The id of the country meant, and words of a description that tell it and that tell another.
COUNTRY = "Q884"
COUNTRY_WORDS = ["south korea", "korean", "in korea", "of korea"]
FOREIGN_WORDS = ["united states", "u.s. federal", "japanese", "chinese", "taiwan", "north korean", "american", "british", "vietnamese"]


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def _said(descriptions: Column, locale: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.try_element_at(descriptions, F.lit(locale)), F.lit(""))))


def _fits(classes: Column, kind: Column, allowed: dict[str, list[str]]) -> tuple[Column, Column]:
    """(known, allowed) arrays, one element a class."""
    table = F.create_map(*[x for c, kinds in allowed.items() for x in (F.lit(c), F.array(*map(F.lit, kinds)))])
    known = F.filter(_list(classes), lambda c: F.try_element_at(table, c).isNotNull())
    return known, F.filter(known, lambda c: F.array_contains(F.try_element_at(table, c), kind))


def same_name(name: Column, names: Column) -> Column:
    """Whether one of an entry's names is a record's, apart from case, spaces and marks."""
    return let(artist_name(F.coalesce(name, F.lit(""))), lambda want: (want != "") & F.coalesce(F.exists(_list(names), lambda n: F.coalesce(artist_name(n) == want, F.lit(False))), F.lit(False)))


def organization_anchor(name: Column, kind: Column, entry: Column, allowed: dict[str, list[str]], name_classes: Sequence[str], words: Sequence[str]) -> Column:
    """struct(decision, reason): promote, hold or skip; the first rule that holds, and what is not known never promotes.

    name_classes: classes of names themselves; words: what a description of the country says. An entry of the wrong country is
    skipped; without any country a description decides, and without that the record is held and nothing is written.
    """
    known, fit = _fits(entry["classes"], kind, allowed)
    countries = F.filter(_list(entry["countries"]), lambda c: c.isNotNull())
    told = _holds(_said(entry["descriptions"], "en"), words) | _holds(_said(entry["descriptions"], "ko"), words)
    verdict = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    return (
        F.when(entry.isNull(), verdict("skip", "fetch-failed")).when(F.arrays_overlap(_list(entry["classes"]), F.array(*map(F.lit, name_classes)).cast("array<string>")), verdict("skip", "name-element"))
        .when(~same_name(name, entry["names"]), verdict("skip", "name-mismatch")).when((F.size(fit) == 0) & (F.size(known) > 0), verdict("skip", "type-mismatch")).when(F.size(fit) == 0, verdict("skip", "type-unknown"))
        .when(F.array_contains(countries, COUNTRY), verdict("promote", "country-kr")).when(F.size(countries) > 0, verdict("skip", "foreign")).when(told, verdict("promote", "country-desc"))
        .otherwise(verdict("hold", "country-unknown"))
    )


def institution_anchor(name: Column, kind: Column, entry: Column, allowed: dict[str, list[str]], identity_known: Column) -> Column:
    """Why an entry does not anchor an institution, or null: ``type``, ``korea`` or ``title``, in this order.

    Only a class known not to fit speaks against the type. The country shows in the entry's countries or its English description,
    and a description that names another one overrules both. The title of the Korean article, without what stands in parentheses
    behind it, must be the name, unless the identity is known already.
    """
    known, fit = _fits(entry["classes"], kind, allowed)
    said = _said(entry["descriptions"], "en")
    home = F.array_contains(F.array_compact(_list(entry["countries"])), COUNTRY) | _holds(said, COUNTRY_WORDS)
    title = F.trim(F.coalesce(F.try_element_at(entry["titles"], F.lit("kowiki")), F.lit("")))
    bare = F.trim(F.regexp_replace(title, r"(?s)^(.+) \(.*\)$", "$1"))
    same = (title != "") & (artist_name(bare) == artist_name(F.coalesce(name, F.lit(""))))
    return F.when(F.size(fit) < F.size(known), "type").when(~home | _holds(said, FOREIGN_WORDS), "korea").when(~F.coalesce(identity_known, F.lit(False)) & ~same, "title")
