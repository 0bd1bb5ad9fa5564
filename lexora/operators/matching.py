"""Names in texts, lookups, and picking the entity that a term means."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.text import PARTICLES, key_composed, key_posix, key_unicode, nfc_each
from lexora.operators.relational import top_per_key


#: Names, and characters of all names, up to which a dictionary goes to every task.
MOST_NAMES, MOST_CHARACTERS = 200_000, 16 << 20
_HANGUL = re.compile("[가-힣]")
_BEHIND = re.compile(f"(?:{'|'.join(PARTICLES)}|[^가-힣]|$)")


def boundary(text: Column, name: Column) -> Column:
    """Whether a name counts as mentioned: never with one character; of two or three, pure Hangul needs a start
    before which no Hangul stands, and behind it a particle, something other than Hangul, or the end; any other
    need only occur. The plain containment test stands first, so the pattern runs on few rows."""
    pattern = F.concat(F.lit("(?:^|[^가-힣])\\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit(f"\\E{_BEHIND.pattern}"))
    short = ~name.rlike("^[가-힣]+$") | F.rlike(text, pattern)
    size = F.length(name)
    return (size >= 2) & F.contains(text, name) & ((size >= 4) | short)


def _mentioned(text: str, name: str, end: int) -> bool:
    """The same test of one occurrence, by where it ends."""
    start = end - len(name) + 1
    if len(name) >= 4 or not all(_HANGUL.match(c) for c in name):
        return True
    return (start == 0 or not _HANGUL.match(text[start - 1])) and bool(_BEHIND.match(text, end + 1))


def _finder(names: list[tuple], columns: list[str]):
    """Occurrences of all names by one automaton: (text id, name id, fragment) for every text and name that it mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, owners = ahocorasick.Automaton(), {}
        for key, name in names:
            owners.setdefault(name, []).append(key)
        for name in owners:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            at, keys, sizes = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                best: dict = {}
                sure: set[str] = set()
                for end, name in automaton.iter(text or ""):
                    if name not in sure and _mentioned(text, name, end):
                        sure.add(name)
                        best |= {key: max(len(name), best.get(key, 0)) for key in owners[name]}
                at += [i] * len(best)
                keys += best
                sizes += best.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys), pa.array(sizes, pa.int32())], columns)

    return run


def rare_gram_candidates(texts: DataFrame, names: DataFrame, text: str, text_id: str, name: str, name_id: str) -> DataFrame:
    """(text_id, name_id, name): pairs where a text holds the rarest n-gram of a name.

    The way for a dictionary of any size: grams of four characters (two for shorter names), those of the texts
    kept only where the dictionary has them, and each name joined on the one that fewest texts hold.
    """
    width = F.when(F.length(name) >= 4, 4).otherwise(2)
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))
    keyed = names.where(F.length(name) >= 2).select(name_id, name, F.explode(F.array_distinct(grams(F.col(name), width))).alias("_g"))
    wanted = keyed.select("_g").distinct()
    offered = texts.select(text_id, F.explode(F.array_distinct(F.concat(grams(F.col(text), F.lit(4)), grams(F.col(text), F.lit(2))))).alias("_g"))
    hits = offered.join(wanted, "_g", "left_semi")
    held = hits.groupBy("_g").agg(F.count("*").alias("_n"))
    # A gram that no text holds rules its name out.
    rarest = keyed.join(held, "_g", "left").groupBy(name_id, name).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r"))
    return hits.join(rarest.where("_r.n > 0").select(name_id, name, F.col("_r.g").alias("_g")), "_g").select(text_id, name_id, name)


def match_texts(texts: DataFrame, names: DataFrame, text: str, text_id: str, name: str, name_id: str, limit: int | None = 100, most: int = MOST_NAMES) -> DataFrame:
    """(text_id, name_id, fragment, place): entities mentioned in each text, longest fragment first.

    Without a limit, all of them, and no place. A dictionary of up to ``most`` names and ``MOST_CHARACTERS``
    characters goes to every task as an automaton, and each text is read once; a larger one is joined with the
    texts on its names' rarest n-grams, and the pairs are tested on the text itself.
    """
    names = names.where(F.length(name) >= 2).select(name_id, name).distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(name)), F.lit(0)).alias("c")).first()
    if size["n"] <= most and size["c"] <= MOST_CHARACTERS:
        kinds = [texts.schema[text_id].dataType.simpleString(), names.schema[name_id].dataType.simpleString()]
        finder = _finder([tuple(r) for r in names.collect()], [text_id, name_id, "fragment"])
        found = texts.select(text_id, text).mapInArrow(finder, f"{text_id} {kinds[0]}, {name_id} {kinds[1]}, fragment int") if size["n"] else None
        best = names.select(F.lit(None).cast(kinds[0]).alias(text_id), name_id, F.lit(0).alias("fragment")).where("false") if found is None else found.groupBy(text_id, name_id).agg(F.max("fragment").alias("fragment"))
    else:
        pairs = rare_gram_candidates(texts, names, text, text_id, name, name_id)
        tested = pairs.join(texts.select(text_id, text), text_id).where(boundary(F.col(text), F.col(name)))
        best = tested.groupBy(text_id, name_id).agg(F.max(F.length(name)).alias("fragment"))
    if limit is None:
        return best
    return top_per_key(best, [text_id], [F.desc("fragment"), F.asc(name_id)], limit, "place")


def fragment_length(text: Column, canonical: Column, aliases: Column) -> Column:
    """The longest of a name and its aliases that occurs in a text: the specificity of a match."""
    hits = F.filter(F.concat(F.array(canonical), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: (F.length(a) >= 2) & F.contains(F.lower(text), F.lower(a)))
    return F.coalesce(F.array_max(F.transform(hits, lambda a: F.length(a))), F.lit(0))


def search_rank(name: Column, term: str) -> Column:
    """0 exact, 1 equal by key, 2 contained, 3 otherwise."""
    t = F.lit(term)
    return F.when(name == t, 0).when(key_posix(name) == key_posix(t), 1).when(F.contains(F.lower(name), F.lower(t)), 2).otherwise(3)


def search(entities: DataFrame, name: str, term: str, order: list[Column], limit: int = 20, offset: int = 0, extra: Column | None = None) -> DataFrame:
    """Entities that hold a term, best rank first: a top list, not a full sort."""
    rank = search_rank(F.col(name), term)
    held = (rank < 3) if extra is None else (rank < 3) & extra
    return entities.where(held).withColumn("rank", rank).orderBy("rank", *order).offset(offset).limit(limit)


def entity_filter(q: str | None = None, kind: str | None = None, status: str | None = "active", least: float | None = None, since: str | None = None, columns: dict[str, str] | None = None) -> Column:
    """Optional parameters as one condition that Catalyst folds and pushes down; absent ones cost nothing."""
    at = {"name": "name", "type": "type", "status": "status", "confidence": "confidence", "updated": "updated_at"} | (columns or {})
    out = F.lit(True)
    if q:
        out &= F.contains(F.lower(at["name"]), F.lit(q.lower()))
    if kind:
        out &= F.col(at["type"]) == kind
    if status:
        out &= F.col(at["status"]) == status
    if least is not None:
        out &= F.col(at["confidence"]) >= least
    if since:
        out &= F.col(at["updated"]) >= F.lit(since)
    return out


def clamp_limit(limit: int | None, default: int = 20, most: int = 100) -> int:
    return default if not limit or limit < 0 else min(limit, most)


def any_name(names: Column, term: str) -> Column:
    """Case-blind containment over an array of names: no join."""
    return F.exists(names, lambda n: F.contains(F.lower(n), F.lit(term.lower())))


def split_exact(df: DataFrame, names: str, term: str) -> tuple[DataFrame, DataFrame]:
    """(exact, related): rows one of whose names equals the term by key, and the others."""
    key = key_composed(F.lit(unicodedata.normalize("NFC", term)))
    exact = F.exists(nfc_each(F.col(names)), lambda n: key_composed(n) == key)
    return df.where(exact), df.where(~exact)


def hidden_by_type(all_types: DataFrame, typed: DataFrame, key: str) -> DataFrame:
    """Matches that only a type filter hides."""
    return all_types.join(typed.select(key), key, "left_anti")


def lookup_status(exact: Column) -> Column:
    return F.when(exact == 0, "miss").when(exact == 1, "found").otherwise("ambiguous")


def pick_exact(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity each term means: same type first, then locked, confident, oldest; with how many fit.

    terms: term, hint; entities: id, name, type, locked, confidence. Join on the name's key: one pass for
    all terms. ``safe`` is false where several fit and no type tells them apart.
    """
    left = terms.withColumn("_k", key_unicode(F.col("term")))
    right = entities.withColumn("_k", key_unicode(F.col("name")))
    met = left.join(right, "_k")
    typed = F.coalesce(F.col("hint") == F.col("type"), F.lit(False))
    every = Window.partitionBy("term", "hint")
    rows = met.withColumns({"exact": F.col("name") == F.col("term"), "typed": typed, "fits": F.count("*").over(every), "fits_type": F.count_if(typed).over(every)})
    best = top_per_key(rows, ["term", "hint"], [F.desc("typed"), F.desc("exact"), F.desc("locked"), F.desc("confidence"), F.asc("id")])
    safe = (F.col("fits") == 1) | (F.col("typed") & (F.col("fits_type") == 1))
    return best.select("term", "hint", "id", "type", "fits", safe.alias("safe"))


def prepare_status(terms: DataFrame, picked: DataFrame, ready: DataFrame, dead: DataFrame) -> DataFrame:
    """ready, preparing, unfillable, out_of_scope or new for each term, in one join of all terms.

    picked: term, hint, id, safe; ready: id, missing, exhausted; dead: term.
    """
    joined = terms.join(picked.select("term", "hint", "id", "safe"), ["term", "hint"], "left").join(ready, "id", "left").join(dead.select("term").distinct().withColumn("_dead", F.lit(True)), "term", "left")
    status = (
        F.when(F.col("_dead"), "out_of_scope").when(F.col("id").isNull(), "new").when(~F.col("safe"), "preparing")
        .when(F.coalesce("missing", F.lit(0)) == 0, "ready").when(F.col("exhausted") >= F.col("missing"), "unfillable").otherwise("preparing")
    )
    return joined.select("term", "hint", "id", status.alias("status"))


def co_mention(hints: DataFrame, names: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """The longest other name that each hint contains as a whole word. hints: id, hint, own; names: name."""
    fit = names.where(F.length("name").between(least, most)).select("name").distinct()
    words = F.split("hint", " ")
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    offered = hints.select("id", "own", F.explode(F.array_distinct(stretches)).alias("name"))
    return offered.join(fit, "name").where(F.col("name") != F.col("own")).groupBy("id").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"))
