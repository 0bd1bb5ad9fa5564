"""Fuzzy name joins on shared character n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.functions.text import grams, is_abbreviation, jaccard, key_match, trigrams
from lexora.operators.relational import top_per_key


def gram_join(left: DataFrame, right: DataFrame, threshold: float, n: int | None = None, limit: int | None = None) -> DataFrame:
    """(lid, rid, similarity): pairs whose gram sets have a Jaccard similarity of at least ``threshold``.

    left: lid, lname; right: rid, rname. Names are made distinct first. Pairs are found by an equi join
    on a prefix of each name's grams, rarest first: two sets that reach the threshold share a gram
    among their first size - ceil(threshold * size) + 1. So the grams that many names hold hardly ever meet.
    Each pair of names is compared once on the whole sets. Without ``n`` the grams are padded trigrams.
    """
    of = (lambda c: trigrams(c)) if n is None else (lambda c: grams(c, n))
    own = left.select(F.col("lname").alias("name")).distinct().select("name", F.explode(of(F.col("name"))).alias("g"))
    other = right.select(F.col("rname").alias("name")).distinct().select("name", F.explode(of(F.col("name"))).alias("g"))
    held = own.select("g").union(other.select("g")).groupBy("g").agg(F.count("*").alias("held"))
    rare = F.transform(F.array_sort(F.collect_list(F.struct("held", "g"))), lambda x: x["g"])
    ordered = lambda side, name, gs: side.join(held, "g").groupBy(F.col("name").alias(name)).agg(rare.alias(gs))
    a, b = ordered(own, "a", "ga"), ordered(other, "b", "gb")
    prefix = lambda g: F.slice(g, F.lit(1), (F.size(g) - F.ceil(threshold * F.size(g) - 1e-9) + 1).cast("int"))
    fits = F.least(F.size("ga"), F.size("gb")) >= threshold * F.greatest(F.size("ga"), F.size("gb")) - 1e-9
    met = a.withColumn("g", F.explode(prefix(F.col("ga")))).join(b.withColumn("g", F.explode(prefix(F.col("gb")))), "g").where(fits)
    scored = met.select("a", "b", "ga", "gb").dropDuplicates(["a", "b"]).withColumn("similarity", jaccard(F.col("ga"), F.col("gb"))).where(F.col("similarity") >= threshold)
    pairs = scored.select("a", "b", "similarity")
    if limit:
        pairs = top_per_key(pairs, ["a"], [F.desc("similarity"), F.asc("b")], limit)
    return left.join(pairs, F.col("lname") == F.col("a")).join(right, F.col("rname") == F.col("b")).select("lid", "lname", "rid", "rname", "similarity")


def abbreviations(hints: DataFrame, names: DataFrame) -> DataFrame:
    """Hints with the names they abbreviate: equal to a prefix of a name without spaces, or of its initials.

    Joined on whole prefixes, as many as a name has characters, so no first letter is a hot key.
    """
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    initials = F.array_join(F.transform(F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), "")
    prefixes = lambda c: F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))).otherwise(F.expr("cast(array() as array<string>)"))
    offered = names.withColumn("_f", F.explode(F.array_distinct(F.concat(prefixes(bare("name")), prefixes(initials)))))
    asked = hints.withColumn("_f", F.explode(F.array_distinct(F.array("hint", bare("hint")))))
    return asked.join(offered, "_f").where(is_abbreviation(F.col("hint"), F.col("name"))).drop("_f").distinct()


def alias_cascade(hints: DataFrame, names: DataFrame, threshold: float = 0.6, limit: int = 5) -> DataFrame:
    """Matches of each hint: equal alias (1.0), abbreviation (0.85), then similar spelling, best first.

    hints: hint; names: id, name.
    """
    found = hints.withColumn("_k", key_match(F.col("hint"))).join(names.withColumn("_k", key_match(F.col("name"))), "_k")
    equal = found.select("hint", "id", "name", F.lit(1.0).alias("score"), F.lit("alias").alias("how"))
    near = abbreviations(hints, names).where(F.col("hint") != F.col("name"))
    short = near.select("hint", "id", "name", F.lit(0.85).alias("score"), F.lit("abbreviation").alias("how"))
    alike = gram_join(hints.select(F.col("hint").alias("lid"), F.col("hint").alias("lname")), names.select(F.col("id").alias("rid"), F.col("name").alias("rname")), threshold)
    typo = alike.select(F.col("lname").alias("hint"), F.col("rid").alias("id"), F.col("rname").alias("name"), F.col("similarity").alias("score"), F.lit("similar").alias("how"))
    every = equal.unionByName(short).unionByName(typo)
    once = top_per_key(every, ["hint", "id"], [F.desc("score"), F.asc("how")])
    return top_per_key(once, ["hint"], [F.desc("score"), F.asc("id")], limit, "place")
