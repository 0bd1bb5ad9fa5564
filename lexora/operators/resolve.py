"""Homonyms, candidate clusters, merge gates and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions.text import blank_to_null
from lexora.operators.components import connected_components
from lexora.operators.relational import array_minus_self, top_per_key

_EMPTY = "array<string>"


def _said(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def _role(c: Column) -> Column:
    return F.nullif(_said(c), F.lit("other"))


def _works(c: Column) -> Column:
    return F.filter(F.coalesce(F.transform(c, lambda w: F.lower(F.trim(w))), F.array().cast(_EMPTY)), lambda w: w != "")


def _year(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def conflict(a: str, b: str) -> Column:
    """Whether two people's known signals contradict: agency, birth year, role, or works without overlap.

    a, b: struct columns with agency, birth_year, role and works.
    """
    x, y = F.col(a), F.col(b)
    differs = lambda f, k: F.coalesce(f(x[k]) != f(y[k]), F.lit(False))
    works = (F.size(_works(x["works"])) > 0) & (F.size(_works(y["works"])) > 0) & ~F.arrays_overlap(_works(x["works"]), _works(y["works"]))
    return differs(_said, "agency") | differs(_year, "birth_year") | differs(_role, "role") | F.coalesce(works, F.lit(False))


def compatible(a: str, b: str) -> Column:
    """Whether two people share a known signal."""
    x, y = F.col(a), F.col(b)
    same = lambda f, k: F.coalesce(f(x[k]) == f(y[k]), F.lit(False))
    return same(_said, "agency") | same(_year, "birth_year") | same(_role, "role") | F.coalesce(F.arrays_overlap(_works(x["works"]), _works(y["works"])), F.lit(False))


def disambiguator(agency: Column, role: Column, year: Column) -> Column:
    """A label that tells a person apart: agency, else role, else birth year."""
    label = F.coalesce(blank_to_null(agency), F.when(_role(role).isNotNull(), F.trim(role)), _year(year).cast("string"))
    return F.when(label.isNull(), "").otherwise(F.concat(F.lit("("), label, F.lit(")")))


def star_edges(df: DataFrame, key: str, by: list[str], reason: str) -> DataFrame:
    """An edge from each group's smallest key to its other members: linear in the group, not all pairs."""
    held = df.where(" and ".join(f"{c} is not null" for c in by))
    least = held.groupBy(*by).agg(F.min(key).alias("src"), F.count_distinct(key).alias("members")).where("members > 1").drop("members")
    return held.join(least, by).where(F.col("src") != F.col(key)).select("src", F.col(key).alias("dst"), F.lit(reason).alias("reason")).distinct()


def candidate_clusters(edges: DataFrame) -> DataFrame:
    """(node, component) of the clusters that edges from all sources form together."""
    return connected_components(edges.select("src", "dst"))


def merge_gate(a_type: Column, b_type: Column, a_active: Column, conflicts: Column, shared: Column) -> Column:
    """Why two records must not merge, or null: in this order."""
    return (
        F.when(~a_active, "survivor_inactive").when(a_type.isNull() | b_type.isNull(), "type_unknown").when(a_type != b_type, "type_differs")
        .when(conflicts > 0, "provider_conflict").when(shared == 0, "no_shared_id")
    )


def provider_conflicts(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, conflicts, shared): external ids of one provider that differ or agree, for each pair."""
    x = refs.select(F.col("entity").alias("a"), "provider", F.col("external_id").alias("xa"))
    y = refs.select(F.col("entity").alias("b"), "provider", F.col("external_id").alias("xb"))
    met = pairs.select("a", "b").join(x, "a").join(y, ["b", "provider"])
    return met.groupBy("a", "b").agg(F.count_if(F.col("xa") != F.col("xb")).alias("conflicts"), F.count_if(F.col("xa") == F.col("xb")).alias("shared"))


def survivor_order(df: DataFrame, cluster: str, locked: str, refs: str, urls: str, created: str, key: str) -> DataFrame:
    """The record each cluster keeps: locked, most references, most URLs, oldest."""
    return top_per_key(df, [cluster], [F.desc(locked), F.desc(refs), F.desc(urls), F.asc(created), F.asc(key)])


def plan_faults(plan: DataFrame, members: DataFrame) -> DataFrame:
    """(id, fault) of a merge plan: repeated, outside its cluster, or merged into one not kept.

    plan: id, verdict, same_as; members: id.
    """
    kept = plan.where("verdict = 'distinct'").select(F.col("id").alias("same_as")).distinct().withColumn("_kept", F.lit(True))
    twice = plan.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("fault"))
    outside = plan.join(members.select("id").distinct(), "id", "left_anti").select("id", F.lit("outside").alias("fault")).distinct()
    chained = plan.where("verdict = 'same'").join(kept, "same_as", "left").where("_kept is null").select("id", F.lit("survivor_not_distinct").alias("fault")).distinct()
    return twice.unionByName(outside).unionByName(chained)


def flatten_redirects(redirects: DataFrame) -> DataFrame:
    """(old, survivor) with chains followed to their end: the component's one id that is no one's old."""
    groups = connected_components(redirects.select(F.col("old").alias("src"), F.col("survivor").alias("dst")))
    ends = groups.join(redirects.select(F.col("old").alias("node")).distinct(), "node", "left_anti").groupBy("component").agg(F.min("node").alias("end"))
    return redirects.select("old").distinct().join(groups, F.col("old") == F.col("node")).join(ends, "component").select("old", F.col("end").alias("survivor"))


def apply_redirects(rows: DataFrame, redirects: DataFrame, key: str) -> DataFrame:
    """Rows with old ids replaced by their survivors."""
    moved = rows.join(redirects.select(F.col("old").alias(key), "survivor"), key, "left")
    return moved.withColumn(key, F.coalesce("survivor", key)).drop("survivor").select(*rows.columns)


def merge_names(winners: DataFrame, losers: DataFrame) -> DataFrame:
    """Aliases of each survivor with the losers' names carried over. winners: id, name, aliases; losers: id (of the survivor), name, aliases."""
    carried = losers.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast(_EMPTY))))))).alias("carried"))
    return winners.join(carried, "id", "left").select("id", "name", F.array_sort(array_minus_self(F.col("aliases"), F.col("carried"), F.col("name"))).alias("aliases"))


def sole_alias_owner(claims: DataFrame) -> DataFrame:
    """(name, owner): names that are no one's canonical name and one entity's alias. claims: name, entity, kind."""
    counted = claims.distinct().groupBy("name").agg(F.count_if(F.col("kind") == "canonical").alias("c"), F.count_if(F.col("kind") == "alias").alias("n"), F.min("entity").alias("owner"))
    return counted.where("c = 0 and n = 1").select("name", "owner")


def name_splits(names: DataFrame) -> DataFrame:
    """(name, a, b): a canonical name that is another entity's alias. names: name, entity, kind."""
    own = names.where("kind = 'canonical'").select("name", F.col("entity").alias("a"))
    other = names.where("kind = 'alias'").select("name", F.col("entity").alias("b"))
    return own.join(other, "name").where("a <> b").distinct()


def quorum_ids(refs: DataFrame, by: str) -> DataFrame:
    """Groups that agree on a single external id."""
    return refs.groupBy(by).agg(F.count_distinct("external_id").alias("n"), F.min("external_id").alias("external_id")).where("n = 1").select(by, "external_id")


def reserve_ids(refs: DataFrame, arrival: str) -> DataFrame:
    """(provider, external_id, entity, accepted): the first owner of an id keeps it, others are refused."""
    firsts = refs.groupBy("provider", "external_id").agg(F.min_by("entity", F.struct(arrival, "entity")).alias("first"))
    return refs.join(firsts, ["provider", "external_id"]).select("provider", "external_id", "entity", (F.col("entity") == F.col("first")).alias("accepted"))


def domain_vote(occupations: DataFrame, table: dict[str, str], precedence: list[str]) -> DataFrame:
    """(id, domain): the domain most of an entity's occupations belong to; ties by precedence."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("domain"))
    counted = occupations.select("id", F.try_element_at(known, F.col("occupation")).alias("domain")).where("domain is not null").groupBy("id", "domain").agg(F.count("*").alias("n"))
    return top_per_key(counted, ["id"], [F.desc("n"), rank.asc()]).select("id", "domain")


def pick_track(wanted: DataFrame, tracks: DataFrame, roster: DataFrame) -> DataFrame:
    """The catalogue track of each title: equal by key, by an artist of the roster, the oldest release.

    wanted: id, title; tracks: track, title, artist, released; roster: artist.
    """
    from lexora.functions.text import markers_covered, title_key

    left = wanted.select("id", F.col("title").alias("own"), title_key(F.col("title")).alias("_k"))
    right = tracks.join(roster.select("artist").distinct(), "artist", "left_semi").withColumn("_k", title_key(F.col("title")))
    met = left.join(right, "_k").where(markers_covered(F.col("own"), F.col("title")))
    return top_per_key(met, ["id"], [F.asc("released"), F.asc("track")]).select("id", "track")


def relevant_hits(hits: DataFrame, variants: Column) -> DataFrame:
    """Evidence hits that hold a variant of the name. hits: title, snippet and the columns variants reads."""
    body = F.lower(F.concat_ws(" ", "title", "snippet"))
    return hits.where(F.exists(variants, lambda v: (v != "") & F.contains(body, F.lower(v))))


def anchor_verdict(name: Column, names: Column, kind: Column, kinds: Column, known: Column) -> Column:
    """Whether a knowledge-base entry anchors a record: one of its names equals, its classes fit, or the identity is known."""
    equal = F.exists(names, lambda n: F.lower(n) == F.lower(name))
    return F.when(known & equal, "accept").when(~equal, "name_differs").when(~F.array_contains(kinds, kind), "class_conflict").otherwise("accept")


def class_conflict(expected: Column, found: Column) -> Column:
    """Whether a source's classes and an entry's classes are both known and disjoint."""
    return (F.size(expected) > 0) & (F.size(found) > 0) & ~F.arrays_overlap(expected, found)


def repair_variants(simplified: Column, traditional: Column, trad_only: str, simp_only: str, table: dict[str, str]) -> Column:
    """struct(action, simplified, traditional): swap columns that hold each other's script, convert one, or hold."""
    from lexora.functions.text import convert_variants, holds_any

    wrong, other = holds_any(simplified, trad_only), holds_any(traditional, simp_only)
    turned = convert_variants(simplified, trad_only, table)
    return (
        F.when(wrong & other, F.struct(F.lit("swap").alias("action"), traditional.alias("simplified"), simplified.alias("traditional")))
        .when(wrong & turned["ok"], F.struct(F.lit("convert").alias("action"), turned["value"].alias("simplified"), F.coalesce(traditional, simplified).alias("traditional")))
        .when(wrong | other, F.struct(F.lit("hold").alias("action"), simplified.alias("simplified"), traditional.alias("traditional")))
        .otherwise(F.struct(F.lit("keep").alias("action"), simplified.alias("simplified"), traditional.alias("traditional")))
    )


def cascade(target: DataFrame, layers: list[tuple[str, DataFrame]], key: str, columns: list[str]) -> DataFrame:
    """Fills missing columns from source tables in layer order; each value carries its source."""
    out = target
    for column in columns:
        out = out.withColumn(f"{column}_source", F.when(F.col(column).isNotNull(), F.lit("own")))
    for name, layer in layers:
        held = [c for c in columns if c in layer.columns]
        renamed = layer.select(key, *[F.col(c).alias(f"_{c}") for c in held]).dropDuplicates([key])
        out = out.join(renamed, key, "left")
        for c in held:
            fresh = F.col(c).isNull() & F.col(f"_{c}").isNotNull()
            out = out.withColumn(f"{c}_source", F.when(fresh, F.lit(name)).otherwise(F.col(f"{c}_source"))).withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out
