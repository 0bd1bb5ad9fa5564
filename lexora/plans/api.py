"""One facade over the public operations, batch-first: each takes and returns DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions import text as T
from lexora.operators import gate, matching, quality
from lexora.operators import relational as R

LOCALES = ["en", "ja", "vi", "zh", "zh_hant", "es", "id", "pt_br"]


class Catalogue:
    """Reads and rewrites of an entity table and its children.

    entities: id, name, type, status, confidence, locked, names (array), updated_at, and canonical_<locale> with
    canonical_<locale>_source; refs: entity, provider, external_id; relations: subject, predicate, object.
    """

    def __init__(self, entities: DataFrame, refs: DataFrame | None = None, relations: DataFrame | None = None, persons: DataFrame | None = None):
        self.entities, self.refs, self.relations_table, self.persons = entities, refs, relations, persons

    def projected(self) -> DataFrame:
        """Entities with nulls as empty strings and arrays."""
        kinds = dict(self.entities.dtypes)
        blank = lambda c: F.coalesce(c, F.lit("")) if kinds[c] == "string" else F.coalesce(c, F.array().cast(kinds[c])) if kinds[c].startswith("array") else F.col(c)
        return self.entities.select(*[blank(c).alias(c) for c in self.entities.columns])

    def list(self, q: str | None = None, limit: int | None = None, **conditions) -> DataFrame:
        """Entities that pass optional conditions, most relevant first."""
        rows = self.entities.where(matching.entity_filter(None, **conditions))
        n = matching.clamp_limit(limit)
        if not q:
            return rows.orderBy(F.desc("confidence"), F.desc("updated_at"), "id").limit(n)
        held = matching.any_name(F.col("names"), q) | (matching.search_rank(F.col("name"), q) < 3)
        return rows.where(held).withColumn("rank", matching.search_rank(F.col("name"), q)).orderBy("rank", F.desc("confidence"), F.desc("updated_at"), "id").limit(n)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.entities.join(ids.select("id"), "id", "left_semi")

    def spellings(self) -> DataFrame:
        """(id, locale, value) of every spelling there is: the unified name view."""
        held = {c: f"canonical_{c}" for c in LOCALES if f"canonical_{c}" in self.entities.columns}
        return R.unpivot(self.entities, ["id"], held | {"ko": "name"}, "locale", "value").where("value != ''")

    def references(self, ids: DataFrame) -> DataFrame:
        return self.refs.join(ids.select(F.col("id").alias("entity")), "entity", "left_semi").orderBy("entity", "provider")

    def relations(self, ids: DataFrame) -> DataFrame:
        both = R.both_ways(self.relations_table, "subject", "object", "predicate")
        return both.join(ids.select(F.col("id").alias("entity")), "entity", "left_semi")

    def with_person(self) -> DataFrame:
        return self.entities.join(self.persons.withColumnRenamed("entity", "id"), "id", "left")

    def patch(self, changes: DataFrame, columns: list[str]) -> DataFrame:
        """A new version with changes applied; locked rows stay as they are."""
        free = changes.join(self.entities.where(~F.coalesce("locked", F.lit(False))).select("id"), "id", "left_semi")
        return R.update_from(self.entities, free, ["id"], columns)

    def lock(self, ids: DataFrame, locked: bool = True) -> DataFrame:
        mark = ids.select("id").distinct().withColumn("_m", F.lit(locked))
        return self.entities.join(mark, "id", "left").withColumn("locked", F.coalesce("_m", "locked")).drop("_m").select(*self.entities.columns)

    def match(self, texts: DataFrame, limit: int = 100) -> DataFrame:
        """Entities that each text mentions, most specific first, with whether another of its name could be meant."""
        names = self.entities.where("status = 'active' and confidence >= 0.5").select("id", F.explode(F.array_union(F.array("name"), F.coalesce("names", F.array().cast("array<string>")))).alias("n")).distinct()
        found = matching.match_texts(texts, names, "text", "text_id", "n", "id", limit)
        typed = found.join(self.entities.select("id", "name", "type"), "id")
        return R.ambiguous(typed, ["text_id", "name"], "ambiguous")

    def lookup(self, terms: DataFrame) -> DataFrame:
        """Each term with its status and the one entity found."""
        keyed = terms.withColumn("_k", T.key_unicode(F.col("term"))).join(self.entities.select("id", T.key_unicode(F.col("name")).alias("_k")), "_k", "left")
        return keyed.groupBy("term").agg(F.count("id").alias("exact"), F.min("id").alias("id")).select("term", matching.lookup_status(F.col("exact")).alias("status"), F.when(F.col("exact") == 1, F.col("id")).alias("id"))

    def prepare(self, terms: DataFrame, ready: DataFrame, dead: DataFrame) -> DataFrame:
        """Each term's status in one join of all terms."""
        return matching.prepare_status(terms, matching.pick_exact(terms, self.entities), ready, dead)

    def find(self, term: str, others: dict[str, DataFrame]) -> DataFrame:
        """Hits of a term in several layers, each tagged. others: name to (id, name)."""
        key = T.key_unicode(F.lit(term))
        layers = {"entity": self.entities} | others
        return reduce(DataFrame.unionByName, [df.where(T.key_unicode(F.col("name")) == key).select("id", "name", F.lit(layer).alias("layer")) for layer, df in layers.items()])

    def catalogue_page(self, scope: Column, limit: int) -> tuple[DataFrame, DataFrame]:
        """(counts, page) of one snapshot."""
        rows = self.entities.where(scope)
        return rows.groupBy("type", "status").agg(F.count("*").alias("n")), rows.orderBy(F.desc("updated_at"), "id").limit(limit)

    def scope(self, kind: str | None = None, status: str | None = None, since: str | None = None, assigned: DataFrame | None = None, unassigned: bool = False) -> DataFrame:
        """Entities of a scope built from optional parts; domains by semi or anti join."""
        rows = self.entities.where(matching.entity_filter(None, kind, status, since=since))
        return rows if assigned is None else rows.join(assigned.select("id"), "id", "left_anti" if unassigned else "left_semi")

    def work(self, requested: DataFrame, limit: int) -> DataFrame:
        """What to check next."""
        asked = requested.select("id").distinct().withColumn("requested", F.lit(True))
        rows = self.entities.join(asked, "id", "left").select("id", F.coalesce("requested", F.lit(False)).alias("requested"), F.col("canonical_en").isNull().alias("unfilled"), F.col("updated_at").alias("updated"))
        return quality.work_order(rows, limit)

    def work_result(self, results: DataFrame) -> DataFrame:
        """Reported spellings that fit their locale. results: id, locale, value."""
        return results.where(T.valid_for_locale(F.col("value"), F.col("locale")))

    def enqueue(self, terms: DataFrame) -> DataFrame:
        """Requested terms with the gate's verdict. terms: term, type, context, url, trusted."""
        no = F.lit(False)
        known = self.entities.select(F.col("name").alias("term")).distinct().withColumn("existing", F.lit(True))
        rows = terms.join(known, "term", "left")
        verdict = gate.decide_intake(F.col("term"), F.col("type"), F.col("context"), F.col("url"), F.col("trusted"), F.col("existing"), no, no, no)
        return rows.withColumn("gate", verdict).select("term", "type", "gate.verdict", "gate.reason")
