"""Evidence-weighted consensus over an event log, and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions.rank import can_replace
from lexora.functions.text import valid_for_locale
from lexora.operators.relational import top_per_key


@dataclass(frozen=True)
class ConsensusRule:
    """Thresholds and windows of the consensus."""

    parents: int = 2
    pages: int = 2
    weight: float = 1.5
    days: int = 90
    least: float = 0.7
    default_trust: float = 1.0
    cooldown_hours: int = 48
    change_minutes: int = 35


def weigh(observations: DataFrame, as_of: Column, rule: ConsensusRule = ConsensusRule()) -> DataFrame:
    """(entity, locale, norm, parents, pages, weight, spelling) of the confident observations in the window.

    Observations need entity, locale, spelling, norm, parent, domain, page, trust, confidence and
    observed_at; one without a confidence is not confident. A page reported under several media counts once
    towards pages, and media of one parent count once towards parents, so one article copied around
    reaches no consensus. A medium without a parent stands for itself, an observation without a page for
    its domain's. The spelling is the one most often written in the window.
    """
    text = lambda c: F.col(c).cast("string")
    fresh = observations.where((F.col("observed_at") > as_of - F.expr(f"interval {rule.days} days")) & (F.col("confidence") >= rule.least))
    fresh = fresh.select(
        "entity", "locale", "norm", "spelling", F.coalesce(text("parent"), text("domain")).alias("parent"), F.coalesce(F.nullif(text("page"), F.lit("")), F.concat(F.lit("domain:"), text("domain"))).alias("page"),
        (F.coalesce("trust", F.lit(rule.default_trust)) * F.col("confidence")).cast("decimal(18,6)").alias("weight"),
    )
    return fresh.groupBy("entity", "locale", "norm").agg(
        F.count_distinct("parent").alias("parents"), F.count_distinct("page").alias("pages"), F.sum("weight").cast("double").alias("weight"), F.mode("spelling", True).alias("spelling")
    )


def consensus(observations: DataFrame, as_of: Column, rule: ConsensusRule = ConsensusRule(), stored: DataFrame | None = None) -> DataFrame:
    """The winning spelling of each (entity, locale) that passes all thresholds, as most often written.

    A winner whose scripts do not fit its locale is no consensus, and no other takes its place. With
    ``stored`` (entity, locale, value, source, locked), neither is one that may not replace what is stored.
    """
    weighed = weigh(observations, as_of, rule).where((F.col("parents") >= rule.parents) & (F.col("pages") >= rule.pages) & (F.col("weight") >= rule.weight))
    winners = top_per_key(weighed, ["entity", "locale"], [F.desc("weight"), F.desc("parents"), F.asc("norm")])
    winners = winners.where(valid_for_locale(F.col("spelling"), F.col("locale")))
    if stored is None:
        return winners
    held = stored.select("entity", "locale", "value", "source", "locked")
    free = F.col("value").isNull() | can_replace(F.col("locked"), F.col("source"), F.lit("media-consensus"))
    return winners.join(held, ["entity", "locale"], "left").where(free).select(*winners.columns)


def changed_pairs(observations: DataFrame, as_of: Column, rule: ConsensusRule = ConsensusRule()) -> DataFrame:
    """(entity, locale) with an observation within the change window: what a sweep evaluates again."""
    return observations.where(F.col("observed_at") >= as_of - F.expr(f"interval {rule.change_minutes} minutes")).select("entity", "locale").distinct()


def sweep(observations: DataFrame, promoted: DataFrame, as_of: Column, rule: ConsensusRule = ConsensusRule()) -> DataFrame:
    """Consensus for changed pairs only, less those promoted within the cooldown.

    promoted: (entity, locale, promoted_at).
    """
    due = changed_pairs(observations, as_of, rule)
    resting = promoted.where(F.col("promoted_at") > as_of - F.expr(f"interval {rule.cooldown_hours} hours")).select("entity", "locale")
    todo = due.join(resting, ["entity", "locale"], "left_anti")
    return consensus(observations.join(todo, ["entity", "locale"], "left_semi"), as_of, rule)


def promotable(candidates: DataFrame, anchors: DataFrame, media: int = 2) -> DataFrame:
    """Candidates with enough distinct media domains and an official anchor.

    candidates: entity and domains; anchors: entity.
    """
    return candidates.where(F.size(F.array_distinct("domains")) >= media).join(anchors.select("entity").distinct(), "entity", "left_semi")


def observe(known: DataFrame, seen: DataFrame) -> DataFrame:
    """What an observed name does: unknown names are skipped, one owner gains the spelling, several are ambiguous.

    known: name, entity; seen: name, spelling.
    """
    owners = known.select("name", "entity").distinct().groupBy("name").agg(F.count("*").alias("owners"), F.min("entity").alias("owner"))
    action = F.when(F.col("owners").isNull(), "skip").when(F.col("owners") == 1, "append").otherwise("ambiguous")
    return seen.join(owners, "name", "left").select("name", "spelling", action.alias("action"), F.when(F.col("owners") == 1, F.col("owner")).alias("entity"))


def screen(observations: DataFrame, as_of: Column, days: int = 30, media: int = 2, most: int = 100) -> DataFrame:
    """Spellings that enough domains used lately: a top list."""
    fresh = observations.where(F.col("observed_at") >= as_of - F.expr(f"interval {days} days"))
    counted = fresh.groupBy("entity", "locale", "norm").agg(F.count_distinct("domain").alias("domains"), F.count("*").alias("uses"))
    return counted.where(F.col("domains") >= media).orderBy(F.desc("domains"), F.desc("uses"), "entity", "locale", "norm").limit(most)


def vote(extractions: DataFrame, texts: DataFrame, least: int = 2, rounds: int = 3) -> DataFrame:
    """The best form of independent extractions: accepted with enough votes, strong if unanimous and in the text.

    extractions: id, form, one row a vote; texts: id, text.
    """
    counted = extractions.groupBy("id", "form").agg(F.count("*").alias("votes"))
    best = top_per_key(counted, ["id"], [F.desc("votes"), F.asc("form")])
    grounded = F.contains(F.lower("text"), F.lower("form"))
    return best.join(texts, "id", "left").select("id", "form", "votes", (F.col("votes") >= least).alias("accepted"), F.coalesce((F.col("votes") >= rounds) & grounded, F.lit(False)).alias("strong"))
