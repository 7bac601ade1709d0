"""What a run of the enricher would do: which symbols, in which order, and how many model calls each gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import enrichment_candidates
from .merge import failures
from .ranks import ranked_by, spread

PREDICATES = 4


def plan(symbols: DataFrame, claims: DataFrame, hashes: DataFrame, attempts: DataFrame, version: str, cap: int | None = None, budget: int | None = None, force: bool = False, predicates: int = PREDICATES) -> DataFrame:
    """(id, fan_in, place, state, n_calls) of the symbols worth enriching, most imported packages first, ties in the order of their ids' md5.

    ``cap`` symbols at most are looked at. One is ``cached`` if a semantic claim about it was made by this version from its file's present content:
    claims (subject_id, claim_tier, extractor_version) against hashes (subject_id, content_hash) as ``version@hash``. One whose attempts
    (subject_id, ord, ok) have failed for good is ``given_up`` and takes no place. The others get ``predicates`` calls each until the budget of
    calls ends, the last one perhaps fewer; beyond, they are ``over_budget``. Places are counted by chunks, so no task ranks all symbols.
    """
    worth = enrichment_candidates(symbols, claims).select("id", "fan_in")
    lost = failures(attempts).filter("state = 'enrichment_permanently_failed'").select(F.col("subject_id").alias("id"))
    ranked = ranked_by(worth.join(lost, "id", "left_anti"), "fan_in", spread(F.col("id")), "place")
    if cap is not None:
        ranked = ranked.filter(F.col("place") <= cap)
    made = claims.filter("claim_tier = 'semantic'").select(F.col("subject_id").alias("id"), "extractor_version").distinct()
    now = hashes.select(F.col("subject_id").alias("id"), F.concat(F.lit(f"{version}@"), "content_hash").alias("extractor_version"))
    hit = made.join(now, ["id", "extractor_version"], "left_semi").select("id", F.lit(True).alias("hit")).distinct()
    known = ranked.join(hit, "id", "left").withColumn("cached", F.lit(False) if force else F.coalesce("hit", F.lit(False))).drop("hit")
    todo = ranked_by(known.filter("not cached").select("id", "fan_in"), "fan_in", spread(F.col("id")), "_turn").select("id", "_turn")
    before = (F.col("_turn") - 1) * predicates
    calls = F.lit(predicates) if budget is None else F.least(F.lit(predicates), F.greatest(F.lit(0), F.lit(budget) - before))
    placed = known.join(todo, "id", "left").withColumn("n_calls", F.when(F.col("cached"), 0).otherwise(calls).cast("long"))
    state = F.when(F.col("cached"), "cached").when(F.col("n_calls") > 0, "enrich").otherwise("over_budget")
    given_up = worth.join(lost, "id", "left_semi").select("id", "fan_in", F.lit(None).cast("long").alias("place"), F.lit("given_up").alias("state"), F.lit(0).cast("long").alias("n_calls"))
    return placed.select("id", "fan_in", "place", state.alias("state"), "n_calls").unionByName(given_up)


def summary(planned: DataFrame) -> DataFrame:
    """Symbols and calls by state: what a dry run reports."""
    return planned.groupBy("state").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n_calls").alias("n_calls"))
