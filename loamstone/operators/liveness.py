"""Whether sources of evidence are still there: probes with a time to live, a budget, and a benefit of the doubt.

What a probe found lies in a table of a ``Store``, in buckets of the source, and holds for ``TTL``. A run probes the sources it
asks about that have no such row, as many as its budget allows; the others count as live, so that a lack of budget makes no fact
stale. A probe that fails tells nothing and is not kept.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamstone.sources.store import BUCKETS, Store
from loamstone.sources.tables import Conflict

from .merge import drift_status
from .ranks import running_total, spread

TTL = dt.timedelta(hours=24)
_FOUND = "source_ref string, live boolean, content_hash string, checked_at timestamp"
_PROBES = _FOUND + ", run string, error string"
#: (what a source holds now, whether it is there); it may raise.
Probe = Callable[[str], tuple[bytes, bool]]


def _probe(probe: Probe, at: dt.datetime, run_id: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ref in frame["source_ref"]:
                try:
                    body, there = probe(ref)
                    rows.append((ref, there, hashlib.sha256(body).hexdigest() if there else "", at, run_id, None))
                except Exception as error:  # noqa: BLE001 - whatever the caller's probe raises is no answer
                    rows.append((ref, None, None, at, run_id, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["source_ref", "live", "content_hash", "checked_at", "run", "error"])

    return run


def check(store: Store, refs: DataFrame, probe: Probe, now: dt.datetime, budget: int | None = None, ttl: dt.timedelta = TTL, buckets: int = BUCKETS) -> DataFrame:
    """(source_ref, live, content_hash, how) of each asked source; ``how`` is cached, probed, unchecked (live by default) or failed (nothing known).

    Which sources a budget covers is decided by the md5 of the source, over all that are asked."""
    change = store.begin()
    if not change.has("liveness"):
        change.declare("liveness", _FOUND, ["source_ref"], buckets)
        change.declare("probes", _PROBES, ["source_ref"], buckets)
    asked = refs.select("source_ref").filter("source_ref <> ''").distinct()
    touched = change.touched("liveness", asked)
    known = change.read("liveness", touched).filter(F.col("checked_at") > F.lit(now - ttl)).join(asked, "source_ref", "left_semi").select("source_ref", "live", "content_hash")
    misses = asked.join(known, "source_ref", "left_anti").withColumn("_one", F.lit(1))
    placed = running_total(misses, "_one", spread(F.col("source_ref")), "_turn")
    covered = F.lit(True) if budget is None else F.col("_turn") <= budget
    # each probe is made once: what it found is written, and all that follows reads it
    change.append("probes", placed.filter(covered).select("source_ref").mapInPandas(_probe(probe, now, change.id), _PROBES))
    told = change.read("probes", touched).filter(F.col("run") == change.id)
    found = told.filter("live is not null").select("source_ref", "live", "content_hash", "checked_at")
    change.rewrite("liveness", asked, lambda rows: rows.filter(F.col("checked_at") > F.lit(now - ttl)).join(found, "source_ref", "left_anti").unionByName(found))
    try:
        change.commit()
    except Conflict:  # another run has kept its findings; these are as good, and are asked for again when needed
        pass
    left = placed.filter(~covered).select("source_ref", F.lit(True).alias("live"), F.lit("").alias("content_hash"), F.lit("unchecked").alias("how"))
    probed = told.select("source_ref", "live", "content_hash", F.when(F.col("live").isNull(), "failed").otherwise("probed").alias("how"))
    return known.withColumn("how", F.lit("cached")).unionByName(probed).unionByName(left)


def check_stream(refs: DataFrame, store: Store, checkpoint: str, probe: Probe, clock: Callable[[], dt.datetime], sink: Callable[[DataFrame, int], None], **settings) -> StreamingQuery:
    """Run ``check`` on every micro-batch of (source_ref) until the input is used up; the budget is that of a micro-batch. What was probed outlives the job."""

    def step(batch: DataFrame, number: int) -> None:
        sink(check(store, batch, probe, clock(), **settings), number)

    return refs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_drift_status(facts: DataFrame, evidence: DataFrame, symbols: DataFrame, checked: DataFrame) -> DataFrame:
    """``drift_status``, where an active fact is stale too if the comment behind it is gone or reads otherwise than when the fact was made."""
    asked = evidence.filter("source_type = 'pr_comment' and source_ref <> ''").select("fact_id", "source_ref").distinct()
    hashes = facts.select(F.col("id").alias("fact_id"), "staleness_hash")
    met = asked.join(checked.filter("live is not null"), "source_ref").join(hashes, "fact_id")
    off = ~F.col("live") | ((F.col("content_hash") != "") & (F.col("content_hash") != F.col("staleness_hash")))
    gone = met.groupBy(F.col("fact_id").alias("id")).agg(F.bool_or(off).alias("off"))
    held = drift_status(facts, evidence, symbols).join(gone, "id", "left")
    return held.select("id", "status", F.when((F.col("new_status") == "active") & F.coalesce("off", F.lit(False)), "stale").otherwise(F.col("new_status")).alias("new_status"))
