"""Table maintenance: functions from (existing, incoming) to the new table. Publishing is left to ``sources.tables``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import text as T

SEMANTIC_FLOOR = 0.7
FAILURES_TO_GIVE_UP = 3
#: Tokens of recent bodies that may be sent to every task (about 150 bytes each).
BROADCAST_TOKENS = 300_000


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Incoming rows win over existing ones of the same key; of several incoming ones the last by ``order``, then by all columns, wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in {*key, "_new", *(order or [])}]
    packed = both.groupBy(*key).agg(F.max(F.struct("_new", *(order or []), *rest)).alias("_r"))
    return packed.select(*[c if c in key else F.col(f"_r.{c}").alias(c) for c in both.columns if c != "_new"])


def replace_claims(existing: DataFrame, incoming: DataFrame, family: str = "extractor", file: str = "source_file") -> DataFrame:
    """Claims of an extractor and file that comes again are replaced as a whole; others stay."""
    again = incoming.select(family, file).distinct()
    return existing.join(again, [family, file], "left_anti").unionByName(incoming)


def guarded_replace(existing: DataFrame, incoming: DataFrame, family: str = "extractor", file: str = "source_file") -> DataFrame:
    """As ``replace_claims``; an incoming table without any claim is taken for a failed extraction and changes nothing."""
    return replace_claims(existing, incoming, family, file) if incoming.limit(1).count() else existing


def empty_extractions(existing: DataFrame, incoming: DataFrame, extracted: DataFrame, family: str = "extractor", file: str = "source_file") -> DataFrame:
    """Extractions (extractor, file) that were run and gave no claim although the file has some: each is taken for a failure of its own, and
    ``replace_claims`` leaves the file's claims as they are."""
    key = [family, file]
    return extracted.select(*key).distinct().join(incoming.select(*key).distinct(), key, "left_anti").join(existing.select(*key).distinct(), key, "left_semi")


def inserted_claims(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing and incoming claims; an object of 0 means none."""
    return existing.unionByName(incoming.withColumn("object_id", F.nullif("object_id", F.lit(0))), allowMissingColumns=True)


def absent(source_files: DataFrame, named: DataFrame) -> DataFrame:
    """Files (repo, relative_path) that are named and not there."""
    return named.select("repo", "relative_path").distinct().join(source_files, ["repo", "relative_path"], "left_anti")


def tombstone(source_files: DataFrame, gone: DataFrame, strict: bool = False) -> DataFrame:
    """Mark files (repo, relative_path) as deleted; rows stay. ``strict`` raises where one of them is not there."""
    if strict and (first := absent(source_files, gone).first()):
        raise ValueError(f"no such file: {first['repo']} {first['relative_path']}")
    marked = gone.select("repo", "relative_path").distinct().withColumn("_gone", F.lit(True))
    return source_files.join(marked, ["repo", "relative_path"], "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def delete_semantic(claims: DataFrame, symbols: DataFrame, extractor: str, import_path: str) -> DataFrame:
    """Without the semantic claims of an extractor about a package."""
    about = symbols.filter(F.col("import_path") == import_path).select(F.col("id").alias("subject_id"))
    doomed = claims.filter((F.col("claim_tier") == "semantic") & (F.col("extractor") == extractor)).join(about, "subject_id", "left_semi").select("claim_key")
    return claims.join(doomed, "claim_key", "left_anti")


def delete_uncertain(claims: DataFrame, floor: float = SEMANTIC_FLOOR) -> DataFrame:
    """Without semantic claims below a confidence."""
    return claims.filter(~((F.col("claim_tier") == "semantic") & (F.col("confidence") < floor)))


def delete_sensitive(claims: DataFrame, column: str = "object_text") -> DataFrame:
    """Without claims of any tier whose text is sensitive; claims without text stay."""
    return claims.filter(~T.sensitive(F.col(column)))


def reconcile(source_files: DataFrame, current: DataFrame) -> DataFrame:
    """What to do with each path: tombstone what is gone, extract what is new or changed."""
    old = source_files.filter(~F.col("deleted")).select("repo", "relative_path", F.col("content_hash").alias("old_hash"))
    new = current.select("repo", "relative_path", F.col("content_hash").alias("new_hash"))
    both = old.join(new, ["repo", "relative_path"], "full_outer")
    action = F.when(F.col("new_hash").isNull(), "tombstone").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.withColumn("action", action).filter("action is not null").select("repo", "relative_path", "action")


def merge_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per cluster: subject, kind and the hash of the scrubbed body, from calls (``ord``) with their evidence (fact_id, source_ref).

    The earliest call gives the words. A later one corroborates, once, and moves ``last_verified``, if it brings a source that no earlier
    call of the cluster had.
    """
    key = ["subject_id", "kind", "cluster_key"]
    keyed = facts.withColumn("cluster_key", T.scrub_hash(F.col("body"))).select(*key, "id", "ord", "confidence", "model", "corroboration", "last_verified")
    refs = keyed.join(evidence.select(F.col("fact_id").alias("id"), "source_ref").distinct(), "id")
    # of each source the call that brings it first
    brought = refs.groupBy(*key, "source_ref").agg(F.min(F.struct("ord", "id", "last_verified")).alias("c")).select(*key, "c.*").distinct()
    first = F.min(F.struct("ord", "id", "confidence", "model", "corroboration", "last_verified"))
    clusters = keyed.groupBy(*key).agg(first.alias("f"), F.count(F.lit(1)).alias("n_rows"))
    later = brought.join(clusters.select(*key, F.col("f.ord").alias("first_ord"), F.col("f.id").alias("first_id")), key).filter("ord <> first_ord or id <> first_id")
    more = later.groupBy(*key).agg(F.count(F.lit(1)).alias("more"), F.max(F.struct("ord", "id", "last_verified")).alias("l"))
    out = clusters.join(more, key, "left")
    return out.select(*key, "f.id", "f.confidence", "f.model", (F.col("f.corroboration") + F.coalesce("more", F.lit(0))).cast("long").alias("corroboration"), F.coalesce("l.last_verified", "f.last_verified").alias("last_verified"), "n_rows")


def without_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts that no evidence supports, which must not be inserted."""
    return facts.join(evidence.select(F.col("fact_id").alias("id")).distinct(), "id", "left_anti")


def merge_evidence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Evidence of a reference that a fact does not have yet, the first of each."""
    fresh = incoming.join(existing.select("fact_id", "source_ref").distinct(), ["fact_id", "source_ref"], "left_anti")
    rest = [c for c in fresh.columns if c not in ("fact_id", "source_ref", "ord")]
    one = fresh.groupBy("fact_id", "source_ref").agg(F.min(F.struct("ord", *rest)).alias("e")).select("fact_id", "source_ref", "e.*")
    return existing.unionByName(one)


def cursor(seen: Column, observed: Column) -> tuple[Column, Column, Column]:
    """(all numbers seen, the new ones, whether the source went back) of two arrays of numbers."""
    known = F.array_sort(F.array_distinct(F.filter(F.array_union(seen, observed), lambda x: x >= 0)))
    back = F.coalesce(F.array_max(observed) < F.array_max(seen), F.lit(False))
    return known, F.array_sort(F.array_except(observed, seen)), back


def encoded_ids(ids: Column) -> Column:
    """Different numbers from 0 on, sorted, as 32-bit little-endian bytes."""
    kept = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x >= 0)))
    digits = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.array_join(F.transform(kept, lambda x: F.concat(*[F.substring(digits(x), k, 2) for k in (7, 5, 3, 1)])), ""))


def decoded_ids(blob: Column) -> Column:
    """The numbers of ``encoded_ids``; null where the bytes are not whole numbers."""
    words = F.regexp_extract_all(F.hex(blob), F.lit("[0-9A-F]{8}"), F.lit(0))
    number = lambda w: F.conv(F.concat(*[F.substring(w, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(F.octet_length(blob) % 4 == 0, F.transform(words, number))


CORRECTIONS, FEEDBACK = ("correct", "delete", "supersede"), ("wrong", "stale", "misleading", "offensive")


def correction_error(fact_id: Column, action: Column, new_body: Column) -> Column:
    """What keeps a correction from being stored, or null."""
    return (
        F.when(fact_id.isNull(), "fact_id is required").when(~F.coalesce(action.isin(*CORRECTIONS), F.lit(False)), "unknown action")
        .when((action != "delete") & (F.coalesce(F.trim(new_body), F.lit("")) == ""), "new_body is required")
    )


def feedback_error(fact_id: Column, reason: Column) -> Column:
    return F.when(fact_id.isNull(), "fact_id is required").when(~F.coalesce(reason.isin(*FEEDBACK), F.lit(False)), "unknown reason")


def deleted_documents(documents: DataFrame, revisions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and revisions after some documents (document_id) are deleted, their revisions with them."""
    ids = gone.select("document_id").distinct()
    return documents.join(ids, "document_id", "left_anti"), revisions.join(ids, "document_id", "left_anti")


def drift_status(facts: DataFrame, evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """Status after a drift pass: without its subject a fact is quarantined, with changed evidence stale; retired facts keep theirs."""
    changed = evidence.join(facts.select(F.col("id").alias("fact_id"), "staleness_hash"), "fact_id").groupBy("fact_id").agg(F.bool_or(F.col("content_hash") != F.col("staleness_hash")).alias("changed"))
    known = symbols.select(F.col("id").alias("subject_id"), F.lit(True).alias("known"))
    joined = facts.join(known, "subject_id", "left").join(changed, facts["id"] == changed["fact_id"], "left")
    status = F.when(F.col("status").isin("superseded", "deleted"), F.col("status")).when(F.col("known").isNull(), "quarantined").when((F.col("status") == "active") & F.coalesce("changed", F.lit(False)), "stale").otherwise(F.col("status"))
    return joined.select("id", "status", status.alias("new_status"))


def without_fact(facts: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``named`` (id, ...) whose fact is not there."""
    return named.join(facts.select("id"), "id", "left_anti")


def apply_verdicts(facts: DataFrame, verdicts: DataFrame, now: Column, strict: bool = False) -> DataFrame:
    """accept: verified now; downgrade: confidence times 0.6; reject: stale. Facts without verdict stay. ``strict`` raises where a verdict's fact is not there."""
    if strict and (first := without_fact(facts, verdicts).first()):
        raise LookupError(f"no such fact: {first['id']}")
    joined = facts.join(verdicts, "id", "left")
    return joined.select(
        "id",
        F.when(F.col("verdict") == "reject", "stale").otherwise(F.col("status")).alias("status"),
        F.round(F.when(F.col("verdict") == "downgrade", F.col("confidence") * 0.6).otherwise(F.col("confidence")), 9).alias("confidence"),
        F.when(F.col("verdict") == "accept", now).otherwise(F.col("last_verified")).alias("last_verified"),
    )


def gate_claims(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Semantic claims after verification by (subject_id, predicate): no verdict accepts, an unknown one rejects."""
    joined = claims.join(verdicts, ["subject_id", "predicate"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("accept")))
    kept = joined.filter(F.col("verdict").isin("accept", "downgrade"))
    return kept.withColumn("confidence", F.round(F.when(F.col("verdict") == "downgrade", F.col("confidence") * 0.6).otherwise(F.col("confidence")), 9))


def correct(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts after corrections (fact_id, action): supersede and delete retire a fact, correct leaves it active; both of the first and last
    two add a replacement with the new body."""
    worst = corrections.groupBy("fact_id").agg(F.max(F.when(F.col("action") == "delete", 2).when(F.col("action") == "supersede", 1).otherwise(0)).alias("level"))
    joined = facts.join(worst, facts["id"] == worst["fact_id"], "left")
    return joined.withColumn("status", F.when(F.col("level") == 2, "deleted").when(F.col("level") == 1, "superseded").otherwise(F.col("status"))).drop("fact_id", "level")


def failures(attempts: DataFrame) -> DataFrame:
    """(subject_id, ord, ok) to the state of each subject: consecutive failures since the last success, given up from the third on."""
    last_ok = attempts.groupBy("subject_id").agg(F.max(F.when(F.col("ok"), F.col("ord"))).alias("last_ok"))
    since = attempts.join(last_ok, "subject_id").groupBy("subject_id").agg(F.sum(F.when(~F.col("ok") & (F.coalesce("last_ok", F.lit(-1)) < F.col("ord")), 1).otherwise(0)).alias("failures"))
    return since.withColumn("state", F.when(F.col("failures") == 0, "ok").when(F.col("failures") < FAILURES_TO_GIVE_UP, "enrichment_failed").otherwise("enrichment_permanently_failed"))


def nearest_body(facts: DataFrame, recent: int = 200, shared: int = 1) -> DataFrame:
    """Of each fact the most similar body by token Jaccard among the ``recent`` newest facts of another cluster.

    Facts meet over shared tokens of the ``recent`` bodies only, and their overlap is counted, so no pair without a common token arises: inside
    a task where the recent bodies are few tokens, and beyond that by a shuffle.
    """
    keyed = facts.select("id", T.scrub_hash(F.col("body")).alias("cluster_key"), T.tokens(F.col("body")).alias("tokens"))
    newest = facts.select("id", "body").orderBy(F.desc("id")).limit(recent)
    new = newest.select("id", T.scrub_hash(F.col("body")).alias("cluster_key"), T.tokens(F.col("body")).alias("tokens"))
    if (new.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= BROADCAST_TOKENS:
        sent = facts.sparkSession.sparkContext.broadcast(new.toArrow())
        found = keyed.mapInArrow(_nearest(sent, shared), "id long, nearest long, jaccard double")
        return found.withColumn("jaccard", F.round("jaccard", 9))
    left = keyed.select("id", "cluster_key", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    right = new.select(F.col("id").alias("other"), F.col("cluster_key").alias("other_key"), F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    met = left.join(right, "token").filter("cluster_key <> other_key").groupBy("id", "other", "n", "m").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= shared)
    scored = met.withColumn("jaccard", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 9))
    return scored.groupBy("id").agg(F.max(F.struct("jaccard", F.col("other"))).alias("b")).select("id", F.col("b.other").alias("nearest"), "b.jaccard")


def _nearest(sent, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = sent.value
        ids, keys, sizes = others.column("id").to_numpy(), np.array(others.column("cluster_key").to_pylist()), np.array([len(t or ()) for t in others.column("tokens").to_pylist()])
        holders: dict[str, list[int]] = {}
        for k, tokens in enumerate(others.column("tokens").to_pylist()):
            for t in tokens or ():
                holders.setdefault(t, []).append(k)
        by_token = {t: np.array(k) for t, k in holders.items()}
        for batch in batches:
            rows = []
            for i, key, tokens in zip(*(batch.column(c).to_pylist() for c in range(3))):
                met = [by_token[t] for t in tokens or () if t in by_token]
                both = np.bincount(np.concatenate(met), minlength=len(ids)) if met else np.zeros(len(ids), np.int64)
                near = np.flatnonzero((both >= shared) & (keys != key))
                if len(near):
                    # rounded before the best is chosen, as the shuffled way does
                    jaccard = np.round(both[near] / (len(tokens) + sizes[near] - both[near]), 9)
                    best = np.lexsort((ids[near], jaccard))[-1]
                    rows.append((i, int(ids[near[best]]), float(jaccard[best])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["id", "nearest", "jaccard"])

    return run


def claim_severity(claims: DataFrame, files: DataFrame) -> DataFrame:
    """The first thing wrong with each claim: no file, a line beyond its end, an empty file, or a file newer than the claim."""
    f = files.select(F.col("path").alias("source_file"), "n_lines", "size_bytes", "modified_at", F.lit(True).alias("exists"))
    joined = claims.join(f, "source_file", "left")
    finding = (
        F.when(F.col("exists").isNull(), "HIGH missing file")
        .when((F.col("predicate") == "defines") & (F.col("source_line") > F.col("n_lines")), "MEDIUM line beyond end")
        .when((F.col("predicate") == "has_signature") & (F.col("size_bytes") == 0), "HIGH empty file")
        .when(F.col("modified_at") > F.col("last_verified"), "LOW file newer than claim")
    )
    return joined.select("claim_key", F.coalesce(finding, F.lit("OK")).alias("finding"))


def numbered_revisions(states: DataFrame) -> DataFrame:
    """Number the states (document_id, recorded_at, ord) of each document in order of time."""
    order = Window.partitionBy("document_id").orderBy("recorded_at", "ord")
    return states.withColumn("revision_num", F.row_number().over(order))
