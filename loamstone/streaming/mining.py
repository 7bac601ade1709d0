"""Facts from review comments: one job from a batch of comments to facts, evidence and cursors, committed together.

Steps: the comments of merged changes that a file's cursor has not seen; a budget of model calls over all files; redaction of
personal data; the model's reply; validation of its kind; confidence kept inside (0, 1); a merge into the facts that are
there, by subject, kind and scrubbed body, where every new reference corroborates once; and what went wrong, as a category.

Tables of the store, all in buckets of (repo, path): ``facts``, ``evidence``, ``seen`` (the changes a file's cursor holds),
``cursors`` (its version), ``replies`` (every model call, so that no later step asks the model again) and ``outcomes`` (a row
per batch and file). A batch changes all of them in one commit that names it: killed anywhere before, it leaves nothing
behind, and a batch that comes again changes nothing.

A file fails as a whole (``extraction_failed``) where a reply cannot be read or names an unknown kind, is left for later
(``budget_exceeded``) where its calls go beyond the budget, and is marked to be read anew (``cursor_regression``) where the
newest change is older than one it has seen. Its cursor then stays, or is emptied by the mark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamstone.functions import text as T
from loamstone.operators.generated import unfenced
from loamstone.operators.ranks import running_total, spread
from loamstone.sources.store import BUCKETS, Change, Store
from loamstone.sources.tables import Conflict

#: Kinds that a reply may name (fixed values); 'null' and the empty string say that a comment holds no fact.
KINDS = ("rationale", "invariant", "quirk")
NOTHING = ("null", "")
NEEDS_REMINE = "needs_remine"
VERSION = "1"
#: Characters of a model's reply that are kept when it cannot be read.
REPLY_KEPT = 500
RETRIES = 3

KEY = ["repo", "path"]
FACT = [*KEY, "kind", "cluster_key"]
_KEY = "repo string, path string"
TABLES = {
    "facts": f"{_KEY}, kind string, cluster_key string, body string, source_quote string, confidence double, corroboration long, model string, staleness_hash string, status string, created_at string, last_verified string",
    "evidence": f"{_KEY}, kind string, cluster_key string, source_type string, source_ref string, author string, authored_at string, content_hash string",
    "seen": f"{_KEY}, change long",
    "cursors": f"{_KEY}, miner_version string",
    "replies": f"{_KEY}, stream string, batch long, change long, source_ref string, author string, authored_at string, source_quote string, content_hash string, kind string, body string, confidence double, error string",
    "outcomes": f"{_KEY}, stream string, batch long, outcome string, n_observed long, n_new long, n_facts long, n_failed long, categories array<string>",
}
Complete = Callable[[str, str], str]


def prompt(path: str, body: str, hunk: str) -> str:
    return f"File: {path}\n\nComment:\n{body}\n\nDiff:\n{hunk}\n"


def read_reply(reply: str) -> tuple[str | None, str | None, float | None, str | None]:
    """(kind, body, confidence, error) of a reply; no fact has no kind and no error."""
    try:
        found = json.loads(unfenced(reply))
        kind, body, confidence = str(found.get("kind") or ""), str(found.get("body") or ""), float(found.get("confidence") or 0.0)
    except (ValueError, TypeError, AttributeError):
        return None, None, None, f"parse reply: {reply[:REPLY_KEPT]}"
    if kind in NOTHING:
        return None, None, None, None
    if kind not in KINDS:
        return None, None, None, f"invalid kind: {kind[:REPLY_KEPT]}"
    return kind, body, confidence, None


def stand_in(system: str, user: str) -> str:
    """A model whose reply follows from the length of the comment in the prompt."""
    n = len(user.split("\n\nComment:\n", 1)[1].rsplit("\n\nDiff:\n", 1)[0])
    kind = "praise" if n % 97 == 5 else ("rationale", "invariant", "quirk", "null", "")[n % 5]
    return "```json\n" + json.dumps({"kind": kind, "body": f"note {n % 7}", "confidence": n % 6 / 4}) + "\n```"


def _ask(complete: Complete):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for path, body, hunk in zip(frame["path"], frame["_body"], frame["_hunk"]):
                try:
                    told.append(read_reply(complete("Classify a review comment as JSON.", prompt(path, body, hunk))))
                except Exception as error:  # noqa: BLE001 - whatever the caller's model raises is that call's outcome
                    told.append((None, None, None, f"model: {error}"[:REPLY_KEPT]))
            out = frame.drop(columns=["_body", "_hunk"])
            for k, name in enumerate(("kind", "body", "confidence", "error")):
                out[name] = pd.Series([t[k] for t in told], index=out.index, dtype="object" if name != "confidence" else "float64")
            yield out

    return run


def _start(store: Store, buckets: int) -> None:
    change = store.begin()
    if change.has("facts"):
        return
    for name, ddl in TABLES.items():
        change.declare(name, ddl, KEY, buckets)
    try:
        change.commit()
    except Conflict:  # another writer has started the store
        pass


def mine(store: Store, comments: DataFrame, stream: str, batch: int, complete: Complete, now: str, budget: int | None = None, model: str = "", buckets: int = BUCKETS) -> bool:
    """Take a batch of comments (repo, path, change, body, hunk, url, author, created_at) in; false if it was taken in before."""
    _start(store, buckets)
    for left in reversed(range(RETRIES)):
        change = store.begin()
        if change.done(stream, batch):
            return False
        try:
            _mine(change, comments, stream, batch, complete, now, budget, model)
            change.commit(stream, batch)
            return True
        except Conflict:
            if not left:
                raise
    return False


def plan(comments: DataFrame, seen: DataFrame, cursors: DataFrame, budget: int | None) -> tuple[DataFrame, DataFrame]:
    """(new comments, files): which comments to ask about, and per file whether its cursor went back or the budget ends before it."""
    live = seen.join(cursors.filter(F.col("miner_version") == NEEDS_REMINE), KEY, "left_anti")
    highest = live.groupBy(*KEY).agg(F.max("change").alias("highest"))
    new = comments.join(live, [*KEY, "change"], "left_anti")
    files = comments.groupBy(*KEY).agg(F.max("change").alias("newest"), F.countDistinct("change").alias("n_observed"))
    files = files.join(new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_new")), KEY, "left").join(highest, KEY, "left")
    files = files.select(*KEY, "n_observed", F.coalesce(F.col("newest") < F.col("highest"), F.lit(False)).alias("back"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    asked = files.withColumn("_calls", F.when(F.col("back"), 0).otherwise(F.col("n_new")))
    total = running_total(asked, "_calls", spread(F.col("repo"), F.col("path")), "_total")
    beyond = F.lit(False) if budget is None else (F.col("_total") > budget) & (F.col("_calls") > 0)
    files = total.select(*KEY, "n_observed", "n_new", "back", (beyond & ~F.col("back")).alias("beyond"))
    return new.join(files.filter("not back and not beyond"), KEY, "left_semi"), files


def _mine(change: Change, comments: DataFrame, stream: str, batch: int, complete: Complete, now: str, budget: int | None, model: str) -> None:
    named = comments.select(*KEY, "change", "body", "hunk", "url", "author", F.col("created_at").cast("string").alias("authored_at"))
    keys = named.select(*KEY).distinct().persist()
    buckets = change.touched("seen", keys)
    asked, files = plan(named, change.read("seen", buckets), change.read("cursors", buckets), budget)
    files = files.persist()

    # each call is made once: the replies are written, and all that follows reads them
    body, hunk = F.coalesce("body", F.lit("")), F.coalesce("hunk", F.lit(""))
    ready = asked.select(
        *KEY, F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"), "change", F.col("url").alias("source_ref"), "author", "authored_at", body.alias("source_quote"),
        F.sha2(F.concat(body, hunk), 256).alias("content_hash"), T.redact_pii(body).alias("_body"), T.redact_pii(hunk).alias("_hunk"),
    )
    change.append("replies", ready.mapInPandas(_ask(complete), TABLES["replies"]))
    replies = change.read("replies", buckets).filter((F.col("stream") == stream) & (F.col("batch") == batch))

    broken = replies.filter("error is not null").select(*KEY, F.lit(True).alias("broken")).distinct()
    good = replies.filter("kind is not null").join(broken, KEY, "left_anti")
    refused = F.when(F.trim("body") == "", "check constraint failed: fact body is empty").when(F.coalesce(F.trim("source_ref"), F.lit("")) == "", "not null constraint failed: evidence has no source_ref")
    checked = good.withColumn("refused", refused).withColumn("cluster_key", T.scrub_hash(F.col("body")))
    _merge(change, checked.filter("refused is null"), keys, now, model)

    done = checked.groupBy(*KEY).agg(F.count_if(F.expr("refused is null")).alias("n_facts"), F.count_if(F.expr("refused is not null")).alias("n_failed"), F.array_sort(F.collect_set(F.when(F.col("refused").isNotNull(), T.error_category(F.col("refused"))))).alias("categories"))
    said = F.when(F.col("back"), "cursor_regression").when(F.col("beyond"), "budget_exceeded").when(F.col("broken"), "extraction_failed").otherwise("mined")
    told = files.join(broken, KEY, "left").join(done, KEY, "left").withColumn("outcome", said)
    outcomes = told.select(*KEY, F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"), "outcome", "n_observed", "n_new", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
    change.append("outcomes", outcomes)
    _move_cursors(change, named, told.select(*KEY, "outcome"), keys)
    for df in (keys, files):
        df.unpersist()


def _merge(change: Change, facts: DataFrame, keys: DataFrame, now: str, model: str) -> None:
    """Add what the facts bring: a row for a new cluster, or one corroboration for each reference that a known one lacks."""
    buckets = change.touched("facts", keys)
    known = change.read("evidence", buckets)
    brought = facts.groupBy(*FACT, "source_ref").agg(F.min(F.struct("authored_at", "body", "source_quote", "confidence", "content_hash", "author")).alias("r"))
    fresh = brought.join(known.select(*FACT, "source_ref"), [*FACT, "source_ref"], "left_anti")
    first = F.min(F.struct("r.authored_at", "source_ref", "r.body", "r.source_quote", "r.confidence", "r.content_hash")).alias("f")
    clusters = fresh.groupBy(*FACT).agg(first, F.count(F.lit(1)).alias("n_refs"))

    def merged(rows: DataFrame) -> DataFrame:
        both = rows.withColumn("there", F.lit(True)).join(clusters, FACT, "full_outer")
        is_old, more = F.col("there").isNotNull(), F.col("n_refs").isNotNull()
        kept = lambda name, new: F.when(is_old, F.col(name)).otherwise(new).alias(name)
        return both.select(
            *FACT, kept("body", F.col("f.body")), kept("source_quote", F.col("f.source_quote")), kept("confidence", T.clamp_confidence(F.col("f.confidence"))),
            (F.coalesce("corroboration", F.lit(0)) + F.coalesce("n_refs", F.lit(0))).cast("long").alias("corroboration"), kept("model", F.lit(model)), kept("staleness_hash", F.col("f.content_hash")),
            kept("status", F.lit("active")), kept("created_at", F.lit(now)), F.when(is_old & ~more, F.col("last_verified")).otherwise(F.lit(now)).alias("last_verified"),
        )

    change.rewrite("facts", keys, merged)
    change.append("evidence", fresh.select(*FACT, F.lit("pr_comment").alias("source_type"), "source_ref", "r.author", "r.authored_at", "r.content_hash"))


def _move_cursors(change: Change, comments: DataFrame, outcomes: DataFrame, keys: DataFrame) -> None:
    """A mined file's cursor holds all its changes; one that went back is marked, and is empty at its next turn."""
    mined, back = (outcomes.filter(F.col("outcome") == o).select(*KEY) for o in ("mined", "cursor_regression"))
    marked = change.read("cursors", change.touched("cursors", keys)).filter(F.col("miner_version") == NEEDS_REMINE).select(*KEY)
    observed = comments.select(*KEY, "change").distinct().join(mined, KEY, "left_semi")
    # what a marked file had seen before counts no more once it is mined anew
    stale = marked.join(mined, KEY, "left_semi")
    change.rewrite("seen", keys, lambda rows: rows.join(stale, KEY, "left_anti").unionByName(observed).distinct())
    moved = mined.withColumn("miner_version", F.lit(VERSION)).unionByName(back.withColumn("miner_version", F.lit(NEEDS_REMINE)))
    change.rewrite("cursors", keys, lambda rows: rows.join(moved, KEY, "left_anti").unionByName(moved))


def attempts_per_day(outcomes: DataFrame, day: Column) -> DataFrame:
    """Attempts of each day by outcome: all of them, those that mined, and those that a limit or a fault ended."""
    return outcomes.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col("outcome") == "mined").alias("n_mined"), F.count_if(F.col("outcome") == "budget_exceeded").alias("n_over_budget"),
        F.count_if(F.col("outcome").isin("extraction_failed", "cursor_regression")).alias("n_failed"), F.sum("n_facts").alias("n_facts"),
    )


def mine_stream(comments: DataFrame, store: Store, checkpoint: str, complete: Complete, now: Callable[[], str], name: str = "comments", **settings) -> StreamingQuery:
    """Run ``mine`` on every micro-batch until the input is used up."""

    def step(batch: DataFrame, number: int) -> None:
        mine(store, batch, name, number, complete, now(), **settings)

    return comments.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
