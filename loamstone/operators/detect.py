"""Freshness, verification and cost checks, and look-ups between documents and code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.sources import lines

# Fixed values.
CALLS_PER_SYMBOL, CALL_COST_USD = 4, 0.003
SECTION_AGE_DAYS = 7


def package_staleness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, relative_path, action): files whose content changed since indexing are stale, missing ones tombstoned, others fresh."""
    now = current.select("repo", "relative_path", F.col("content_hash").alias("now_hash"))
    joined = stored.filter(~F.col("deleted")).join(now, ["repo", "relative_path"], "left")
    action = F.when(F.col("now_hash").isNull(), "tombstone").when(F.col("now_hash") != F.col("content_hash"), "stale").otherwise("fresh")
    return joined.select("repo", "relative_path", action.alias("action"))


def extraction_requests(requests: DataFrame, meta: DataFrame, running: DataFrame) -> DataFrame:
    """Answer to each request (repo, head): in progress, already fresh, or queued."""
    known = meta.select("repo", "commit_sha")
    busy = running.select("repo", F.lit(True).alias("busy")).distinct()
    joined = requests.join(known, "repo", "left").join(busy, "repo", "left")
    answer = F.when(F.col("busy"), "in_progress").when(F.col("commit_sha") == F.col("head"), "already_fresh").otherwise("queued")
    return joined.select("repo", "head", answer.alias("answer"))


def run_mode(stored_sha: Column, head: Column, is_ancestor: Column) -> Column:
    """What a poll of a repo leads to: nothing, a difference, or a full run where history was rewritten or is unknown."""
    return F.when(stored_sha == head, "none").when(stored_sha.isNull() | ~F.coalesce(is_ancestor, F.lit(False)), "full").otherwise("incremental")


def cache_sizes(files: DataFrame) -> DataFrame:
    """Bytes per repo, of all rows and of live ones."""
    return files.groupBy("repo").agg(F.sum("size_bytes").alias("total_bytes"), F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("size_bytes"))), F.lit(0)).alias("live_bytes"))


def stability_labels(commits: DataFrame, key: str) -> DataFrame:
    """Commits per key with their label."""
    return commits.groupBy(key).agg(F.count(F.lit(1)).alias("n_commits")).withColumn("label", T.stability(F.col("n_commits")))


def newest_rationale(commits: DataFrame) -> DataFrame:
    """The newest commit per file whose message says something."""
    kept = commits.filter(T.nontrivial_commit(F.col("message")))
    return kept.groupBy("file").agg(F.max(F.struct("at", "commit")).alias("c")).select("file", F.col("c.commit").alias("commit"))


def verification_summary(verdicts: DataFrame) -> DataFrame:
    """Verdicts by kind; an unknown one rejects."""
    kind = F.when(F.col("verdict").isin("accept", "downgrade"), F.col("verdict")).otherwise("reject")
    return verdicts.groupBy(kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n_claims"))


def enrichment_cost(symbols: DataFrame, budget: int) -> DataFrame:
    """Calls that enriching each repo's symbols takes, within a budget, and what they cost."""
    per = symbols.groupBy("repo").agg((F.count(F.lit(1)) * CALLS_PER_SYMBOL).alias("calls"))
    within = F.least(F.col("calls"), F.lit(budget))
    return per.select("repo", "calls", within.cast("long").alias("calls_in_budget"), F.round(within * CALL_COST_USD, 6).alias("cost_usd"))


# Fixed values.
NO_DOCUMENTATION = ("changelog.md", "changes.md", "history.md")


def documents_near(changed: DataFrame, deleted: DataFrame, documents: DataFrame) -> DataFrame:
    """Markdown documents (path) in the folders of changed and deleted files, and in the folder above a changed one, but for the root above."""
    own, above = T.folder_of(F.col("path")), T.folder_of(T.folder_of(F.col("path")))
    folders = changed.select(F.explode(F.array(own, F.nullif(above, F.lit("")))).alias("folder")).filter("folder is not null").unionByName(deleted.select(own.alias("folder"))).distinct()
    name = F.lower(T.base_name(F.col("path")))
    kept = documents.filter(name.endswith(".md") & ~name.isin(*NO_DOCUMENTATION)).withColumn("folder", own)
    return kept.join(folders, "folder", "left_semi").select("path")


def documents_of_sources(doc_map: DataFrame, doc: str) -> DataFrame:
    """Repos of a map (repo, source, docs) that refer to a document."""
    return doc_map.filter(F.array_contains("docs", doc)).select("repo").distinct()


def known_replies(replies: DataFrame, symbols: DataFrame) -> DataFrame:
    """Replies about symbols of the package they were asked for; others are dropped."""
    return replies.join(symbols.select("import_path", "symbol_name", F.col("id").alias("subject_id")), ["import_path", "symbol_name"])


def index_cover(symbols: DataFrame, claims: DataFrame) -> DataFrame:
    """Symbols of each package that have at least one claim, in percent."""
    having = symbols.join(claims.select(F.col("subject_id").alias("id")).distinct().withColumn("has", F.lit(1)), "id", "left")
    return having.groupBy("import_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.coalesce(F.sum("has"), F.lit(0)).alias("n_described")).withColumn("percent", F.floor(F.col("n_described") * 100 / F.col("n_symbols")).cast("long"))


def replaced_facts(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replacement facts of corrections (fact_id, action, new_body, ord): new rows for correct and supersede, with the correction as evidence."""
    last = corrections.filter(F.col("action").isin("correct", "supersede")).groupBy("fact_id").agg(F.max(F.struct("ord", "action", "new_body")).alias("c"))
    joined = facts.join(last, facts["id"] == last["fact_id"])
    return joined.select("fact_id", "subject_id", "kind", F.col("c.new_body").alias("body"), F.col("c.action").alias("source_ref"), F.lit("correction").alias("source_type"), F.lit("active").alias("status"))


def without_dangling(rows: DataFrame, facts: DataFrame, columns: tuple[str, ...] = ("fact_id", "nearest_id")) -> DataFrame:
    """Rows with references to facts that no longer exist set to null."""
    for n, c in enumerate(columns):
        known = facts.select(F.col("id").alias(f"_id{n}"))
        rows = rows.join(known, F.col(c) == F.col(f"_id{n}"), "left").withColumn(c, F.col(f"_id{n}")).drop(f"_id{n}")
    return rows


def calibration(existing: DataFrame, pairs: DataFrame, now: Column, days: int = 90, most: int = 50_000) -> DataFrame:
    """Rows of nearest-body pairs with the time from which they no longer count; of all rows the ``most`` newest stay."""
    fresh = pairs.withColumn("written_at", now).withColumn("expires_at", F.date_add(now, days))
    return existing.unionByName(fresh).orderBy(F.desc("written_at"), F.desc("id")).limit(most)


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(F.col("expires_at") >= now)


def _verdict(reply: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a reply as JSON: accurate, stale or unclear; an unreadable reply is unclear."""
    parsed = F.from_json(F.regexp_replace(reply, r"^\s*```(?:json)?\s*|\s*```\s*\z", ""), "verdict string, reason string")
    said = F.lower(parsed["verdict"])
    return F.when(said.isin("accurate", "stale"), said).otherwise("unclear").alias("verdict"), parsed["reason"].alias("reason")


def section_verdicts(sections: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdict per section from replies (section, reply as JSON): accurate, stale or unclear; an unreadable reply is unclear."""
    return sections.join(replies, "section", "left").select("section", *_verdict(F.col("reply")))


#: Characters of a section that go into a prompt.
PROMPT_CHARACTERS = 4_000


def section_prompts(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, section_no, heading, n_terms, n_known, prompt): each section of (path, text) documents with its key terms and the symbols
    (symbol_name, kind, file_path) that are named so. Sections meet symbols over their terms, of which there are eight at most."""
    cut = lines.sections(texts).withColumn("terms", lines.key_terms(F.col("heading"), F.col("body")))
    asked = cut.select("path", "section_no", F.explode("terms").alias("symbol_name"))
    # a name that many files declare is one line with their number
    known = symbols.groupBy("symbol_name").agg(F.min("kind").alias("kind"), F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("- "), "symbol_name", F.lit(" ("), "kind", F.lit(") in "), "file_path", F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    met = asked.join(known.hint("merge"), "symbol_name").groupBy("path", "section_no").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    # merged, not broadcast: sections come from texts, which are far larger than their estimate
    both = cut.join(met.hint("merge"), ["path", "section_no"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    prompt = F.concat(F.lit("Section: "), "heading", F.lit("\n"), F.substring("body", 1, PROMPT_CHARACTERS), F.lit("\n\nSymbols:\n"), F.array_join("lines", "\n"))
    return both.select("path", "section_no", "heading", F.size("terms").alias("n_terms"), F.size("lines").alias("n_known"), prompt.alias("prompt"))


def checked_sections(prompts: DataFrame, complete: Callable[[str, str], str]) -> DataFrame:
    """(path, section_no, heading, verdict, reason) by a text model; a reply that cannot be read, and a call that fails, are unclear.

    The model is asked once per section; write the result before it is read twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for prompt in frame["prompt"]:
                try:
                    replies.append(complete("Is the section accurate? Answer as JSON with verdict and reason.", prompt))
                except Exception:  # noqa: BLE001 - a failing call is an unclear section
                    replies.append("")
            yield pd.DataFrame({"path": frame["path"], "section_no": frame["section_no"], "heading": frame["heading"], "reply": replies})

    told = prompts.select("path", "section_no", "heading", "prompt").mapInPandas(run, "path string, section_no int, heading string, reply string")
    return told.select("path", "section_no", "heading", *_verdict(F.col("reply")))


def unchanged_warning(previous: Column, head: Column, n_changes: Column) -> Column:
    """Whether two different revisions gave no difference at all."""
    return (previous != head) & (n_changes == 0)
