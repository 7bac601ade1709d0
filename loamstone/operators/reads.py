"""Point, pattern, prefix and range reads over symbols, claims and files. Every function takes DataFrames and returns one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators.joins import of_repo

LIST_LIMIT, SEARCH_LIMIT, CONTEXT_LIMIT = 200, 50, 10_000


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """At most ``limit`` rows; None and negative numbers mean all."""
    return df if limit is None or limit < 0 else df.limit(limit)


def symbols_like(symbols: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Symbols whose name matches a LIKE pattern without regard to case, by name."""
    return limited(symbols.filter(F.col("symbol_name").ilike(pattern.replace("\\", "\\\\"))).orderBy("symbol_name", "id"), limit)


def symbols_named(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("symbol_name") == name)


def symbols_of_package(symbols: DataFrame, import_path: str) -> DataFrame:
    return symbols.filter(F.col("import_path") == import_path).orderBy("symbol_name")


def symbol_by_key(symbols: DataFrame, repo: str, import_path: str, name: str) -> DataFrame:
    return symbols.filter((F.col("repo") == repo) & (F.col("import_path") == import_path) & (F.col("symbol_name") == name))


def search_capped(symbols: DataFrame, pattern: str, cap: int = SEARCH_LIMIT) -> DataFrame:
    """The first matches by repo and name, each with the number of all matches."""
    found = symbols_like(symbols, pattern)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("repo", "symbol_name", "id").limit(cap).join(F.broadcast(total))  # one row


def packages_by_prefix(symbols: DataFrame, prefix: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Import paths with a prefix, each with the number of all of them."""
    paths = symbols.filter(F.col("import_path").startswith(prefix)).select("import_path").distinct()
    total = paths.agg(F.count(F.lit(1)).alias("total"))
    return paths.orderBy("import_path").limit(limit).join(F.broadcast(total))  # one row


def routing_prefixes(symbols: DataFrame, length: int = 3) -> DataFrame:
    """Lower-case name prefixes and the repos that have them: what a search by prefix must look at."""
    named = symbols.filter(F.length("symbol_name") >= length).select(F.lower(F.substring("symbol_name", 1, length)).alias("prefix"), "repo").distinct()
    return named.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"), F.count(F.lit(1)).alias("n_repos"))


def repos_to_search(routing: DataFrame, all_repos: DataFrame, query: str, length: int = 3) -> DataFrame:
    """Repos that may hold a match of ``query``: all of them where it is short or starts with a wildcard."""
    head = query[:length].lower()
    if len(head) < length or "%" in head or "_" in head:
        return all_repos.select("repo").distinct()
    return routing.filter(F.col("prefix") == head).select(F.explode(F.split("repos", ",")).alias("repo"))


def claims_of_symbols(symbols: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per claim of the given symbols; symbols without claims drop out."""
    return symbols.join(claims, symbols["id"] == claims["subject_id"]).drop("subject_id")


def query_claims(symbols: DataFrame, claims: DataFrame, pattern: str, tier: str = "structural") -> DataFrame:
    """Symbols that match a pattern with their number of claims, by predicate list."""
    found = claims_of_symbols(symbols_like(symbols, pattern), claims.filter(F.col("claim_tier") == tier))
    return found.groupBy("id", "repo", "import_path", "symbol_name", "kind").agg(F.count(F.lit(1)).alias("n_claims"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"), F.min("source_line").alias("first_line"))


def claims_in_range(claims: DataFrame, file: str, start: int = 0, end: int = 0) -> DataFrame:
    """Claims of a file between two lines; (0, 0) is the whole file."""
    found = claims.filter(F.col("source_file") == file)
    return found if (start, end) == (0, 0) else found.filter(F.col("source_line").between(start, end))


def files_for_package(source_files: DataFrame, claims: DataFrame, symbols: DataFrame, import_path: str) -> DataFrame:
    """Live files that hold a claim about a symbol of the package, in the claim's repository where claims name one."""
    repo = of_repo(claims, source_files)
    about = claims.join(symbols.filter(F.col("import_path") == import_path).select("id"), claims["subject_id"] == F.col("id"), "left_semi")
    held = about.select(*repo, F.col("source_file").alias("relative_path"))
    return source_files.filter(~F.col("deleted")).join(held, [*repo, "relative_path"], "left_semi").select("repo", "relative_path")


def deleted_files(source_files: DataFrame) -> DataFrame:
    return source_files.filter("deleted").select("repo", "relative_path", "last_indexed")


def cache_hits(source_files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted rows (repo, relative_path, content_hash, extractor, grammar) that a live row has already; no grammar is an empty one."""
    key = ["repo", "relative_path", "content_hash", "extractor"]
    live = source_files.filter(~F.col("deleted")).select(*key, F.coalesce("grammar", F.lit("")).alias("_grammar"))
    return wanted.withColumn("_grammar", F.coalesce("grammar", F.lit(""))).join(live, [*key, "_grammar"], "left_semi").drop("_grammar")


def facts_in_state(facts: DataFrame, statuses: list[str]) -> DataFrame:
    return facts.filter(F.col("status").isin(statuses))


def reverify_plan(facts: DataFrame, before: Column, sample: int, budget: int) -> DataFrame:
    """The oldest active model-made facts, ``sample`` of them, and which of them the budget covers."""
    due = facts.filter((F.col("status") == "active") & (F.coalesce("model", F.lit("")) != "") & (F.col("last_verified") < before))
    oldest = due.orderBy("last_verified", "id").limit(sample)
    # the rows ranked here are at most ``sample``
    return oldest.withColumn("position", F.row_number().over(Window.orderBy("last_verified", "id"))).withColumn("within_budget", F.col("position") <= budget)


def file_by_path(source_files: DataFrame, repo: str, path: str) -> DataFrame:
    return source_files.filter((F.col("repo") == repo) & (F.col("relative_path") == path))


def claims_by_predicate(claims: DataFrame, predicate: str) -> DataFrame:
    return claims.filter(F.col("predicate") == predicate)


def feedback_of(feedback: DataFrame, fact_id: int) -> DataFrame:
    return feedback.filter(F.col("fact_id") == fact_id)


def documents_in_order(documents: DataFrame) -> DataFrame:
    """Documents with their place in the list: refreshed last first, then by id.

    Documents are counted by day first, so that no task ranks more than those of one day, whatever the times are.
    """
    dated = documents.withColumn("_day", F.to_date("last_refreshed"))
    days = dated.groupBy("_day").agg(F.count(F.lit(1)).alias("n"))
    before = days.select(F.col("_day").alias("_on"), F.coalesce(F.sum("n").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per day
    within = dated.withColumn("within", F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("last_refreshed"), "doc_id")))
    return within.join(before, F.col("_day").eqNullSafe(F.col("_on"))).select("doc_id", "last_refreshed", (F.col("before") + F.col("within")).cast("long").alias("place"))


def anchors_in_state(anchors: DataFrame, state: str) -> DataFrame:
    """Ids of the anchors in a state, in order."""
    return anchors.filter(F.col("state") == state).select("claim_id").orderBy("claim_id")


def mark_verified(anchors: DataFrame, verified: DataFrame) -> DataFrame:
    """Anchors after the given ones (claim_id) were looked at."""
    seen = verified.select("claim_id").distinct().withColumn("_seen", F.lit(True))
    return anchors.join(seen, "claim_id", "left").withColumn("state", F.when(F.col("_seen"), "verified").otherwise(F.col("state"))).drop("_seen")


def changed_paths(changes: DataFrame) -> DataFrame:
    return changes.filter("status <> 'D'").select("path").distinct()


def deleted_paths(changes: DataFrame) -> DataFrame:
    """Deleted files, and the old names of renamed ones."""
    gone = changes.filter("status = 'D'").select("path")
    if "old_path" in changes.columns:
        gone = gone.unionByName(changes.filter("status = 'R'").select(F.col("old_path").alias("path")))
    return gone.distinct()


# Fixed values.
CONTEXT_FILES = ("CLAUDE.md", "AGENTS.md", ".cursorrules", ".cursorignore", ".github/copilot-instructions.md", ".github/AGENTS.md", ".windsurfrules", ".clinerules")
DOCUMENT_NAMES = ("README.md", "README.*.md", "CLAUDE.md", "AGENTS.md", "CONTRIBUTING.md", "CHANGELOG.md", "SECURITY.md", "CODE_OF_CONDUCT.md", "ARCHITECTURE.md")
SKIPPED_FOLDERS = (".git", "vendor", "node_modules", "_output", "testdata")


def _skipped(folders: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, folders)))


def document_files(paths: DataFrame, names: tuple[str, ...] = DOCUMENT_NAMES, skipped: tuple[str, ...] = SKIPPED_FOLDERS, exclude: tuple[str, ...] = (), all_markdown: bool = False) -> DataFrame:
    """Documents by their names (globs of base names), or all Markdown files, outside skipped folders.

    ``exclude`` has globs and lines of an ignore file: empty lines and comments count for nothing, one that ends with a slash leaves a folder
    out, one with a slash is matched with the path, any other with the base name.
    """
    path, name = F.col("path"), T.base_name(F.col("path"))

    def excluded(glob: str) -> Column:
        if glob.endswith("/"):
            return path.startswith(glob) | path.contains("/" + glob)
        return (path if "/" in glob else name).rlike(T.glob_pattern(glob))

    kept = F.lower(name).endswith(".md") if all_markdown else reduce(lambda a, b: a | b, [name.rlike(T.glob_pattern(n)) for n in names])
    for glob in (line.strip() for line in exclude):
        if glob and not glob.startswith("#"):
            kept = kept & ~excluded(glob)
    return paths.filter(kept & ~_skipped(skipped))


def context_files(paths: DataFrame, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """Instruction files: the known paths, and files of their base names at any depth outside skipped folders."""
    names = sorted({p.rsplit("/", 1)[-1] for p in CONTEXT_FILES})
    return paths.filter(F.col("path").isin(*CONTEXT_FILES) | (T.base_name(F.col("path")).isin(*names) & ~_skipped(skipped)))
