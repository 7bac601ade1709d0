"""Counts, rates, rankings and per-package aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators.joins import of_repo


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")


def fact_counts(facts: DataFrame) -> DataFrame:
    return facts.filter("status = 'active'").groupBy("kind").agg(F.count(F.lit(1)).alias("n_facts"))


def mining_priority(source_files: DataFrame, symbols: DataFrame, claims: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """The k files most worth mining: never mined first, then by public symbols, fan-in and missing facts, then by path.

    A file's symbols are here those that claims located in it are about; ``file_priority`` takes symbols that are named by the file.
    Each side is aggregated before it is joined, so that nothing is counted twice.
    """
    repo = of_repo(claims, source_files)
    live = source_files.filter(~F.col("deleted") & ~T.mining_excluded(F.col("relative_path")))
    per_symbol = claims.groupBy(*repo, F.col("source_file").alias("relative_path"), "subject_id").agg(F.count(F.lit(1)).alias("n"))
    held = per_symbol.join(symbols.select(F.col("id").alias("subject_id"), "visibility"), "subject_id")
    per_file = held.groupBy(*repo, "relative_path").agg(_count_if(F.col("visibility") == "public").alias("public_symbols"), F.sum("n").alias("fan_in"))
    known = facts.filter("status = 'active'").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_facts"))
    facts_of = per_symbol.join(known, "subject_id").groupBy(*repo, "relative_path").agg(F.sum("n_facts").alias("n_facts"))
    joined = live.join(per_file, [*repo, "relative_path"], "left").join(facts_of, [*repo, "relative_path"], "left")
    return _most_worth(joined, k)


def file_priority(source_files: DataFrame, symbols: DataFrame, claims: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """As ``mining_priority``, where a file's symbols are those of its repository whose import path is the file's path, fan-in is the number of
    claims about them, and facts are those about symbols of that import path in any repository."""
    live = source_files.filter(~F.col("deleted") & ~T.mining_excluded(F.col("relative_path")))
    about = claims.groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    own = symbols.select("id", "repo", F.col("import_path").alias("relative_path"), "visibility").join(about, "id", "left")
    per_file = own.groupBy("repo", "relative_path").agg(_count_if(F.col("visibility") == "public").alias("public_symbols"), F.sum("n").alias("fan_in"))
    known = facts.filter("status = 'active'").groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    facts_of = symbols.select("id", F.col("import_path").alias("relative_path")).join(known, "id").groupBy("relative_path").agg(F.sum("n").alias("n_facts"))
    return _most_worth(live.join(per_file, ["repo", "relative_path"], "left").join(facts_of, "relative_path", "left"), k)


def _most_worth(files: DataFrame, k: int) -> DataFrame:
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ranked = files.select("repo", "relative_path", "never_mined", (number("public_symbols") * 3 + number("fan_in") - number("n_facts") * 5).alias("priority"))
    return ranked.orderBy(F.desc("never_mined"), F.desc("priority"), "relative_path", "repo").limit(max(k, 0))


def quality_gate(feedback: DataFrame, corrections: DataFrame) -> DataFrame:
    """Labels by kind, labelled facts, and the share of them found wrong or retired, at most one."""
    f = feedback.agg(*[_count_if(F.col("reason") == r).alias(r) for r in ("wrong", "stale", "misleading", "offensive")])
    c = corrections.agg(*[_count_if(F.col("action") == a).alias(a) for a in ("correct", "delete", "supersede")])
    labelled = feedback.select("fact_id").union(corrections.select("fact_id")).distinct().agg(F.count(F.lit(1)).alias("labelled"))
    one = f.join(F.broadcast(c)).join(F.broadcast(labelled))  # three single rows
    hits = F.col("wrong") + F.col("delete") + F.col("supersede")
    return one.withColumn("rate", F.round(F.when(F.col("labelled") == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.col("labelled"))), 9))


def coverage(source_files: DataFrame, symbols: DataFrame, facts: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Live files, how many hold a symbol with an active fact, and the age in days of the oldest file never mined."""
    repo = of_repo(claims, source_files)
    known = symbols.join(facts.filter("status = 'active'"), symbols["id"] == facts["subject_id"], "left_semi").select("id")
    covered = claims.join(known, claims["subject_id"] == known["id"], "left_semi").select(*repo, F.col("source_file").alias("relative_path"), F.lit(1).alias("has_fact")).distinct()
    live = source_files.filter(~F.col("deleted")).join(covered, [*repo, "relative_path"], "left")
    age = F.greatest(F.datediff(now, F.col("last_indexed")), F.lit(0))
    return live.agg(F.count(F.lit(1)).alias("live_files"), F.coalesce(F.sum("has_fact"), F.lit(0)).alias("covered_files"), F.max(F.when(F.col("never_mined"), age)).alias("oldest_unmined_days"))


def ownership(blame: DataFrame) -> DataFrame:
    """Lines per author of a file with their share in whole percent, and the author's latest commit."""
    total = blame.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    own = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("lines"), F.max(F.struct("at", "commit")).alias("latest"))
    return own.join(total, "file").select("file", "author", "lines", F.floor(F.col("lines") * 100 / F.col("total")).cast("long").alias("percent"), F.col("latest.commit").alias("latest_commit"))


def repo_inventory(symbols: DataFrame, claims: DataFrame, source_files: DataFrame, meta: DataFrame, now: Column) -> DataFrame:
    """Symbols, claims and the time of extraction per repo, which ``meta`` (repo, extracted_at) knows better than the files' last indexing, and
    whether any repo's files were indexed more than seven days before ``now``; repos without symbols are left out."""
    s = symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("n_symbols"))
    c = claims.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).join(symbols.select("id", "repo"), F.col("subject_id") == F.col("id")).groupBy("repo").agg(F.sum("n").alias("n_claims"))
    f = source_files.groupBy("repo").agg(F.max("last_indexed").cast("string").alias("indexed_at"))
    known = s.join(c, "repo", "left").join(f, "repo", "left").join(meta.select("repo", F.col("extracted_at").cast("string").alias("meta_at")), "repo", "left")
    stale = known.agg(F.coalesce(F.bool_or(T.is_stale(F.col("indexed_at"), now)), F.lit(False)).alias("any_stale"))
    return known.select("repo", "n_symbols", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce(F.nullif("meta_at", F.lit("")), "indexed_at").alias("extracted_at")).join(F.broadcast(stale))  # one row


def enrichment_status(symbols: DataFrame, claims: DataFrame, source_files: DataFrame, now: Column) -> DataFrame:
    """(import_path, enriched): not yet, stale since a file of the package was indexed later, or the day and its age."""
    repo = of_repo(claims, source_files)
    held = claims.join(symbols.select("id", "import_path"), F.col("subject_id") == F.col("id"))
    per = held.groupBy("import_path").agg(F.max(F.when(F.col("claim_tier") == "semantic", F.col("last_verified"))).alias("at"))
    indexed = source_files.filter(~F.col("deleted")).groupBy(*repo, F.col("relative_path").alias("source_file")).agg(F.max("last_indexed").alias("indexed"))
    changed = held.select(*repo, "import_path", "source_file").distinct().join(indexed, [*repo, "source_file"]).groupBy("import_path").agg(F.max("indexed").cast("timestamp").alias("indexed"))
    all_ = symbols.select("import_path").distinct().join(per, "import_path", "left").join(changed, "import_path", "left")
    day, age = F.date_format("at", "yyyy-MM-dd"), T.human_age(F.unix_timestamp(now) - F.unix_timestamp("at"))
    said = F.when(F.col("at").isNull(), "Not yet enriched").when(F.col("indexed") > F.col("at"), F.concat(F.lit("Enrichment stale: source changed since "), day))
    return all_.select("import_path", said.otherwise(F.concat(F.lit("Enriched at "), day, F.lit(" ("), age, F.lit(")"))).alias("enriched"))


def package_interfaces(symbols: DataFrame, claims: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(import_path, interface, types): the interfaces of each package with the types (default: symbols) of the same package that a claim ties to
    them by name."""
    faces = symbols.filter("kind = 'interface'").select("import_path", F.col("symbol_name").alias("interface")).distinct()
    tied = claims.filter("predicate = 'implements'").join((types or symbols).select("id", "import_path", "symbol_name"), F.col("subject_id") == F.col("id"))
    tied = tied.select("import_path", F.col("object_text").alias("interface"), F.col("symbol_name").alias("type")).distinct()
    met = faces.join(tied, ["import_path", "interface"], "left").groupBy("import_path", "interface").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return met


def claims_by(claims: DataFrame, column: str) -> DataFrame:
    return claims.groupBy(column).agg(F.count(F.lit(1)).alias("n_claims"))


def corpus_summary(symbols: DataFrame, claims: DataFrame) -> DataFrame:
    per = claims.groupBy("subject_id").agg(_count_if(F.col("claim_tier") == "structural").alias("a"), _count_if(F.col("claim_tier") == "semantic").alias("b"))
    return symbols.join(per, symbols["id"] == per["subject_id"], "left").groupBy("repo").agg(F.count(F.lit(1)).alias("n_symbols"), F.coalesce(F.sum("a"), F.lit(0)).alias("structural"), F.coalesce(F.sum("b"), F.lit(0)).alias("semantic"))


def daily_calls(calls: DataFrame) -> DataFrame:
    """Calls and different repos (by short hash) per day and tool."""
    return calls.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct(F.substring(F.sha2("repo", 256), 1, 16)).alias("n_repos"))


def merged_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of (day, tool, calls, repo hashes) as one."""
    both = a.unionByName(b)
    return both.groupBy("day", "tool").agg(F.sum("calls").alias("calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("repos")))).alias("repos"))


def package_aggregate(symbols: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per package: symbols by kind, files, implementations and imports."""
    s = symbols.groupBy("import_path").agg(F.count(F.lit(1)).alias("n_symbols"), _count_if(F.col("kind") == "func").alias("n_funcs"), _count_if(F.col("kind") == "type").alias("n_types"), _count_if(F.col("kind") == "interface").alias("n_interfaces"), _count_if(F.col("visibility") == "public").alias("n_public"))
    c = claims.join(symbols.select("id", "import_path"), claims["subject_id"] == F.col("id"))
    c = c.groupBy("import_path").agg(F.countDistinct("source_file").alias("n_files"), _count_if(F.col("predicate") == "implements").alias("n_implements"), F.countDistinct(F.when(F.col("predicate") == "imports", F.col("object_text"))).alias("n_imports"), F.date_format(F.max(F.when(F.col("claim_tier") == "semantic", F.col("last_verified"))), "yyyy-MM-dd").alias("enriched_at"))
    return s.join(c, "import_path", "left").na.fill(0, ["n_files", "n_implements", "n_imports"])


def package_markdown(packages: DataFrame) -> DataFrame:
    """A short page per package as one string."""
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    parts = [F.concat(F.lit("# "), F.col("import_path")), F.lit(""), line("Symbols", "n_symbols"), line("Functions", "n_funcs"), line("Types", "n_types"), line("Interfaces", "n_interfaces"), line("Files", "n_files"), line("Imports", "n_imports"), F.concat(F.lit("Enriched: "), F.coalesce("enriched_at", F.lit("never")))]
    return packages.select("import_path", F.concat_ws("\n", *parts).alias("markdown"))


def anchor_summary(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("state").agg(F.count(F.lit(1)).alias("n_anchors"))


def freshness(reports: DataFrame, group: list[str]) -> DataFrame:
    """Reports that are fresh (nothing stale), in percent; 100 where there are none."""
    fresh = (F.col("stale") == 0) & (F.col("stale_packages") == 0)
    out = reports.groupBy(*group).agg(F.count(F.lit(1)).alias("n_reports"), _count_if(fresh).alias("n_fresh"))
    return out.withColumn("percent", F.round(F.when(F.col("n_reports") == 0, 100.0).otherwise(F.col("n_fresh") * 100 / F.col("n_reports")), 6))


def accuracy(path_claims: DataFrame) -> DataFrame:
    """Valid references per context file, and in all."""
    per = path_claims.groupBy("context_file").agg(F.count(F.lit(1)).alias("n_claims"), _count_if(F.col("valid")).alias("n_valid"))
    both = per.unionByName(per.agg(F.lit("(all)").alias("context_file"), F.coalesce(F.sum("n_claims"), F.lit(0)).alias("n_claims"), F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_valid")))
    return both.withColumn("percent", F.when(F.col("n_claims") == 0, 100).otherwise(F.floor(F.col("n_valid") * 100 / F.col("n_claims"))).cast("long"))


def canary(claims: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of n claims."""
    return claims.orderBy(F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key)), 256), key).limit(n)


def canary_verdict(sample: DataFrame, percent: int = 2) -> DataFrame:
    """One row of a sample (bad): its size, how many are bad, and whether these are more than ``percent`` in a hundred."""
    one = sample.agg(F.count(F.lit(1)).alias("n"), _count_if(F.col("bad")).alias("n_bad"))
    return one.withColumn("failed", F.col("n_bad") * 100 > F.col("n") * percent)


def newest_per(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group, by a total order."""
    packed = df.groupBy(*group).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in {*order, *group}])).alias("_r"))
    return packed.select(*group, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c not in group])


def keep_last_revisions(revisions: DataFrame, n: int = 5) -> DataFrame:
    """The last n revisions of each document, by number."""
    last = revisions.groupBy("document_id").agg(F.max("revision_num").alias("_last"))
    return revisions.join(last, "document_id").filter(F.col("revision_num") > F.col("_last") - n).drop("_last")


def eviction(files: DataFrame, cap: Column) -> DataFrame:
    """Rows to evict until the live size is within the cap: tombstones first, then the oldest.

    Sizes are summed per (tombstone, day) first, so the running sum is over one row per day and within one day's rows, whatever the times are.
    """
    dated = files.withColumn("_day", F.to_date("last_indexed"))
    days = dated.groupBy("repo", "deleted", "_day").agg(F.sum("size_bytes").alias("day_bytes"))
    total = files.groupBy("repo").agg(F.sum("size_bytes").alias("total_bytes"))
    before_day = Window.partitionBy("repo").orderBy(F.desc("deleted"), "_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("days_before", F.coalesce(F.sum("day_bytes").over(before_day), F.lit(0))).drop("day_bytes")
    in_day = Window.partitionBy("repo", "deleted", "_day").orderBy("last_indexed", "relative_path").rowsBetween(Window.unboundedPreceding, -1)
    placed = dated.withColumn("day_before", F.coalesce(F.sum("size_bytes").over(in_day), F.lit(0))).join(days, ["repo", "deleted", "_day"]).join(total, "repo")
    return placed.filter(F.col("total_bytes") - F.col("days_before") - F.col("day_before") > cap).select("repo", "relative_path", "deleted", "size_bytes")
