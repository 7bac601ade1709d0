"""Dependency, evidence, ownership and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import text as T

#: Lines of a file that share a bucket in interval joins; long anchors fall into several.
LINE_BUCKET = 64
#: Rows of a side that is broadcast.
FEW = 100_000
#: Sources below which a fact of a model counts as degraded.
DEGRADED_BELOW = 3


def of_repo(df: DataFrame, *others: DataFrame) -> list[str]:
    """["repo"] if all tables name the repository of their rows, which paths are then joined with; else there is one repository."""
    return ["repo"] if all("repo" in d.columns for d in (df, *others)) else []


def reverse_dependencies(symbols: DataFrame, claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import a package defined in a changed file of their repository, without the changed files themselves."""
    repo = of_repo(claims, changed)
    named = changed.select(*repo, F.col("path").alias("source_file")).distinct()
    defined = claims.filter("predicate = 'defines'").join(named, [*repo, "source_file"], "left_semi").select(*repo, "subject_id")
    packages = defined.join(symbols.select(F.col("id").alias("subject_id"), "import_path"), "subject_id").select(*repo, F.col("import_path").alias("object_text")).distinct()
    users = claims.filter("predicate = 'imports'").join(packages, [*repo, "object_text"], "left_semi").select(*repo, "source_file").distinct()
    return users.join(named, [*repo, "source_file"], "left_anti").withColumnRenamed("source_file", "path")


def with_reverse_dependencies(symbols: DataFrame, claims: DataFrame, changed: DataFrame) -> DataFrame:
    repo = of_repo(claims, changed)
    return changed.select(*repo, "path", F.lit("changed").alias("why")).unionByName(reverse_dependencies(symbols, claims, changed).withColumn("why", F.lit("depends")))


def enrichment_candidates(symbols: DataFrame, claims: DataFrame, kinds: tuple[str, ...] = ("func", "type", "method", "interface"), visibilities: tuple[str, ...] = ("public",)) -> DataFrame:
    """Symbols worth enriching, with how often their package is imported."""
    fan_in = claims.filter("predicate = 'imports' and object_text is not null").groupBy(F.col("object_text").alias("import_path")).agg(F.count(F.lit(1)).alias("fan_in"))
    wanted = symbols.filter(F.col("kind").isin(*kinds) & F.col("visibility").isin(*visibilities))
    return wanted.join(fan_in, "import_path", "left").select("id", "repo", "import_path", "symbol_name", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with their evidence as an array in order; facts without any have an empty one."""
    nested = evidence.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_type", "source_ref", "content_hash"))).alias("evidence"))
    empty = F.array().cast(nested.schema["evidence"].dataType)
    return facts.join(nested, facts["id"] == nested["fact_id"], "left").drop("fact_id").withColumn("evidence", F.coalesce("evidence", empty))


def facts_by_path_prefix(facts: DataFrame, symbols: DataFrame, repo: str, prefix: str) -> DataFrame:
    """Facts about symbols of a repo whose name starts with a prefix, taken literally."""
    about = symbols.filter((F.col("repo") == repo) & F.col("symbol_name").startswith(prefix)).select(F.col("id").alias("subject_id"), "symbol_name")
    return facts.join(about, "subject_id")


def envelope_error(facts: DataFrame) -> Column:
    """The first thing that keeps a fact with its evidence from being served, or null."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    missing = lambda name: F.concat(F.lit("fact "), F.col("id").cast("string"), F.lit(f" missing required field: {name}"))
    fields = [(empty("source_quote"), "source_quote"), (F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "evidence (no evidence rows)"), *((empty(c), c) for c in ("status", "extractor", "last_verified"))]
    return F.coalesce(*[F.when(bad, missing(name)) for bad, name in fields])


def served(facts: DataFrame, strict: bool = True) -> DataFrame:
    """Facts with evidence (``with_evidence``) as they are served: ``extractor`` names its version, ``degraded`` marks facts of a model that fewer than
    three sources corroborate. A fact without a required field fails the job, or without ``strict`` is a row with its ``error`` and no envelope."""
    maker = F.when(F.coalesce("extractor_version", F.lit("")) != "", F.concat_ws("@", "extractor", "extractor_version")).otherwise(F.col("extractor"))
    degraded = (F.coalesce("model", F.lit("")) != "") & (F.col("corroboration") < DEGRADED_BELOW)
    parts = ["body", "source_quote", "kind", "confidence", "corroboration", "status", "evidence", maker.alias("extractor"), "model", "last_verified", degraded.alias("degraded")]
    told = facts.withColumn("error", envelope_error(facts)).withColumn("envelope", F.struct(*parts))
    if strict:
        return told.select("id", F.when(F.col("error").isNull(), F.col("envelope")).otherwise(F.raise_error(F.col("error"))).alias("envelope")).select("id", "envelope.*")
    return told.select("id", "error", F.when(F.col("error").isNull(), F.col("envelope")).alias("envelope"))


def gated(facts: DataFrame, kinds: tuple[str, ...] = (), min_confidence: float | None = None) -> DataFrame:
    """Active facts of some kinds. Where no confidence is asked for, facts made by a model need two corroborations."""
    if kinds:
        facts = facts.filter(F.col("kind").isin(*kinds))
    facts = facts.filter((F.col("confidence") >= (min_confidence or 0.0)) & (F.col("status") == "active"))
    made_by_model = F.coalesce("model", F.lit("")) != ""
    if min_confidence is None:
        facts = facts.filter(~made_by_model | (F.col("corroboration") >= 2))
    return facts.withColumn("degraded", made_by_model & (F.col("corroboration") < DEGRADED_BELOW))


def fact_context(symbols: DataFrame, facts: DataFrame, pattern: str, kinds: tuple[str, ...] = (), min_confidence: float | None = None) -> DataFrame:
    """Facts about symbols that match a name; for repos where these have no facts at all, facts about files (symbols named
    by their path) in the folders of the symbols' packages.

    The fallback looks at facts before any filter, as a filtered-out fact still shows that the repo has some.
    """
    matched = symbols.filter(F.col("symbol_name").ilike(pattern))
    direct = facts.join(matched.select(F.col("id").alias("subject_id"), "repo", "symbol_name"), "subject_id")
    bare = matched.join(direct.select("repo").distinct(), "repo", "left_anti").select("repo", T.local_dir(F.col("import_path")).alias("folder")).filter("folder <> ''").distinct()
    # symbols of files in these folders or below: every folder above a symbol's name is looked up, so that prefixes are an equi-join
    parts = F.split("symbol_name", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    placed = symbols.select(F.col("id").alias("subject_id"), "repo", "symbol_name", F.explode(above).alias("folder"))
    files = placed.join(bare, ["repo", "folder"], "left_semi").select("subject_id", "repo", "symbol_name").distinct()
    found = direct.withColumn("level", F.lit("symbol")).unionByName(facts.join(files, "subject_id").withColumn("level", F.lit("file")), allowMissingColumns=True)
    return gated(found, kinds, min_confidence)


def _bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / LINE_BUCKET), F.floor(F.greatest(F.col(end), F.col(start)) / LINE_BUCKET))))


def touched(anchors: DataFrame, hunks: DataFrame) -> DataFrame:
    """The different (file, start_line, end_line) of anchors that a hunk (file, hunk_start, hunk_end) touches; (0, 0) is a whole file.

    Anchors share few places, so these are told apart before they meet the hunks. Both sides are cut into buckets of lines, so that a file
    with many places and hunks is spread over tasks.
    """
    files = hunks.select("file").distinct()
    places = anchors.select("file", "start_line", "end_line").distinct().join(files, "file", "left_semi")
    whole = places.filter("start_line = 0 and end_line = 0")
    placed = places.filter("not (start_line = 0 and end_line = 0)")
    left, right = _bucketed(placed, "start_line", "end_line"), _bucketed(hunks.select("file", "hunk_start", "hunk_end").distinct(), "hunk_start", "hunk_end")
    met = left.join(right, (left["file"] == right["file"]) & (left["_bucket"] == right["_bucket"]) & (left["start_line"] <= right["hunk_end"]) & (left["end_line"] >= right["hunk_start"]), "left_semi")
    return met.drop("_bucket").distinct().unionByName(whole)


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most ``FEW`` rows; beyond, to be merged."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def overlapping(anchors: DataFrame, hunks: DataFrame) -> DataFrame:
    """Anchors (claim_id, file, start_line, end_line) that a hunk (file, hunk_start, hunk_end) touches; (0, 0) is a whole file."""
    return anchors.join(few(touched(anchors, hunks)), ["file", "start_line", "end_line"], "left_semi").select(anchors.columns).distinct()


def hunks_of(changes: DataFrame) -> DataFrame:
    """Old-side line intervals of changes; an insertion counts as its line."""
    return changes.select(F.col("path").alias("file"), F.col("old_start").alias("hunk_start"), (F.col("old_start") + F.greatest(F.col("old_count"), F.lit(1)) - 1).alias("hunk_end"))


def anchors_of(claims: DataFrame, radius: int = 0) -> DataFrame:
    return claims.select(F.col("claim_key").alias("claim_id"), F.col("source_file").alias("file"), F.greatest(F.col("source_line") - radius, F.lit(1)).alias("start_line"), (F.col("source_line") + radius).alias("end_line"))


def anchor_states(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    """State of each anchor after file-level changes: deleted files make it invalid, other changes stale, else it is verified."""
    touched = changes.select(F.explode(F.array("path", "old_path") if "old_path" in changes.columns else F.array("path")).alias("file"), "status").filter("file is not null")
    worst = touched.groupBy("file").agg(F.bool_or(F.col("status") == "D").alias("gone"))
    return anchors.join(worst, "file", "left").withColumn("state", F.when(F.col("gone").isNull(), "verified").when(F.col("gone"), "invalid").otherwise("stale")).drop("gone")


def pr_impact(claims: DataFrame, changes: DataFrame, radius: int = 5) -> DataFrame:
    """Claims whose lines, with ``radius`` around them, a change touches; in deleted files, all claims."""
    anchors = anchors_of(claims, radius)
    hit = few(touched(anchors, hunks_of(changes.filter("status <> 'D'"))).withColumn("stale", F.lit(True)))
    gone = few(changes.filter("status = 'D'").select(F.col("path").alias("file"), F.lit(True).alias("invalid")).distinct())
    told = anchors.join(hit, ["file", "start_line", "end_line"], "left").join(gone, "file", "left")
    impact = F.when(F.col("invalid"), "invalid").when(F.col("stale"), "stale")
    # 'invalid' comes before 'stale'; claims of one key share the worst
    worst = told.select("claim_id", impact.alias("impact")).filter("impact is not null").groupBy("claim_id").agg(F.min("impact").alias("impact"))
    return claims.join(worst, claims["claim_key"] == worst["claim_id"]).drop("claim_id")


def manifest_docs(changed: DataFrame, manifest: list[tuple[str, list[str]]], doublestar: bool = False) -> DataFrame:
    """Documents that a manifest of (glob, documents) ties to changed paths: one expression over the paths, no join."""
    docs = F.flatten(F.array(*[F.when(F.col("path").rlike(T.glob_pattern(g, doublestar)), F.array(*map(F.lit, d))).otherwise(F.array().cast("array<string>")) for g, d in manifest]))
    return changed.select("path", F.explode(docs).alias("doc"))


def implementations(types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(interface, type) where the type has every method of the interface; both sides are (name, method). Empty interfaces do not count.

    A type meets an interface over the interface's rarest method only, and its other methods are then counted: a method that many have
    brings no types together.
    """
    asked = interfaces.distinct().select(F.col("name").alias("interface"), "method")
    had = types.distinct().select(F.col("name").alias("type"), "method")
    common = asked.join(had.groupBy("method").agg(F.count(F.lit(1)).alias("n")), "method", "left")
    rarest = common.groupBy("interface").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "method"))["method"].alias("method"), F.count(F.lit(1)).alias("needed"))
    met = rarest.join(had, "method").filter("interface <> type").select("interface", "type", "needed")
    counted = met.join(asked, "interface").join(had, ["type", "method"]).groupBy("interface", "type", "needed").agg(F.count(F.lit(1)).alias("had"))
    return counted.filter("had = needed").select("interface", "type")


def xref(symbols: DataFrame, key: Column) -> DataFrame:
    """Repos and ids of a symbol key, which is import path, dot, name."""
    return symbols.filter(F.concat_ws(".", "import_path", "symbol_name") == key).select("repo", "id")


def staged_paths(paths: DataFrame, replaced: list[tuple[str, str]]) -> DataFrame:
    """Module path of each path by replacement directives: an exact one, else the longest prefix, else the path without version."""
    out = T.strip_version(F.col("path"))
    for old, new in sorted(replaced, key=lambda r: len(r[0])):
        out = F.when((F.col("path") == old) | F.col("path").startswith(old + "/"), F.concat(F.lit(new), F.substr(F.col("path"), F.lit(len(old) + 1)))).otherwise(out)
    return paths.withColumn("module", out)
