"""Who owns the lines of a symbol: an interval join of blame lines with symbol ranges, as facts with evidence.

Lines and ranges meet in buckets of ``LINE_BUCKET`` lines of a file, so a file of any length, with any number of ranges that
overlap, spreads over tasks; what a task hands on is counted per range, bucket and author.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import LINE_BUCKET


def inside(points: DataFrame, ranges: DataFrame, key: list[str], line: str = "line", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Pairs of a point and a range of the same key that holds its line, with the line's bucket; columns but the key must differ."""
    left = points.withColumn("_bucket", F.floor(F.col(line) / LINE_BUCKET))
    right = ranges.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / LINE_BUCKET), F.floor(F.col(end) / LINE_BUCKET))))
    return left.join(right, [*key, "_bucket"]).filter(F.col(line).between(F.col(start), F.col(end)))


def innermost(points: DataFrame, declared: DataFrame, key: list[str], line: str = "line_no") -> DataFrame:
    """Points with the declaration (name, kind, line, end_line) that encloses each most closely; without one these are null."""
    ranges = declared.select(*key, F.col("name").alias("enclosing"), F.col("kind").alias("enclosing_kind"), F.col("line").alias("_start"), F.col("end_line").alias("_end"))
    met = inside(points, ranges, key, line, "_start", "_end")
    best = met.groupBy(*key, line).agg(F.max_by(F.struct("enclosing", "enclosing_kind"), F.struct("_start", -F.col("_end"))).alias("_best"))
    return points.join(best, [*key, line], "left").withColumn("enclosing", F.col("_best.enclosing")).withColumn("enclosing_kind", F.col("_best.enclosing_kind")).drop("_best")


def symbol_ownership(blame: DataFrame, ranges: DataFrame, key: list[str], extractor: str = "blame") -> tuple[DataFrame, DataFrame]:
    """(facts, evidence) of blame lines (key, line, author, commit, at) and ranges (key, symbol_id, start_line, end_line).

    A fact names the authors of a symbol's lines, most lines first, with whole percentages. Its staleness hash changes with any commit or place of
    its lines: a digest of the digests of its buckets, each over ``commit:line`` in order. Evidence is each author's latest commit."""
    met = inside(blame, ranges, key)
    spot = F.concat(F.col("commit"), F.lit(":"), F.col("line").cast("string"), F.lit("\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "commit", spot.alias("spot")))), lambda s: s["spot"]), "")
    digests = met.groupBy("symbol_id", "_bucket").agg(F.sha2(listed, 256).alias("digest"))
    whole = digests.groupBy("symbol_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "digest"))), lambda d: d["digest"]), ""), 256).alias("staleness_hash"))

    own = met.groupBy("symbol_id", "author").agg(F.count(F.lit(1)).alias("lines"), F.max(F.struct("at", "commit")).alias("latest"))
    authors = own.groupBy("symbol_id").agg(F.sum("lines").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("lines")).alias("less"), "author"))).alias("authors"))

    def share(a: Column) -> Column:
        n = (-a["less"]).cast("long")
        percent = F.floor(n * 100 / F.col("total")).cast("string")
        return F.concat(a["author"], F.lit(" ("), percent, F.lit("%, "), n.cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" lines)"))

    body = F.concat(F.lit("Ownership: "), F.array_join(F.transform("authors", share), "; "))
    quote = F.concat(F.lit("blame: top contributor "), F.col("authors")[0]["author"])
    facts = authors.join(whole, "symbol_id").select(
        F.col("symbol_id").alias("subject_id"), F.lit("ownership").alias("kind"), body.alias("body"), quote.alias("source_quote"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("corroboration"),
        F.lit(extractor).alias("extractor"), F.lit("").alias("model"), "staleness_hash", F.lit("active").alias("status"),
    )
    evidence = own.join(whole, "symbol_id").select(F.col("symbol_id").alias("subject_id"), F.lit("blame").alias("source_type"), F.col("latest.commit").alias("source_ref"), "author", F.col("latest.at").alias("authored_at"), "lines", F.col("staleness_hash").alias("content_hash"))
    return facts, evidence


def stale_ownership(facts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ownership facts whose symbols have other lines or commits now, or none at all any more."""
    now = fresh.select("subject_id", F.col("staleness_hash").alias("_now"))
    joined = facts.join(now, "subject_id", "left")
    return joined.filter(~F.col("_now").eqNullSafe(F.col("staleness_hash"))).select(*facts.columns, F.when(F.col("_now").isNull(), "gone").otherwise("changed").alias("why"))
