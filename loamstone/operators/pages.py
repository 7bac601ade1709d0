"""A page per package: interfaces, satisfactions, dependencies both ways, functions and types by category, tests, enrichment.

Every section is aggregated by itself over the claims about a package's symbols and joined by package, so a package's claims never
meet in one place but as the lines of its page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Claims that carry a meaning in their text, and the words of a page.
INTERFACE, REVERSE, OTHER = "interface", "reverse_dep:", "Other"
TEST_FUNCTIONS, TEST_FILE = ("Test", "Benchmark", "Example"), "_test.go"
TIER_LINE = "> Tier 1 — Claims-backed structural documentation"
NO_IMPLEMENTATION = "—"
SNAPSHOT_LINES = (">", "> Semantic claims below are AI-generated snapshots and may be stale.")

KEY = ["repo", "import_path"]


def _public(kind: str) -> Column:
    return (F.col("kind") == kind) & (F.col("visibility") == "public")


def _said(predicate: str) -> Column:
    """The text of a claim of a predicate, null for other claims and empty texts."""
    return F.when((F.col("predicate") == predicate) & (F.col("object_text") != ""), F.col("object_text"))


def package_sections(symbols: DataFrame, claims: DataFrame, order: list[str]) -> DataFrame:
    """One row per (repo, import_path), each section as an array; ``order`` is the order of a symbol's claims.

    A function's category is its first ``has_kind``, a type's its last one, if it is no interface; functions of tests have none. A file is
    a test if a claim says so or its name does; the list names those that a claim calls tests."""
    about = claims.select("subject_id", "predicate", "object_text", "source_file", "claim_tier", "last_verified", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    named = symbols.select(F.col("id").alias("subject_id"), *KEY, "symbol_name", "kind", "visibility", "language")
    met = named.join(about, "subject_id")
    place = F.struct(*[F.col(f"_o{i}") for i in range(len(order))])
    listed = lambda c: F.array_sort(F.collect_list(c))

    # what the claims say of each symbol
    kinds = F.col("predicate") == "has_kind"
    texts = F.transform(listed(F.when(_said("encloses").isNotNull(), F.struct(place.alias("at"), F.col("object_text").alias("text")))), lambda x: x["text"])
    own = met.groupBy("subject_id").agg(
        F.coalesce(F.bool_or(kinds & (F.col("object_text") == INTERFACE)), F.lit(False)).alias("is_interface"), F.min_by(_said("has_kind"), F.when(_said("has_kind").isNotNull(), place)).alias("first_kind"),
        F.max_by(F.coalesce("object_text", F.lit("")), F.when(kinds, place)).alias("last_kind"), texts.alias("methods"), F.array_sort(F.collect_list(F.when(F.col("visibility") == "public", _said("implements")))).alias("faces"),
    )
    each = named.join(own, "subject_id", "left")
    category = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(OTHER))

    def by_category(rows: DataFrame, name: str) -> DataFrame:
        groups = rows.groupBy(*KEY, "category").agg(listed("symbol_name").alias("names"))
        return groups.groupBy(*KEY).agg(listed(F.struct("category", "names")).alias(name))

    testing = reduce(lambda a, b: a | b, [F.col("symbol_name").startswith(t) for t in TEST_FUNCTIONS])
    functions = by_category(each.filter(_public("func") & ~testing).withColumn("category", category(F.col("first_kind"))), "functions")
    types = by_category(each.filter(_public("type") & ~F.coalesce("is_interface", F.lit(False))).withColumn("category", category(F.col("last_kind"))), "types")

    implementations = met.filter(_said("implements").isNotNull()).groupBy(*KEY, F.col("object_text").alias("symbol_name")).agg(listed(F.col("symbol_name")).alias("by"))
    faces = each.filter(_public("type") & F.col("is_interface")).join(implementations, [*KEY, "symbol_name"], "left")
    none = F.array().cast("array<string>")
    interfaces = faces.groupBy(*KEY).agg(listed(F.struct(F.col("symbol_name").alias("name"), "subject_id", F.coalesce("methods", none).alias("methods"), F.coalesce("by", none).alias("by"))).alias("interfaces"))
    # types of one name count as one
    met_faces = each.filter("size(faces) > 0").groupBy(*KEY, "symbol_name").agg(F.array_sort(F.flatten(F.collect_list("faces"))).alias("faces"))
    satisfied = met_faces.groupBy(*KEY).agg(listed(F.struct(F.col("symbol_name").alias("type"), "faces")).alias("satisfactions"))

    exported = F.when(F.col("object_text").startswith(REVERSE), F.substr(F.col("object_text"), F.lit(len(REVERSE) + 1)))
    links = met.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(_said("imports"))).alias("imports"), F.array_sort(F.collect_set(F.when(F.col("predicate") == "exports", exported))).alias("used_by"),
        F.array_sort(F.collect_set(F.when((F.col("predicate") == "is_test") & (F.col("object_text") == "true"), F.col("source_file")))).alias("test_files"),
        F.max(F.when(F.col("claim_tier") == "semantic", F.col("last_verified"))).alias("enriched_at"),
    )
    files = met.filter("source_file <> ''").groupBy(*KEY, "source_file").agg(F.coalesce(F.bool_or((F.col("predicate") == "is_test") & (F.col("object_text") == "true")), F.lit(False)).alias("told"))
    is_test = F.col("told") | F.col("source_file").endswith(TEST_FILE)
    counted = files.groupBy(*KEY).agg(F.count_if(~is_test).alias("n_sources"), F.count_if(is_test).alias("n_tests"))

    packages = named.groupBy(*KEY).agg(F.min_by("language", "subject_id").alias("language"))
    for part in (interfaces, satisfied, functions, types, links, counted):
        packages = packages.join(part, KEY, "left")
    return packages.na.fill(0, ["n_sources", "n_tests"])


def _ticked(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _section(rows: Column, title: Column | str, lines: Column, after: str = "\n") -> Column:
    """A section, or nothing where it has no rows."""
    head = title if isinstance(title, Column) else F.lit(title)
    return F.when(F.size(rows) > 0, F.concat(head, F.array_join(lines, "\n"), F.lit(after))).otherwise(F.lit(""))


def package_pages(sections: DataFrame) -> DataFrame:
    """(repo, import_path, markdown) of ``package_sections``; a section without rows is left out."""
    c = F.col
    number = lambda x: F.size(x).cast("string")
    tests = F.when(c("n_tests") > 0, F.concat(F.lit(", "), c("n_tests").cast("string"), F.lit(" (test)"))).otherwise(F.lit(""))
    sources = F.when((c("n_sources") > 0) | (c("n_tests") > 0), F.concat(F.lit("**Source files:** "), c("n_sources").cast("string"), F.lit(" (non-test)"), tests, F.lit("\n"))).otherwise(F.lit(""))
    header = F.concat(F.lit("# "), c("import_path"), F.lit(f"\n\n{TIER_LINE}\n\n**Import path:** "), _ticked(c("import_path")), F.lit("\n"), sources, F.lit("**Language:** "), c("language"), F.lit("\n\n"))

    def face(x: Column) -> Column:
        by = F.when(F.size(x["by"]) > 0, F.array_join(x["by"], ", ")).otherwise(NO_IMPLEMENTATION)
        return F.concat(F.lit("| "), _ticked(x["name"]), F.lit(" | "), F.array_join(x["methods"], ", "), F.lit(" | "), by, F.lit(" |"))

    faces_title = F.concat(F.lit("## Exported Interfaces ("), number("interfaces"), F.lit(")\n\n| Interface | Methods | Key Implementations |\n| --- | --- | --- |\n"))
    parts = [
        header,
        _section(c("interfaces"), faces_title, F.transform("interfaces", face), "\n\n"),
        _section(c("satisfactions"), "## Implements\n\n", F.transform("satisfactions", lambda x: F.concat(F.lit("- "), _ticked(x["type"]), F.lit(" implements "), F.array_join(F.transform(x["faces"], _ticked), ", "))), "\n\n"),
        _section(c("used_by"), F.concat(F.lit("## Used By\n\n"), number("used_by"), F.lit(" packages depend on this package:\n\n")), F.transform("used_by", lambda x: F.concat(F.lit("- "), _ticked(x))), "\n\n"),
        _section(c("imports"), "## Cross-Package References\n\n**Direct dependencies:**\n\n", F.transform("imports", lambda x: F.concat(F.lit("- "), _ticked(x))), "\n\n"),
        _section(c("functions"), "## Exported Functions by Category\n\n", F.transform("functions", lambda x: F.concat(F.lit("**"), x["category"], F.lit(" ("), number(x["names"]), F.lit("):** "), F.array_join(x["names"], ", "), F.lit("\n"))), "\n"),
        _section(c("types"), "## Exported Types by Category\n\n", F.transform("types", lambda x: F.concat(F.lit("**"), x["category"], F.lit(":** "), F.array_join(x["names"], ", "), F.lit("\n"))), "\n"),
        _section(c("test_files"), F.concat(F.lit("## Test Coverage\n\n"), number("test_files"), F.lit(" test files: ")), F.array(F.array_join("test_files", ", "))),
    ]
    enriched = F.concat(F.lit("\n---\n\n## Semantic Enrichment\n\n> *Last enriched: "), F.date_format("enriched_at", "yyyy-MM-dd HH:mm 'UTC'"), F.lit("*\n" + "\n".join(SNAPSHOT_LINES) + "\n"))
    return sections.select(*KEY, F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.coalesce(enriched, F.lit(""))).alias("markdown"))
