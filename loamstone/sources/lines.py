"""Extraction of rows from texts, line by line: sections, markers, owners, hunks, references, citations.

What a line means by itself is told by built-in expressions. Where it depends on the lines before it (a comment that is still open, the file
that a hunk belongs to), a text is read in one pass inside its row, by a small generator, so that no line is shuffled back to its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import patterns as P

#: Rows that leave a pass at a time.
PART_ROWS = 50_000


def lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no, line), counted from 1."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _passed(texts: DataFrame, key: str, text: str, read: Callable[[list[str]], Iterator[tuple]], ddl: str) -> DataFrame:
    """(key, ...) of what ``read`` yields for the lines of each text."""
    names = [key, *(c.split()[0] for c in ddl.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for k, whole in zip(frame[key], frame["_text"]):
                for row in read((whole or "").split("\n")):
                    rows.append((k, *row))
                    if len(rows) >= PART_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return texts.select(key, F.col(text).cast("string").alias("_text")).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, {ddl}")


def sections(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Sections under second-level headings; text before the first is 'Overview'; sections without text are left out.

    One text is split as a whole by an expression, without a shuffle of its lines.
    """
    marked = F.regexp_replace(F.concat(F.lit("## Overview\n"), F.coalesce(text, F.lit(""))), r"(?m)^## ", "\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    out = texts.select(key, F.posexplode(parts).alias("section_no", "part"))
    heading = F.trim(F.substring_index("part", "\n", 1))
    body = F.regexp_replace(F.when(F.instr("part", "\n") > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise(F.lit("")), r"^\s+|\s+\z", "")
    return out.select(key, "section_no", heading.alias("heading"), body.alias("body")).filter("body <> ''")


_COMMENT = re.compile(r"(?://|#).*$")
_COMMENT_SIGNS = re.compile(r"^(?://+|#+|/?\*+)\s*|\s*\*/\s*\Z", re.ASCII)
_MARKER = re.compile(P.MARKER, re.ASCII)


def _read_markers(rows: list[str]) -> Iterator[tuple]:
    depth = 0
    for number, line in enumerate(rows, 1):
        depth += "/*" in line
        found = line if depth > 0 else (m[0] if (m := _COMMENT.search(line)) else None)
        depth -= "*/" in line
        if found is not None:
            comment = _COMMENT_SIGNS.sub("", found.strip(" "))
            if m := _MARKER.search(comment):
                yield number, m[1].upper(), comment, P.MARKER_KINDS[m[1].upper()]


def markers(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """TODO-like markers in // and # comments and inside /* */ blocks."""
    return _passed(texts, key, text, _read_markers, "line_no int, marker string, comment string, kind string")


def code_owners(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(pattern, owner) of each rule; comments, empty lines and rules without owner give none."""
    rule = lines(texts, key, text).withColumn("line", F.trim(F.regexp_replace("line", r"\s*#.*$", ""))).withColumn("parts", F.split("line", r"\s+")).filter((F.col("line") != "") & (F.size("parts") >= 2))
    return rule.select(key, "line_no", F.col("parts")[0].alias("pattern"), F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("owner"))


def name_status(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Rows of a name-status listing: status letter, path, old path of renames and copies; other lines are errors."""
    parts = F.split("line", "\t")
    rows = lines(texts, key, text).filter(F.trim("line") != "").withColumn("parts", parts)
    letter = F.substring("line", 1, 1)
    moved = letter.isin("R", "C")
    sound = (letter.isin("A", "M", "D") & (F.size("parts") == 2)) | (moved & (F.size("parts") == 3))
    return rows.select(key, "line_no", F.when(sound, letter).alias("status"), F.when(sound, F.element_at("parts", -1)).alias("file"), F.when(sound & moved, F.col("parts")[1]).alias("old_file"), F.when(~sound, F.col("line")).alias("error"))


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.ASCII)
_OLD_FILE, _NEW_FILE = re.compile(r"^--- (?:a/)?(.+)$"), re.compile(r"^\+\+\+ (?:b/)?(.+)$")


def _read_hunks(rows: list[str]) -> Iterator[tuple]:
    old = new = None
    for number, line in enumerate(rows, 1):
        if m := _OLD_FILE.match(line):
            old = m[1]
        elif m := _NEW_FILE.match(line):
            new = m[1]
        elif m := _HUNK.match(line):
            counts = [int(m[k]) if m[k] is not None else default for k, default in ((1, 0), (2, 1), (3, 0), (4, 1))]
            yield number, old if new == "/dev/null" else new, *counts


def hunks(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(file, old_start, old_count, new_start, new_count) of a unified diff."""
    return _passed(texts, key, text, _read_hunks, "line_no int, file string, old_start int, old_count int, new_start int, new_count int")


def diff_errors(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(line_no, line) of hunk heads of a unified diff that cannot be read."""
    return lines(texts, key, text).filter(F.col("line").startswith("@@") & ~F.col("line").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"))


def references(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(name, is_package) that a document refers to: quoted identifiers, identifiers in prose, package paths.

    Link definitions give nothing, lines that open or close a fence no identifiers of prose, and lines with a URL no relative paths.
    """
    bare = F.btrim("line", F.lit(" \t\r\f\u000b"))
    plain = lines(texts, key, text).withColumn("bare", bare).filter(~(F.col("bare").startswith("[") & F.col("bare").contains("]:")))
    every = lambda p, g: F.regexp_extract_all("line", F.lit(P.java(p)), F.lit(g))
    none = F.array().cast("array<string>")
    quoted = F.filter(every(P.BACKTICK, 1), lambda n: (F.length(n) >= 2) & ~n.rlike("^v[0-9]"))
    prose = F.when(F.col("bare").startswith("```"), none).otherwise(F.filter(every(P.PROSE, 0), lambda n: F.length(n) >= 2))
    relative = F.filter(every(P.RELATIVE_PACKAGE, 1), lambda n: ~reduce(lambda a, b: a | b, [n.startswith(p) for p in P.NO_PACKAGE]))
    packages = F.concat(every(P.PACKAGE, 0), F.when(F.col("line").rlike(P.URL_LINE), none).otherwise(relative))
    tagged = lambda names, is_package: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(is_package).alias("is_package")))
    return plain.select(key, F.explode(F.concat(tagged(F.concat(quoted, prose), False), tagged(packages, True))).alias("r")).select(key, "r.*").distinct()


def key_terms(heading: Column, body: Column) -> Column:
    """Up to eight technical terms of a heading and the first 500 characters of its text, sorted."""
    text = F.concat(heading, F.lit(" "), F.substring(body, 1, 500))
    every = [F.regexp_extract_all(text, F.lit(P.java(p)), 1) for p in ("`([^`]+)`", *P.TERMS)]
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.concat(*every), lambda t: F.length(t) >= 2))), 1, 8)


def verifiable(path: str) -> bool:
    """Whether a path can be looked up: no URL, variable, pattern, ellipsis, branch name or pair of words."""
    low = path.lower()
    return "/" in path and len(path) >= 3 and not ("://" in path or "*" in path or "..." in path or path.startswith("$") or low.startswith(tuple(P.BRANCH_PREFIXES)) or low in P.SLASH_PAIRS)


_LINK, _QUOTED_PATH, _BARE_PATH, _GO_IMPORT = (re.compile(p, re.ASCII) for p in (P.LINK, P.QUOTED_PATH, P.BARE_PATH, P.GO_IMPORT))


def _read_context(rows: list[str]) -> Iterator[tuple]:
    fenced, seen = False, set()
    for number, line in enumerate(rows, 1):
        if line.strip(" ").startswith("```"):
            fenced = not fenced
        elif not fenced:
            said = _LINK.sub(r"\2", line)
            bare = [p for p in (m[1] or "" for m in _BARE_PATH.finditer(said)) if p.rpartition("/")[2].rpartition(".")[1] and p.rpartition(".")[2].lower() in P.CODE_EXTENSIONS]
            paths = [p for p in [*(m[1] or "" for m in _QUOTED_PATH.finditer(said)), *bare] if verifiable(p)]
            for found in [*(("file_path", p) for p in paths), *(("package_ref", m[1] or "") for m in _GO_IMPORT.finditer(line))]:
                if found not in seen:
                    seen.add(found)
                    yield *found, number


def context_claims(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(kind, value, line_no) that an instruction file claims: quoted paths, bare paths of code files, and Go imports; each once, at its
    first line. Fenced blocks are left out, and of a link only its target counts."""
    return _passed(texts, key, text, _read_context, "kind string, value string, line_no int")


def citations(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(repo, file, first, last) of the list links of an answer, each once, at its first place. A link to line 0 is none; an end before its begin is the begin."""
    # the separator cannot stand in a link
    rows = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(P.SOURCE_LINE), 2)).alias("place", "link")).filter(F.col("link").rlike(P.java(P.SOURCE_LINK)))
    part = lambda g: F.regexp_extract("link", P.java(P.SOURCE_LINK), g)
    first, last = part(3).try_cast("int"), F.nullif(part(4), F.lit("")).try_cast("int")
    out = rows.select(key, "place", part(1).alias("repo"), part(2).alias("file"), first.alias("first"), F.when(last >= first, last).otherwise(first).alias("last"))
    return out.filter("first > 0").groupBy(key, "repo", "file", "first", "last").agg(F.min("place").alias("place"))


def manifest_entries(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(repo, file, first, last, fuzzy) of an answer: its citations, or, where it has none, a fuzzy entry for each repository that its prose names."""
    cited = citations(texts, key, text).select(key, "repo", "file", "first", "last", F.lit(False).alias("fuzzy"))
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(P.java(P.REPO_MENTION)), F.lit(0)))
    prose = texts.join(cited.select(key).distinct(), key, "left_anti").select(key, F.explode(named).alias("repo"))
    none = F.lit(None)
    return cited.unionByName(prose.select(key, "repo", none.cast("string").alias("file"), none.cast("int").alias("first"), none.cast("int").alias("last"), F.lit(True).alias("fuzzy")))


_BLAMED = re.compile(r"^([0-9a-f]{40}) \d+ (\d+)", re.ASCII)


def _read_blame(rows: list[str]) -> Iterator[tuple]:
    commit, place, known = None, None, {}
    for line in rows:
        if line.startswith("\t"):
            if commit is not None:
                author, at = known.get(commit, (None, None))
                yield commit, place, author, at
        elif m := _BLAMED.match(line):
            commit, place = m[1], int(m[2])
        elif commit is not None:
            name, _, value = line.partition(" ")
            author, at = known.get(commit, (None, None))
            if name == "author-mail":
                known[commit] = re.sub("[<>]", "", value), at
            elif name == "author-time" and value.lstrip("-").isdecimal():
                known[commit] = author, int(value)


def blame_lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(line, commit, author, at) of a porcelain listing; a commit's header comes once and holds for its later lines."""
    return _passed(texts, key, text, _read_blame, "commit string, line int, author string, at long")


def log_entries(texts: DataFrame, key: str = "path", text: str = "text", end: str = "---END---") -> DataFrame:
    """(sha, author, at, subject, message) of a log whose entries end with a marker line."""
    entries = texts.select(key, F.posexplode(F.split(text, end)).alias("entry_no", "entry")).withColumn("p", F.split(F.regexp_replace("entry", r"^\s+", ""), "\n", 5)).filter(F.size("p") >= 4)
    return entries.select(key, "entry_no", F.col("p")[0].alias("sha"), F.col("p")[1].alias("author"), F.col("p")[2].alias("at"), F.col("p")[3].alias("subject"), F.regexp_replace(F.coalesce(F.get("p", F.lit(4)), F.lit("")), r"^\s+|\s+\z", "").alias("message"))


#: What a claim's columns may hold.
KINDS = ("type", "func", "const", "var", "method", "interface", "module", "field", "enum", "file", "package")
VISIBILITIES = ("public", "internal", "private")
TIERS = ("structural", "semantic", "meta")


def validation_error(claim: dict[str, Column], predicates: tuple[str, ...], kinds: tuple[str, ...] = KINDS, tiers: tuple[str, ...] = TIERS) -> Column:
    """The first of thirteen rules that a claim breaks, or null. ``claim`` maps the names of its parts to columns."""
    empty = lambda c: F.coalesce(claim[c].cast("string"), F.lit("")) == ""
    outside = lambda c, allowed: ~F.coalesce(claim[c].isin(*allowed), F.lit(False))
    rules = [(empty(c), f"{c} is required") for c in ("subject_repo", "subject_import_path", "subject_name", "language")]
    rules += [(outside("kind", kinds), "invalid kind"), (outside("visibility", VISIBILITIES), "invalid visibility"), (outside("predicate", predicates), "invalid predicate")]
    rules += [(empty("source_file"), "source_file is required"), (~F.coalesce(claim["confidence"].between(0, 1), F.lit(False)), "confidence must be in [0, 1]")]
    rules += [(outside("claim_tier", tiers), "invalid claim_tier")] + [(empty(c), f"{c} is required") for c in ("extractor", "extractor_version", "last_verified")]
    return F.coalesce(*[F.when(broken, message) for broken, message in rules])


_FUNCTION = re.compile(r"^func (?:\([^)]*\) )?([A-Za-z_][A-Za-z0-9_]*)")
_ASSERTION = re.compile(r"(?:^|[^A-Za-z0-9_])(require\.[A-Za-z]+|assert\.[A-Za-z]+|panic)\(")


def _read_invariants(rows: list[str]) -> Iterator[tuple]:
    function = None
    for number, line in enumerate(rows, 1):
        if m := _FUNCTION.match(line):
            function = m[1]
        m = _ASSERTION.search(line)
        if "//nolint" in line or m:
            yield number, "nolint" if "//nolint" in line else m[1].partition(".")[0], function, line.strip(" ")


def invariants(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Statements that something must hold (assertions, panics, lint exceptions) with the last function begun before them; for the innermost
    declaration around them, join with ``operators.ownership.innermost``."""
    return _passed(texts, key, text, _read_invariants, "line_no int, form string, function string, statement string")


def manifest_of(paths: DataFrame) -> DataFrame:
    """(doc, pattern): each Markdown file watches the code of its folder, by extension."""
    placed = paths.withColumn("folder", F.regexp_replace("path", "[^/]*$", "")).withColumn("extension", F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    docs = placed.filter("extension = 'md'").select("folder", F.col("path").alias("doc"))
    code = placed.filter(F.col("extension").isin("go", "py", "ts", "tsx", "sh")).select("folder", "extension").distinct()
    return docs.join(code, "folder").select("doc", F.concat("folder", F.lit("*."), "extension").alias("pattern"))
