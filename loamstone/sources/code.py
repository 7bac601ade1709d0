"""Structural claims and declarations from source files. Python is parsed; Go, TypeScript and shell are read by a lexer (``lexing``).

Files of other languages, and Python files that do not parse, give one row with the predicate ``unparsed``: nothing is dropped silently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexing

CLAIMS = "path string, language string, symbol_name string, kind string, predicate string, object_text string, line int, confidence double"
DECLARATIONS = "path string, language string, name string, kind string, owner string, line int, end_line int, doc string"
#: Predicates that a parser without types may state.
SAFE = ("defines", "imports", "exports", "has_doc", "is_test", "is_generated")
DOC_CONFIDENCE = 0.85
_LANGUAGES = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".sh": "shell", ".bash": "shell"}
#: Bytes of text that are turned into rows at a time.
PART_BYTES = 4 << 20
_TESTS = {"python": r"(^|/)test_[^/]*\.py$|_test\.py$", "go": r"_test\.go$", "typescript": r"\.(test|spec)\.tsx?$", "shell": r"(?!)"}


def language_of(path: str) -> str | None:
    return next((v for k, v in _LANGUAGES.items() if path.endswith(k)), None)


def claims_of(path: str, text: str) -> list[tuple]:
    """(symbol, kind, predicate, object, line, confidence) of one file."""
    language = language_of(path)
    if language is None:
        return [(path, "file", "unparsed", None, 1, 1.0)]
    out: list[tuple] = []
    try:
        for d in lexing.declarations(text, language):
            out.append((d.name, d.kind, "defines", None, d.line, 1.0))
            if d.doc:
                out.append((d.name, d.kind, "has_doc", d.doc, d.line, DOC_CONFIDENCE))
        out += [(name, "module", "imports", name, line, 1.0) for name, line in lexing.imports(text, language)]
    except SyntaxError:
        return [(path, "file", "unparsed", None, 1, 1.0)]
    if language == "typescript":
        out += [(name, "symbol", "exports", None, line, 1.0) for name, line in lexing.exports(text)]
    if re.search(_TESTS[language], path):
        out.append((path, "file", "is_test", None, 1, 1.0))
    if re.match(r"\s*(//|#|/\*).*\bgenerated\b.*", text, re.IGNORECASE):
        out.append((path, "file", "is_generated", None, 1, 1.0))
    return out


def declarations_of(path: str, text: str) -> list[tuple]:
    """(name, kind, owner, line, end_line, doc) of one file; none where it cannot be read."""
    language = language_of(path)
    if language is None:
        return []
    try:
        return [(d.name, d.kind, d.owner, d.line, d.end_line, d.doc) for d in lexing.declarations(text, language)]
    except SyntaxError:
        return []


def beyond_tier(claims: DataFrame, safe: tuple[str, ...] = SAFE) -> DataFrame:
    """Claims that an extractor without types may not make; ``unparsed`` rows are no claims."""
    return claims.filter(~F.col("predicate").isin(*safe, "unparsed"))


def within_tier(claims: DataFrame, safe: tuple[str, ...] = SAFE) -> DataFrame:
    """The same claims; the job fails at the first one that is beyond the tier."""
    message = F.concat(F.lit("predicate beyond the tier: "), F.col("predicate"), F.lit(" of "), F.col("symbol_name"))
    allowed = F.col("predicate").isin(*safe, "unparsed")
    return claims.withColumn("predicate", F.when(allowed, F.col("predicate")).otherwise(F.raise_error(message)))


#: A reader of a language: (symbol, kind, predicate, object, line, confidence) of a text.
Reader = Callable[[str], Iterable[tuple]]


def _by_file(files: DataFrame, of: Callable[[str, str], list[tuple]], ddl: str, language: Callable[[str], str | None] = language_of) -> DataFrame:
    """Rows of every (path, text) file, with its repo in front if it has one; rows leave in parts, so that a batch of long files stays small."""
    lead = ["repo"] if "repo" in files.columns else []
    names = lead + [c.split()[0] for c in ddl.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            size = 0
            for *repo, path, text in frame.itertuples(index=False):
                rows += [(*repo, path, language(path), *row) for row in of(path, text or "")]
                size += len(text or "")
                if size >= PART_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select(*lead, "path", "text").mapInPandas(run, "repo string, " * len(lead) + ddl)


def extract(files: DataFrame, readers: dict[str, tuple[str, Reader]] | None = None) -> DataFrame:
    """Claims of (path, text) or (repo, path, text) files.

    ``readers`` adds languages, or replaces built-in ones: {ending: (language, reader)}, the longest ending first. A file that its reader cannot read
    is ``unparsed``, and claims beyond the tier fail the job, whoever made them."""
    added = sorted((readers or {}).items(), key=lambda r: -len(r[0]))

    def find(path: str) -> tuple[str, Reader] | None:
        return next((found for ending, found in added if path.endswith(ending)), None)

    def claims(path: str, text: str) -> list[tuple]:
        if (found := find(path)) is None:
            return claims_of(path, text)
        try:
            return list(found[1](text))
        except Exception:  # noqa: BLE001 - whatever an added reader raises, the file is named as unread
            return [(path, "file", "unparsed", None, 1, 1.0)]

    def language(path: str) -> str | None:
        found = find(path)
        return found[0] if found else language_of(path)

    return within_tier(_by_file(files, claims, CLAIMS, language))


def declarations(files: DataFrame) -> DataFrame:
    """What (path, text) or (repo, path, text) files declare, with line ranges, owners and the first line of each doc comment."""
    return _by_file(files, declarations_of, DECLARATIONS)
