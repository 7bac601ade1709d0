"""Patterns and prefixes from tables, joined with paths by equality: no path is tried against all patterns.

A glob is filed under the folder that its literal start names and under its literal ending, if it has one; a path asks for all its
folders with both. Only the pairs that meet are tried in full. A prefix is met by the path's own prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import text as T

_WILD = re.compile(r"[*?\[]")


def filed(glob: str, doublestar: bool) -> tuple[str, str, str]:
    """(folder, ending, pattern): the literal folder that all matches lie in, the extension that all have ('' for none), and the whole pattern."""
    wild = _WILD.search(glob)
    start = glob[: wild.start()] if wild else glob
    tail = re.search(r"\.[A-Za-z0-9]+\Z", glob)
    return start.rpartition("/")[0], tail[0] if tail else "", T.glob_pattern(glob, doublestar)


def glob_index(globs: DataFrame, doublestar: bool = False) -> DataFrame:
    """Rows with a column ``glob`` and where each is filed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(g, *filed(g, doublestar)) for g in frame["glob"]], columns=["glob", "_folder", "_ending", "_pattern"])

    each = globs.select("glob").filter("glob is not null").distinct().mapInPandas(run, "glob string, _folder string, _ending string, _pattern string")
    return globs.join(each.hint("merge"), "glob")  # a table of patterns may be large, and its size is only estimated


def ancestors(path: Column, whole: bool = False) -> Column:
    """The folders above a path, '' among them; with ``whole`` the path itself too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - (0 if whole else 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def glob_join(paths: DataFrame, globs: DataFrame, doublestar: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``paths`` (path, ...) and ``globs`` (glob, ...) where the glob fits the path, with equal columns ``on``."""
    ending = F.regexp_extract("path", r"(\.[A-Za-z0-9]+)\z", 1)
    asked = paths.withColumn("_folder", F.explode(ancestors(F.col("path")))).withColumn("_ending", F.explode(F.array_distinct(F.array(F.lit(""), ending))))
    met = asked.join(glob_index(globs, doublestar).hint("merge"), [*on, "_folder", "_ending"])
    return met.filter(F.expr("path rlike _pattern")).drop("_folder", "_ending", "_pattern")


def manifest_docs(changed: DataFrame, manifest: DataFrame, doublestar: bool = False) -> DataFrame:
    """(path, doc) that a manifest table (glob, doc) ties to changed paths, each once."""
    return glob_join(changed.select("path").distinct(), manifest.select("glob", "doc").distinct(), doublestar).select("path", "doc").distinct()


def replaced_paths(paths: DataFrame, directives: DataFrame) -> DataFrame:
    """Module of each (path) by directives (old, new): an exact one, else the longest prefix that ends at a slash, else the path without version."""
    asked = paths.select("path").distinct().select("path", F.explode(F.filter(ancestors(F.col("path"), True), lambda p: p != "")).alias("old"))
    met = asked.join(directives.filter("old <> ''").select("old", "new"), "old")
    best = met.groupBy("path").agg(F.max(F.struct(F.length("old").alias("n"), "new")).alias("b"))
    module = F.concat(F.col("b.new"), F.substr(F.col("path"), F.col("b.n") + 1))
    return paths.join(best, "path", "left").withColumn("module", F.coalesce(module, T.strip_version(F.col("path")))).drop("b")


def original_paths(modules: DataFrame, directives: DataFrame) -> DataFrame:
    """The way back: the path that each (module) replaces, or null where no directive names it."""
    back = replaced_paths(modules.withColumnRenamed("module", "path"), directives.select(F.col("new").alias("old"), F.col("old").alias("new")))
    found = F.col("module") != T.strip_version(F.col("path"))
    return back.select(F.col("path").alias("module"), F.when(found, F.col("module")).alias("path"))
