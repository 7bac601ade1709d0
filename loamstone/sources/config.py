"""Tables from configuration files: newline-delimited JSON, and the indented lists and maps of document maps, manifests and schedules.

Files are read by Spark, one row per file or line, and nothing is dropped: what cannot be read is a row with its reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable lines) of newline-delimited JSON; an empty line is neither."""
    wanted = StructType.fromDDL(schema).add("_corrupt", "string")
    read = spark.read.text(path).filter(F.trim("value") != "")
    parsed = read.select("value", F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    whole = F.col("r._corrupt").isNull()
    return parsed.filter(whole).select("r.*").drop("_corrupt"), parsed.filter(~whole).select(F.col("value").alias("line"))


_ENTRY = re.compile(r"(?P<indent> *)(?P<dash>- +)?(?:(?P<key>[A-Za-z_][\w-]*):(?: +(?P<value>.*))?|(?P<item>.+))\Z")


def _scalar(text: str | None) -> str:
    text = (text or "").strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    return re.sub(r"\s+#.*\Z", "", text)


def entries(text: str) -> Iterator[tuple[int, list[tuple[str, int]], str]]:
    """(line, path, value) of every scalar: the path is a list of (key, number of the list entry), one for each level.

    The form is the one that document maps and schedules are written in: maps of scalars, maps and lists, two or more spaces to a level, no
    anchors and no text blocks. Raises ValueError at the first line of another form."""
    stack: list[list] = []  # [indent, key, entries so far]
    for number, raw in enumerate(text.split("\n"), 1):
        if not raw.strip() or raw.lstrip().startswith("#") or raw.strip() == "---":
            continue
        m = _ENTRY.match(raw.rstrip())
        if m is None or "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise ValueError(f"line {number}: {raw.strip()[:80]}")
        indent = len(m["indent"])
        if m["dash"]:
            # an entry belongs to the key above it, at the same depth or further left
            while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and stack[-1][3])):
                stack.pop()
            if not stack:
                raise ValueError(f"line {number}: a list without a name")
            stack[-1][2] += 1
            indent += len(m["dash"])
        else:
            while stack and stack[-1][0] >= indent:
                stack.pop()
        path = [(s[1], s[2]) for s in stack]
        if m["key"] is None:
            if not m["dash"]:
                raise ValueError(f"line {number}: {raw.strip()[:80]}")
            yield number, path, _scalar(m["item"])
        elif _scalar(m["value"]):
            yield number, [*path, (m["key"], 0)], _scalar(m["value"])
        else:
            stack.append([indent, m["key"], 0, bool(m["dash"])])


def config_entries(files: DataFrame) -> DataFrame:
    """(path, line, keys, places, value, error) of (path, text) files: a row for each scalar, or one that says why a file cannot be read.

    ``keys`` are the names above a value joined by dots, ``places`` the numbers of the list entries it is in, by level."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, text in zip(frame["path"], frame["text"]):
                try:
                    rows += [(path, line, ".".join(k for k, _ in way), [n for _, n in way], value, None) for line, way, value in entries(text or "")]
                except ValueError as error:
                    rows.append((path, None, None, None, None, str(error)))
            out = pd.DataFrame(rows, columns=["path", "line", "keys", "places", "value", "error"])
            yield out.astype({"line": "Int32"})

    return files.select("path", "text").mapInPandas(run, "path string, line int, keys string, places array<int>, value string, error string")


def _records(found: DataFrame, prefix: str, fields: list[str], level: int) -> DataFrame:
    """A row per list entry at a level, with its scalar fields."""
    own = F.slice("places", 1, level)
    rows = found.filter(F.col("keys").isin(*[f"{prefix}.{f}" for f in fields])).withColumn("_at", own)
    return rows.groupBy("path", "_at").agg(*[F.max(F.when(F.col("keys") == f"{prefix}.{f}", F.col("value"))).alias(f) for f in fields])


def document_map(files: DataFrame) -> DataFrame:
    """(path, repo, short, glob, doc): which documents a repository's sources matter for."""
    found = config_entries(files).filter("error is null")
    repos = _records(found, "repos", ["name", "short"], 1).select("path", F.col("_at").alias("_repo"), F.col("name").alias("repo"), "short")
    maps = _records(found, "repos.mappings", ["source"], 2).select("path", F.col("_at").alias("_map"), F.slice("_at", 1, 1).alias("_repo"), F.col("source").alias("glob"))
    docs = found.filter("keys = 'repos.mappings.docs'").select("path", F.slice("places", 1, 2).alias("_map"), F.col("value").alias("doc"))
    return repos.join(maps, ["path", "_repo"]).join(docs, ["path", "_map"]).select("path", "repo", "short", "glob", "doc")


def manifest(files: DataFrame) -> DataFrame:
    """(path, glob, doc) of a repository's own manifest."""
    found = config_entries(files).filter("error is null")
    maps = _records(found, "mappings", ["source"], 1).select("path", F.col("_at").alias("_map"), F.col("source").alias("glob"))
    docs = found.filter("keys = 'mappings.docs'").select("path", F.slice("places", 1, 1).alias("_map"), F.col("value").alias("doc"))
    return maps.join(docs, ["path", "_map"]).select("path", "glob", "doc")


SCHEDULE = "repo string, cron string, source string, data_dir string, concurrency int"


def schedules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(schedules, unreadable lines) of a file with one JSON object a line; one without repo or cron is unreadable too."""
    rows, broken = json_lines(spark, path, SCHEDULE)
    sound = (F.coalesce(F.col("repo"), F.lit("")) != "") & (F.coalesce(F.col("cron"), F.lit("")) != "")
    return rows.filter(sound), broken.unionByName(rows.filter(~sound).select(F.to_json(F.struct("*")).alias("line")))
