"""The claims model over the driver's tables: each view is declared once and rendered for Spark and for the oracle.

An expression uses ``{sha:x}`` for a sha256 hex digest, ``{ymd:t}`` for a date as yyyyMMdd, ``{day:d;n}`` for a date plus n days, and
``{int:x}`` for truncation; everything else is common to both dialects.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPELLED: dict[str, dict[str, Callable[..., str]]] = {
    "spark": {
        "sha": lambda x: f"sha2({x}, 256)",
        "ymd": lambda t: f"date_format({t}, 'yyyyMMdd')",
        "day": lambda d, n: f"date_add(date '{d}', cast({n} as int))",
        "int": lambda x: f"cast(floor({x}) as bigint)",
        "ts": lambda x: f"cast({x} as timestamp)",
    },
    "duckdb": {
        "sha": lambda x: f"sha256({x})",
        "ymd": lambda t: f"strftime({t}, '%Y%m%d')",
        "day": lambda d, n: f"(date '{d}' + cast({n} as int))",
        "int": lambda x: f"cast(floor({x}) as bigint)",
        "ts": lambda x: f"cast({x} as timestamp)",
    },
}


def spelled(sql: str, dialect: str) -> str:
    by = _SPELLED[dialect]
    return re.sub(r"\{(\w+):([^{}]*)\}", lambda m: by[m[1]](*m[2].split(";")), sql)


def _labels(column: str, names: list[str], first: int = 0) -> str:
    return "case " + " ".join(f"when {column} = {k + first} then '{n}'" for k, n in enumerate(names)) + " end"


#: name: (source, condition, columns)
VIEWS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "symbols": (
        "part",
        None,
        {
            "id": "p_partkey",
            "repo": "concat('repo', p_partkey % 5)",
            "import_path": "p_brand",
            "symbol_name": "concat(p_name, ' ', p_partkey)",
            "language": _labels("p_partkey % 4", ["go", "python", "typescript", "shell"]),
            "kind": _labels("p_size % 6", ["type", "func", "const", "var", "method", "interface"]),
            "visibility": "case when p_size % 5 = 0 then 'internal' else 'public' end",
            "file_path": "concat('file_', p_partkey % 100)",
        },
    ),
    "claims": (
        "lineitem",
        None,
        {
            "claim_key": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', {int:l_quantity}, '-', {ymd:l_shipdate})",
            "subject_id": "l_partkey",
            "predicate": _labels("l_linenumber", ["defines", "imports", "exports", "has_doc", "has_kind", "implements", "purpose"], 1),
            "object_text": "case when l_linenumber = 2 then concat('Brand#', 1 + l_suppkey % 25) when l_linenumber in (4, 7) then concat(l_returnflag, l_linestatus) end",
            "source_file": "concat('file_', l_suppkey)",
            "source_line": "{int:l_quantity}",
            "confidence": "1.0e0 - l_discount",
            "claim_tier": "case when l_linenumber = 7 then 'semantic' else 'structural' end",
            "extractor": "concat('ex-', l_returnflag)",
            "last_verified": "{ts:l_shipdate}",
        },
    ),
    "source_files": (
        "supplier",
        None,
        {
            "repo": "concat('repo', s_suppkey % 5)",
            "relative_path": "concat('file_', s_suppkey)",
            "content_hash": "{sha:s_name}",
            "size_bytes": "100 + s_suppkey % 50",
            "last_indexed": "{day:2000-01-01;s_suppkey}",
            "deleted": "s_suppkey % 17 = 0",
            "never_mined": "s_nationkey % 3 = 0",
        },
    ),
    "changes": (
        "orders",
        None,
        {
            "change_id": "o_orderkey",
            "repo": "concat('repo', o_custkey % 5)",
            "path": "concat('file_', o_custkey % 100)",
            "status": "case o_orderstatus when 'F' then 'M' when 'O' then 'A' else 'D' end",
            "old_start": "1 + o_orderkey % 50",
            "old_count": "o_orderkey % 4",
            "new_start": "1 + o_orderkey % 50",
            "new_count": "1 + o_orderkey % 3",
            "changed_at": "{ts:o_orderdate}",
        },
    ),
    "facts": (
        "documents left join labels using (doc_id)",
        None,
        {
            "id": "doc_id",
            "subject_id": "3 * doc_id",
            "kind": _labels("doc_id % 6", ["ownership", "rationale", "invariant", "quirk", "todo", "deprecation"]),
            "body": "text",
            "source_quote": "substring(text, 1, 80)",
            "confidence": "(50 + doc_id % 50) / 100.0e0",
            "corroboration": "1 + doc_id % 4",
            "model": "case when doc_id % 3 = 0 then '' else 'm1' end",
            "staleness_hash": "{sha:text}",
            "status": "case when toxic = 1 then 'quarantined' when quality = 0 then 'stale' else 'active' end",
            "last_verified": "{day:2024-01-01;doc_id % 60}",
            "ord": "doc_id",
        },
    ),
    "evidence": (
        "conversations c join documents d on c.conv_id = d.doc_id",
        None,
        {
            "fact_id": "c.conv_id",
            "source_type": "case c.role when 'user' then 'pr_comment' when 'assistant' then 'commit_msg' else 'runbook' end",
            "source_ref": "concat(c.conv_id, ':', c.turn % 3)",
            "content_hash": "case when c.turn % 4 <> 3 then {sha:d.text} else {sha:c.text} end",
            "ord": "c.turn",
        },
    ),
    "feedback": ("events", "event_type <> 'purchase'", {"fact_id": "user_id", "reason": "case event_type when 'error' then 'wrong' when 'view' then 'stale' when 'click' then 'misleading' else 'offensive' end"}),
    "corrections": ("events", None, {"fact_id": "user_id", "action": _labels("event_id % 3", ["correct", "delete", "supersede"]), "ord": "event_id", "new_body": "concat('body ', event_id)"}),
    "tool_calls": ("events", None, {"call_id": "event_id", "tool": "event_type", "session": "user_id", "repo": "concat('repo', user_id % 5)", "path": "concat('file_', event_id % 100)", "ts": "{ts:ts}"}),
    "blame": ("lineitem", None, {"file": "concat('file_', l_suppkey)", "line": "{int:l_quantity}", "author": "concat('user', l_orderkey % 20)", "commit": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', {int:l_quantity}, '-', {ymd:l_shipdate})", "at": "{ts:l_shipdate}"}),
    "doc_manifests": (
        "documents cross join (select 0 as k union all select 1 union all select 2)",
        None,
        {
            "entry_id": "3 * doc_id + k",
            "doc_id": "doc_id",
            "pos": "k",
            "repo": "concat('repo', doc_id % 5)",
            "symbol_id": "case when (doc_id + k) % 7 <> 0 then (7 * doc_id + k) * 2 end",
            "file": "case when (doc_id + k) % 3 = 0 then '' else concat('file_', doc_id % 100) end",
            "start_line": "doc_id % 400",
            "end_line": "doc_id % 400 + 5 * k",
            "fuzzy": "doc_id % 11 = 0",
            "signature": "case when (doc_id + k) % 2 = 0 then 'even' when doc_id % 13 = 0 then '' else 'odd' end",
            "content": "concat('c', (doc_id + k) % 3)",
        },
    ),
    "documents_kept": ("documents", None, {"doc_id": "doc_id", "max_age_days": "doc_id % 40", "last_refreshed": "{day:2024-01-01;doc_id % 60}"}),
    "placed_symbols": (
        "part",
        None,
        {
            "symbol_id": "p_partkey",
            "repo": "concat('repo', p_partkey % 5)",
            "file": "concat('file_', p_partkey % 100)",
            "start_line": "p_partkey * 3 % 390",
            "end_line": "p_partkey * 3 % 390 + p_size % 9",
            "signature": "case when p_partkey % 3 = 0 then 'even' else 'odd' end",
            "content": "concat('c', p_partkey % 3)",
        },
    ),
    "readmes": (
        "part",
        None,
        {
            "path": "concat('pkg', p_partkey, '/README.md')",
            "text": "concat('# ', p_name, chr(10), 'Call `New', p_partkey, 'Store` before store.Open', p_size, ' or parseJSON', p_size % 3, '.', chr(10), 'The ConfigMap and my_handler_', p_size % 5, "
            "' live in tools/cache', p_size % 4, ' and `sub/dir', p_size % 3, '`, see k8s.io/api/core.', chr(10), '[ref]: https://example.com/NotSeen', chr(10), '```', chr(10), '    inFence', p_size, chr(10), "
            "'```', chr(10), 'Read `v1.2` and https://x.org/not/this.', chr(10), '## Usage', chr(10), 'Run `Store', p_size % 7, '.Close` when done.', chr(10), '## Empty', chr(10), '## Limits of ', p_type, chr(10), "
            "'None for ', p_brand, '.', chr(10))",
        },
    ),
    "sources": (
        "part",
        None,
        {
            "path": "case p_partkey % 4 when 0 then concat('pkg', p_partkey, '/a.go') when 1 then concat('pkg', p_partkey - 1, '/lib.py') when 2 then concat('pkg', p_partkey, '/mod.ts') "
            "else concat('pkg', p_partkey - 1, '/tools/cache', p_size % 4, '/a_test.go') end",
            "text": "case p_partkey % 4 when 0 then concat('package p', chr(10), '// TODO: split file ', p_size, chr(10), 'func New', p_partkey, 'Store() {}', chr(10), 'func (s *Store', p_size % 7, "
            "') Close() error { return nil } // nothing', chr(10), 'func hidden() { panic(1) }', chr(10), 'type ConfigMap struct', chr(10), 'var (', chr(10), chr(9), 'Default', p_size, ' = 1', chr(10), chr(9), 'small = 2', chr(10), "
            "')', chr(10), 'const A', p_size, ', B', p_size, ' = 1, 2', chr(10), '/* HACK around', chr(10), '   the cache', chr(10), '   NOTE: keep in step ', p_size, chr(10), '*/', chr(10)) "
            "when 1 then concat('import os', chr(10), '# FIXME later ', p_brand, chr(10), 'def parseJSON', p_size % 3, '(x):', chr(10), '    pass', chr(10), 'async def my_handler_', p_size % 5, '():', chr(10), "
            "'    return 1  # xxx: lower', chr(10), 'class _Private:', chr(10), '    pass', chr(10), 'class Widget', p_partkey, ':', chr(10), '    def method(self):', chr(10), '        pass', chr(10), 'MAX_', p_size, ' = 3', chr(10), "
            "'limit: int = 4', chr(10)) when 2 then concat('export function run', p_size, '() {}', chr(10), 'export const limit', p_size, ' = 1;', chr(10), 'export { first', p_size, ', second as third };', chr(10), "
            "'interface Local {}', chr(10), 'export default class Main', p_size, ' {}', chr(10), 'export type T', p_size, ' = string; // WHY not', chr(10)) else concat('func NewTest', p_size, '() {}', chr(10)) end",
        },
    ),
    "repo_files": (
        "supplier",
        None,
        {
            "repo": "concat('repo', {int:s_suppkey / 10})",
            "relative_path": "concat('file_', s_suppkey % 10)",
            "last_indexed": "{day:1992-01-01;s_suppkey}",
            "deleted": "s_suppkey % 17 = 0",
            "never_mined": "s_nationkey % 3 = 0",
        },
    ),
    "repo_claims": (
        "lineitem",
        None,
        {
            "repo": "concat('repo', {int:l_suppkey / 10})",
            "source_file": "concat('file_', l_suppkey % 10)",
            "subject_id": "l_partkey",
            "predicate": "case when l_linenumber = 2 then 'imports' else 'defines' end",
            "object_text": "case when l_linenumber = 2 then concat('Brand#', 1 + l_suppkey % 25) end",
            "claim_tier": "case when l_linenumber = 7 then 'semantic' else 'structural' end",
            "last_verified": "{ts:l_shipdate}",
        },
    ),
    "page_claims": (
        "lineitem",
        None,
        {
            "claim_key": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', {int:l_quantity}, '-', {ymd:l_shipdate})",
            "subject_id": "l_partkey",
            "predicate": _labels("l_linenumber", ["has_kind", "imports", "exports", "encloses", "is_test", "implements", "purpose"], 1),
            "object_text": "case l_linenumber when 1 then case l_suppkey % 4 when 0 then 'interface' when 1 then 'constructor' when 2 then 'utility' else '' end when 2 then concat('Brand#', 1 + l_suppkey % 25) "
            "when 3 then case when l_suppkey % 2 = 0 then concat('reverse_dep:Brand#', 1 + l_suppkey % 25) else 'x' end when 4 then concat('M', l_suppkey % 6) when 5 then case when l_suppkey % 2 = 0 then 'true' else 'false' end "
            "when 6 then concat('S', 1 + l_partkey * 7 % 200) end",
            "source_file": "concat('file_', l_suppkey, case when l_suppkey % 3 = 0 then '_test.go' else '.go' end)",
            "source_line": "{int:l_quantity}",
            "claim_tier": "case when l_linenumber = 7 then 'semantic' else 'structural' end",
            "last_verified": "{ts:l_shipdate}",
        },
    ),
    "snippets": (
        "part",
        None,
        {
            "path": "concat('s', p_partkey, case p_partkey % 3 when 0 then '/n.go' when 1 then '/n.ts' else '/n.sh' end)",
            "text": "case p_partkey % 3 when 0 then concat('package p', chr(10), chr(10), '// Doc of Outer', p_partkey, '.', chr(10), 'func Outer', p_partkey, '(f func(int) interface{}) error {', chr(10), chr(9), 's := ', chr(96), "
            "'func Fake() {', chr(10), chr(96), ' + \"}\" // func Not() {', chr(10), chr(9), '/* type Gone struct {', chr(10), chr(9), '} */', chr(10), chr(9), 'g := func() { panic(\"}\") }', chr(10), chr(9), 'return g(s)', chr(10), '}', chr(10), chr(10), "
            "'type T', p_size, ' struct {', chr(10), chr(9), 'a map[string]struct{}', chr(10), '}', chr(10), chr(10), 'func (t *T', p_size, ') Do() { panic(t) }', chr(10)) "
            "when 1 then concat('export class A', p_partkey, ' {', chr(10), '  run(x: string) {', chr(10), '    return ', chr(96), 'class Fake { ', chr(36), '{ [1].map((n) => { return \"}\"; }) } }', chr(96), ';', chr(10), '  }', chr(10), '}', chr(10), "
            "'// function hidden() {}', chr(10), 'function outer', p_partkey, '() {', chr(10), '  function inner() { return /[{]/; }', chr(10), '}', chr(10), 'enum E', p_size, ' { X }', chr(10)) "
            "else concat('# Starts ', p_partkey, '.', chr(10), 'start', p_partkey, '() {', chr(10), '  echo \"fake() {\" # other() {', chr(10), '  cat <<EOF', chr(10), 'notes() {', chr(10), 'EOF', chr(10), '}', chr(10), '. lib', p_size, '.sh', chr(10)) end",
        },
    ),
    "contexts": (
        "part",
        None,
        {
            "path": "concat('svc', p_partkey, '/AGENTS.md')",
            "text": "concat('Edit `./src/main', p_size % 9, '.go` and `docs/guides/a', p_size, '.md`.', chr(10), '```', chr(10), '`not/seen.go`', chr(10), '```', chr(10), 'See [the `text/of.go` guide](../svc', p_size, '/AGENTS.md), "
            "`lib/util', p_partkey % 3, '.py`, read/write, `feature/x`, `glob/*.go` and `svc', p_size, '/`.', chr(10), 'Run lib/util', p_size % 5, '.py, gone/away.xyz and src/main', p_size % 9, '.go: `github.com/o/r', p_size % 4, "
            "'/p`.', chr(10), 'Beside: `lib/util', p_partkey % 3, '.py` `deep/util0.py`', chr(10))",
        },
    ),
    "tree": (
        "part",
        None,
        {"path": "case p_partkey % 3 when 0 then concat('src/main', p_size % 7, '.go') when 1 then concat('svc', p_partkey, '/lib/util', p_size % 3, '.py') else concat('a', p_partkey, '/deep/util', p_size % 2, '.py') end"},
    ),
    "owner_files": (
        "part",
        None,
        {"path": "concat('o', p_partkey)", "text": "concat('# owners ', p_name, chr(10), '*.go @core @infra', p_size, chr(10), '/docs/ @writers # prose', chr(10), chr(10), '/alone', p_size, '/', chr(10), '  a/b', p_partkey % 3, '   @x  @y', chr(10))"},
    ),
    "diffs": (
        "part",
        None,
        {
            "path": "concat('d', p_partkey)",
            "text": "concat('diff --git a/a', p_size, '.go b/a.go', chr(10), '--- a/a', p_size, '.go', chr(10), '+++ b/a', p_partkey, '.go', chr(10), '@@ -', p_size, ',3 +', p_size, ',4 @@ func f()', chr(10), ' x', chr(10), '@@ -20 +', 21 + p_size, "
            "',2 @@', chr(10), '+@@ -1 +1 @@', chr(10), '@@ -', p_size, ' broken @@', chr(10), '--- a/gone', p_size, '.go', chr(10), '+++ /dev/null', chr(10), '@@ -1,', p_size, ' +0,0 @@', chr(10))",
        },
    ),
    "answers": (
        "part",
        None,
        {
            "path": "concat('q', p_partkey)",
            "text": "concat('Answer.', chr(10), chr(10), '## Sources', chr(10), '- [a](/host/org/repo', p_size % 3, '/-/blob/pkg/a', p_size, '.go?L10-', 10 + p_size, ')', chr(10), '- [b](/host/org/repo/-/blob/b.go?rev=1&L', p_size, ')', chr(10), "
            "'- [again](/host/org/repo', p_size % 3, '/-/blob/pkg/a', p_size, '.go?L10-', 10 + p_size, ')', chr(10), '- [no](https://example.com)', chr(10))",
        },
    ),
}

#: Rows of a table whose columns are made into texts in one task; a file of short rows is read by few tasks, and its texts are a hundred times larger.
TEXT_ROWS = 10_000

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Model:
    """The views of one data directory, as DataFrames: ``Model(spark, dir).claims``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tasks: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _text_tasks(self, source: str) -> int:
        if source not in self._tasks:
            self._tasks[source] = max(1, -(-self.table(source).count() // TEXT_ROWS))
        return self._tasks[source]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source, condition, columns = VIEWS[name]
        if name == "facts":
            df = self.table("documents").join(self.table("labels"), "doc_id", "left")
        elif name == "evidence":
            df = self.table("conversations").alias("c").join(self.table("documents").alias("d"), F.expr("c.conv_id = d.doc_id"))
        elif name == "doc_manifests":
            df = self.table("documents").select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
        else:
            df = self.table(source)
        if source == "part" and "text" in columns:
            df = df.repartition(self._text_tasks(source), "p_partkey")
        if condition:
            df = df.filter(spelled(condition, "spark"))
        return df.select(*[F.expr(spelled(e, "spark")).alias(c) for c, e in columns.items()])


def oracle(sql: str) -> str:
    """``sql`` in the oracle's dialect, with a WITH clause of the views it names."""
    sql = spelled(sql, "duckdb")
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    clauses = []
    for v in named:
        source, condition, columns = VIEWS[v]
        body = ", ".join(f"{e} as {c}" for c, e in columns.items())
        clauses.append(f"{v} as (select {body} from {source}" + (f" where {condition}" if condition else "") + ")")
    rest = sql.strip()
    for start in ("with recursive ", "with "):
        if rest.lower().startswith(start) and clauses:
            return spelled(start + ", ".join(clauses) + ", " + rest[len(start) :], "duckdb")
    return spelled(("with " + ", ".join(clauses) + " " if clauses else "") + rest, "duckdb")
