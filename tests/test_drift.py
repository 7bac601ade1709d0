"""Exports, references, drift reports, instruction files and index symbols on small literal texts."""

import re

from pyspark.sql import functions as F

from loamstone.operators import detect, drift, globs
from loamstone.sources import exports, lines, symbols


def texts(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/").replace("_DOT_", "."), v) for k, v in files.items()], "path string, text string")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def test_go_exports(spark):
    go = """package store

type Store struct{}
type (
\tReader interface{}
\tinner int
)
const Limit, other = 1, 2
var (
\tErrGone = errors.New("x")
\t\tNested = 1
)
func New() *Store { return nil }
func helper() {}
func (s *Store) Close() error { return nil }
func (Store) Name() string { return "" }
func (g *Generic[T]) Get() T { return g.v }
func (s *Store) hide() {}
"""
    files = rows(spark, ("a/s.go", go), ("a/s_test.go", "func Exported() {}"), ("a/sub/x.go", "func Deep() {}"), ("top.go", "func Top() {}"))
    found = {}
    for r in exports.exports(files).collect():
        found.setdefault(r["folder"], set()).add(r["name"])
    assert found["a"] == {"Store", "Reader", "Limit", "ErrGone", "New", "Store.Close", "Store.Name", "Generic.Get"}
    assert found["a/sub"] == {"Deep"} and found[""] == {"Top"}


def test_python_and_typescript_exports(spark):
    python = "import os\nMAX = 3\n_hidden = 1\nlimit: int = 4\nMAX == 5\n@wraps\ndef run():\n    inner = 1\nasync def arun(): pass\nclass Widget:\n    def method(self): pass\nclass _Private: pass\na, b = 1, 2\n"
    script = "export function run() {}\nexport default class Main {}\nexport interface Face {}\nexport type Name = string;\nexport enum Colour { Red }\nexport const one = 1;\nexport let two;\nexport { three, four as five };\nfunction local() {}\nexport async function later() {}\n"
    files = rows(spark, ("p/m.py", python), ("p/test_m.py", "def t(): pass"), ("p/m_test.py", "def t(): pass"), ("t/m.ts", script), ("t/m.test.ts", "export const no = 1;"), ("t/m.d.ts", "export const no = 1;"), ("t/v.tsx", "export const View = 1;"))
    found = {}
    for r in exports.exports(files).collect():
        found.setdefault(r["folder"], set()).add(r["name"])
    assert found["p"] == {"MAX", "limit", "run", "arun", "Widget"}
    assert found["t"] == {"run", "Main", "Face", "Name", "Colour", "one", "two", "three", "four", "later", "View"}


def test_references_take_what_they_match(spark):
    text = "Call `NewStore` and store.NewStore, parseJSON, my_handler or ConfigMap; not plain words, `v2` or `x`.\n[ref]: https://e.com/HiddenName\n```goCode\nuseThis in a block\n```\nSee tools/cache, k8s.io/api/core and com/x.\nAt https://h.org/a/b: skip/this but k8s.io/kept\n"
    found = {(r["name"], r["is_package"]) for r in lines.references(rows(spark, ("R", text))).collect()}
    names = {n for n, p in found if not p}
    assert names == {"NewStore", "store.NewStore", "parseJSON", "my_handler", "ConfigMap", "useThis"}
    assert {n for n, p in found if p} == {"tools/cache", "k8s.io/api/core", "k8s.io/kept"}


def test_findings(spark):
    docs = rows(spark, ("a/README.md", "Use `New` and `Close`, `Gone` and tools/cache or sub/kept.\n"), ("b/README.md", "Nothing said.\n"), ("c/README.md", "`OnlyWords`"))
    files = rows(spark, ("a/x.go", "func New() {}\nfunc (s *Store) Close() {}\nfunc Quiet() {}\n"), ("b/x.py", "def run(): pass\n"), ("a/sub/kept/y.go", "package kept"))
    found = drift.findings(docs, files)
    assert {tuple(r) for r in found.collect()} == {("a/README.md", "stale", "Gone"), ("a/README.md", "undocumented", "Quiet"), ("a/README.md", "stale_package", "tools/cache"), ("b/README.md", "undocumented", "run"), ("c/README.md", "stale", "OnlyWords")}
    reports = {r["path"]: tuple(r)[1:] for r in drift.reports(docs, found).collect()}
    assert reports == {"a/README.md": (1, 1, 1), "b/README.md": (0, 1, 0), "c/README.md": (1, 0, 0)}
    checked = spark.createDataFrame([("A", True)], "context_file string, valid boolean")
    assert drift.repo_check(found, checked).first()["has_drift"] is True
    # what is only undocumented is no drift; a stale path of an instruction file is
    silent = found.filter("finding = 'undocumented'")
    assert drift.repo_check(silent, checked).first()["has_drift"] is False
    assert drift.repo_check(silent, spark.createDataFrame([("A", False)], checked.schema)).first()["has_drift"] is True
    assert drift.repo_check(found.limit(0), checked.limit(0)).first()["has_drift"] is False


def test_context_claims(spark):
    text = "Edit `cmd/main.go`, `./scripts/build.sh` and drift/drift.go; not `feature/new`, `true/false`, `https://x.org/a/b`, `a/*.go`, `a/...` or docs/x.go.\n```\n`in/fence.go`\n```\nAgain `cmd/main.go`. [`shown/not.go`](guide/real.md) uses `github.com/o/r` and bare/word.xyz\n"
    found = {(r["kind"], r["value"]): r["line_no"] for r in lines.context_claims(rows(spark, ("A", text))).collect()}
    assert found[("file_path", "cmd/main.go")] == 1 and ("file_path", "./scripts/build.sh") not in found and found[("file_path", "drift/drift.go")] == 1
    assert found[("package_ref", "github.com/o/r")] == 5
    assert not {v for k, v in found if k == "file_path"} & {"feature/new", "true/false", "a/*.go", "in/fence.go", "shown/not.go", "docs/x.go", "bare/word.xyz"}


def test_path_claims(spark):
    claims = spark.createDataFrame([("s/AGENTS.md", v) for v in ("a/b.go", "./a/b.go", "a/", "lib/c.py", "../a/b.go", "deep/d.kt", "no/e.go", "pkg/vend.go", "x/deep")], "context_file string, value string")
    files = spark.createDataFrame([("a/b.go",), ("s/lib/c.py",), ("x/deep/d.kt",), ("vendor/pkg/vend.go",)], "path string")
    found = {r["value"]: r["found_as"] for r in drift.path_claims(claims, files).collect()}
    assert found == {"a/b.go": "exact", "./a/b.go": "exact", "a/": "directory", "lib/c.py": "relative", "../a/b.go": "exact", "deep/d.kt": "suffix", "no/e.go": "missing", "pkg/vend.go": "missing", "x/deep": "directory"}


def _entry(n, doc, symbol, file="f", start=10, end=12, fuzzy=False, signature="s", content="c"):
    return (n, doc, n, "r", symbol, file, start, end, fuzzy, signature, content)


def test_manifest_drift(spark):
    now = F.lit("2024-03-01").cast("date")
    entries = [
        _entry(0, 1, 7, content="other"), _entry(1, 1, 7, signature="x"), _entry(2, 1, 99), _entry(3, 1, 98, file="gone"), _entry(4, 1, 7), _entry(5, 1, 99, fuzzy=True),
        _entry(6, 2, None, file="gone"), _entry(7, 2, None), _entry(8, 2, None, file="", start=0), _entry(9, 2, 7, signature="", content=""), _entry(10, 3, 97, file="", start=0),
    ]
    schema = "entry_id long, doc_id long, pos long, repo string, symbol_id long, file string, start_line int, end_line int, fuzzy boolean, signature string, content string"
    table = spark.createDataFrame(entries, schema)
    current = spark.createDataFrame([(7, "r", "f", 11, 300, "s", "c"), (8, "other", "gone", 1, 99, "s", "c")], "symbol_id long, repo string, file string, start_line int, end_line int, signature string, content string")
    documents = spark.createDataFrame([(1, 5, "2024-01-01"), (2, 0, "2024-01-01"), (3, 90, "2024-01-01"), (4, 5, None)], "doc_id long, max_age_days int, last_refreshed string").withColumn("last_refreshed", F.col("last_refreshed").cast("date"))
    found = [(r["doc_id"], r["place"], r["pos"], r["severity"], r["change"]) for r in drift.manifest_drift(table, documents, current, now).orderBy("doc_id", "place").collect()]
    assert found == [
        (1, 0, 2, "orphaned", "renamed"), (1, 1, 3, "orphaned", "deleted"), (1, 2, 1, "hot", "signature"), (1, 3, 0, "warm", "body"), (1, 4, None, "cold", "age"), (2, 0, 6, "orphaned", "deleted"), (3, 0, 10, "orphaned", "deleted"),
    ]
    assert {r["doc_id"]: r["severities"] for r in drift.severities(drift.manifest_drift(table, documents, current, now)).collect()}[1] == ["orphaned", "hot", "warm", "cold"]
    assert [tuple(r) for r in drift.manifest_drift(table, documents, None, now).select("doc_id", "severity").collect()] == [(1, "cold")]


def test_readme_symbols(spark):
    refs = spark.createDataFrame([("R", "Open"), ("R", "Gone"), ("R", "Lost")], "path string, name string")
    held = spark.createDataFrame([(1, "p", "open"), (2, "q", "Open"), (3, "p", "Lost")], "id long, import_path string, symbol_name string")
    claims = spark.createDataFrame([(3, "defines", "away.go"), (3, "has_doc", "away.go"), (1, "defines", "a.go")], "subject_id long, predicate string, source_file string")
    files = spark.createDataFrame([("a.go",)], "path string")
    assert {tuple(r) for r in drift.readme_symbols(refs, held, claims, files).collect()} == {("R", "Open", "MEDIUM", "2 packages"), ("R", "Gone", "HIGH", "not found"), ("R", "Lost", "HIGH", "file gone: away.go")}


def test_index_symbols(spark):
    names = ["scip-go gomod k8s.io/api v1 core/v1/Pod#", "s m p v pkg/T#Do().", "s m p v `we``ird name`/x.", "s m p v a(b)c().", "s m p v ", "s m p", "", "s m p v bad", "s m p v `open", "local 3", "s m p v ns/"]
    frame = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r["s"]: r["p"] for r in frame.select("s", symbols.parsed(F.col("s")).alias("p")).collect()}
    parts = lambda n: [(d["name"], d["suffix"]) for d in got[n]["descriptors"]]
    assert parts(names[0]) == [("core", "/"), ("v1", "/"), ("Pod", "#")] and got[names[0]]["package"] == "k8s.io/api"
    assert parts(names[1]) == [("pkg", "/"), ("T", "#"), ("Do", "().")] and parts(names[2]) == [("we`ird name", "/"), ("x", ".")] and parts(names[3]) == [("a(b)c", "().")]
    assert parts(names[4]) == [] and [got[n]["error"] for n in names[5:9]] == ["too few parts", "empty symbol", "bad descriptor", "bad descriptor"]
    taken = {r["s"]: r["d"] for r in frame.select("s", symbols.decomposed(F.col("s")).alias("d")).collect()}
    assert tuple(taken[names[0]])[:3] == ("k8s.io/api/core/v1", "Pod", "type") and tuple(taken[names[1]])[:3] == ("p/pkg", "Do", "func") and tuple(taken[names[2]])[2:] == ("var", None)
    assert taken["local 3"]["error"] == "local symbol" and taken["s m p v ns/"]["error"] == "no name" and taken["s m p v "]["error"] == "no name"
    again = frame.filter("s like 's m p v %'").select("s", symbols.formatted(F.lit("s"), F.lit("m"), F.lit("p"), F.lit("v"), symbols.parsed(F.col("s"))["descriptors"]).alias("again"), symbols.parsed(F.col("s"))["error"].alias("error")).filter("error is null")
    assert all(r["s"] == r["again"].replace("`a(b)c`", "a(b)c") for r in again.collect())
    made = spark.range(1).select(symbols.go_symbol(F.lit("k8s.io/api"), F.lit("v1"), F.lit("k8s.io/api/core/v1"), F.lit("Get"), F.lit("method"), F.lit("Pod")).alias("m"), symbols.go_symbol(F.lit("m"), F.lit("v"), F.lit("m"), F.lit("X"), F.lit("const"), F.lit(None).cast("string")).alias("c")).first()
    assert made["m"] == "scip-go gomod k8s.io/api v1 core/v1/Pod#Get()." and made["c"] == "scip-go gomod m v X."
    kinds = spark.range(1).select(*[symbols.index_kind(F.lit(k)).alias(k) for k in ("Struct", "Method", "EnumMember", "Field", "Package", "Macro")], symbols.index_visibility(F.lit("_x"), F.lit("go")).alias("v")).first()
    assert tuple(kinds) == ("type", "func", "const", "var", "module", "unknown", "internal")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark):
    """Short keys that give long texts: the estimate of their size is far too small."""
    return spark.range(8).selectExpr("concat('a', id, '/README.md') as path", "concat('## H', id, '\n', repeat('`Name` and more. ', 1000)) as text")


def _names(spark):
    return spark.createDataFrame([("Name", "func", "a0/x.go")], "symbol_name string, kind string, file_path string")


def test_sections_and_their_terms_are_not_broadcast(spark):
    prompts = detect.section_prompts(_texts(spark), _names(spark))
    assert "BroadcastExchange" not in _plan(prompts)
    assert [r.n_known for r in prompts.collect()] == [1] * 8


def test_manifests_are_not_broadcast_and_repeated_entries_count_once(spark):
    manifest = spark.range(500).selectExpr("if(id < 0, '', 'a/*.go') as glob", "if(id < 0, '', 'doc.md') as doc")
    found = globs.manifest_docs(spark.createDataFrame([("a/x.go",), ("b/x.go",)], "path string"), manifest)
    assert "BroadcastExchange" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("a/x.go", "doc.md")]


def test_findings_and_reports_broadcast_no_texts(spark):
    docs, files = _texts(spark), spark.range(8).selectExpr("concat('a', id, '/x.go') as path", "'func Other() {}\n' as text")
    found = drift.findings(docs, files)
    reports = drift.reports(docs, found)
    assert "BroadcastExchange" not in _plan(reports)
    assert sorted(tuple(r)[1:] for r in reports.collect()) == [(1, 1, 0)] * 8
    checked = drift.path_claims(spark.createDataFrame([("a0/AGENTS.md", "x.go")], "context_file string, value string"), files.select("path"))
    assert "BroadcastExchange" not in _plan(checked)
    assert _plan(drift.repo_check(found, checked)).count("BroadcastExchange") == 1  # the single row of totals


def test_claims_of_a_name_are_dealt_to_parts(spark):
    refs = spark.range(300).selectExpr("concat('d', id) as path", "if(id < 0, '', 'Open') as name")
    symbols = spark.range(40).selectExpr("id", "'p' as import_path", "if(id < 0, '', 'open') as symbol_name")
    claims = spark.range(40).selectExpr("id as subject_id", "concat('f', id) as source_file", "'defines' as predicate")
    files = spark.createDataFrame([("f0",)], "path string")
    found = drift.readme_symbols(refs, symbols, claims, files)
    assert "BroadcastExchange" not in _plan(found)
    assert found.filter("detail like 'file gone: %'").count() == 300 * 39 and found.count() == 300 * 39
    assert len(re.findall(r"hashpartitioning\(key#\d+, part#\d+", _plan(found))) == 2


def test_references_are_read_once_and_their_claims_meet_in_many_tasks(spark):
    refs = spark.range(300).selectExpr("concat('d', id) as path", "case id when 0 then 'New' when 1 then 'Both' else 'Open' end as name")
    symbols = spark.range(42).selectExpr("id", "concat('p', id) as import_path", "case when id < 40 then 'open' else 'both' end as symbol_name")
    claims = spark.range(80).selectExpr("id % 40 as subject_id", "concat('f', id % 40) as source_file", "'defines' as predicate")
    found = drift.readme_symbols(refs, symbols, claims, spark.createDataFrame([("f0",)], "path string"))
    assert _plan(found).count("Range (0, 300") == 1
    gone = found.filter("detail like 'file gone: %'")
    assert gone.count() == 298 * 78 and gone.distinct().count() == 298 * 39 and gone.select("path").distinct().count() == 298
    assert gone.select(F.spark_partition_id()).distinct().count() > 30  # few bytes, but many rows are made of them
    others = {tuple(r) for r in found.filter("detail not like 'file gone: %' and path in ('d0', 'd1', 'd2')").collect()}
    assert others == {("d0", "New", "HIGH", "not found"), ("d1", "Both", "MEDIUM", "2 packages"), ("d2", "Open", "MEDIUM", "40 packages")}
    assert found.count() == 298 * 78 + 300


def test_text_views_are_dealt_to_tasks_by_their_rows(spark, tmp_path):
    from loamstone.plans.views import Model

    spark.range(45_000).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for view in (Model(spark, str(tmp_path)).sources, Model(spark, str(tmp_path)).readmes):
        sizes = [r[0] for r in view.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 5 and max(sizes) < 12_000
