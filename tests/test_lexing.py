"""Declarations by the lexer, and what lies inside their lines."""

import pytest

from loamstone.operators import ownership
from loamstone.sources import code, lexing


def declared(text, language):
    return [(d.name, d.kind, d.line, d.end_line, d.owner) for d in lexing.declarations(text, language)]


def test_blanking_keeps_places():
    for text, language in [('a := "x // y" /* z\n */ `q\n"`\n', "go"), ("a `b ${c + `d ${e} f` + '}'} g` h // i\n/x\"y/", "typescript"), ("a 'b' \"c # d\" # e\ncat <<X\nf() {\nX\ng", "shell")]:
        code_ = lexing.Code(text, language).code
        assert len(code_) == len(text) and code_.count("\n") == text.count("\n")
    assert lexing.Code("a `b ${c + `d ${e} f` + '}'} g` h", "typescript").code == f"a {' ' * 5}c + {' ' * 5}e{' ' * 4} + {' ' * 7} h"
    assert lexing.Code("x = a / b; y = c / d; z = /[/{]/;", "typescript").code.count("/") == 2


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("go", 'package p\n\nfunc A() {\n\tx := "}"\n\tif true { // }\n\t}\n}\n\nfunc (s *S[T]) B(f func() interface{}) struct{} {\n}\n', [("A", "func", 3, 7, None), ("B", "method", 9, 10, "S")]),
        ("go", "type (\n\tA struct {\n\t\tb int\n\t}\n\tC = D\n)\n\nvar x, y = 1, 2\nconst (\n\tK = iota\n\tL\n)\n", [("A", "type", 2, 4, None), ("C", "type", 5, 5, None), ("x", "var", 8, 8, None), ("y", "var", 8, 8, None), ("K", "const", 10, 10, None), ("L", "const", 11, 11, None)]),
        ("go", "/*\nfunc Gone() {}\n*/\nvar s = `\nfunc Fake() {}\n`\nfunc Real() {}\n", [("s", "var", 4, 6, None), ("Real", "func", 7, 7, None)]),
        ("typescript", "export default class A extends B {\n  static async run(a = `}${f({})}`) {\n    if (x) { y(); }\n  }\n  get v(): number {\n    return 1;\n  }\n  field = 3;\n}\n", [("A", "class", 1, 9, None), ("run", "method", 2, 4, "A"), ("v", "method", 5, 7, "A")]),
        ("typescript", "function f()\n{\n  const g = 1;\n  function h() {}\n}\nexport const k = () => {\n};\ninterface I {\n  m(): void;\n}\ntype T<X> = X | null;\nexport enum E { A }\n", [("f", "func", 1, 5, None), ("h", "func", 4, 4, "f"), ("k", "const", 6, 7, None), ("I", "interface", 8, 10, None), ("T", "type", 11, 11, None), ("E", "enum", 12, 12, None)]),
        ("shell", "function a {\n  b() { echo '}'; }\n}\ncat <<-'EOF'\n\tc() {\n\tEOF\nd()\n{\n  :\n}\n", [("a", "func", 1, 3, None), ("b", "func", 2, 2, "a"), ("d", "func", 7, 10, None)]),
        ("python", "class A:\n    def f(self):\n        def g(): pass\n        s = 'def x(): pass'\n\nif True:\n    def h(): pass\n", [("A", "class", 1, 4, None), ("f", "func", 2, 4, "A"), ("g", "func", 3, 3, "f"), ("h", "func", 7, 7, None)]),
        ("go", "", []), ("typescript", "`", []), ("shell", "<<", []), ("go", "func A() {\n\tnever closed", [("A", "func", 1, 2, None)]),
    ],
)
def test_declarations(language, text, expected):
    assert declared(text, language) == expected


def test_docs_imports_exports():
    go = 'package p\n\nimport (\n\t"fmt"\n\tx "a/b" // c\n)\nimport "os"\n\n// F does it.\n// More.\nfunc F() { s := `\nimport "no"\n` }\n\n/*\n * G too.\n */\nfunc G() {}\n\n// apart\n\nfunc H() {}\n'
    assert {d.name: d.doc for d in lexing.declarations(go, "go")} == {"F": "F does it.", "G": "G too.", "H": None}
    assert lexing.imports(go, "go") == [("fmt", 4), ("a/b", 5), ("os", 7)]
    ts = "import { a } from './x';\nimport 'side';\nimport {\n  b,\n} from \"y\";\nexport { c } from 'z';\n// import d from 'w'\nexport function f() {}\nconst s = \"export class No {}\";\n"
    assert lexing.imports(ts, "typescript") == [("./x", 1), ("side", 2), ("y", 5), ("z", 6)]
    assert lexing.exports(ts) == [("f", 8)]
    assert lexing.imports(". lib.sh\nsource ./a.sh\n# . no.sh\necho '\n. not.sh\n'\n", "shell") == [("lib.sh", 1), ("./a.sh", 2)]


def test_claims_keep_their_repo(spark):
    files = spark.createDataFrame([("r", "a.go", "package a\n// F runs.\nfunc F() {}\n"), ("q", "a.go", "package a\ntype T int\n"), ("q", "b.py", None), ("q", "c.py", "def ("), ("q", "d.rs", "x")], "repo string, path string, text string")
    found = {tuple(r) for r in code.extract(files).select("repo", "path", "symbol_name", "predicate", "object_text", "confidence").collect()}
    assert found == {("r", "a.go", "F", "defines", None, 1.0), ("r", "a.go", "F", "has_doc", "F runs.", 0.85), ("q", "a.go", "T", "defines", None, 1.0), ("q", "c.py", "c.py", "unparsed", None, 1.0), ("q", "d.rs", "d.rs", "unparsed", None, 1.0)}
    assert {tuple(r)[:2] for r in code.declarations(files).select("repo", "name").collect()} == {("r", "F"), ("q", "T")}


def test_innermost(spark):
    points = spark.createDataFrame([("a", 1), ("a", 5), ("a", 70), ("a", 300), ("b", 5)], "path string, line_no int")
    ranges = spark.createDataFrame([("a", "outer", "func", 2, 200), ("a", "inner", "func", 4, 6), ("a", "late", "func", 60, 130)], "path string, name string, kind string, line int, end_line int")
    found = {(r["path"], r["line_no"]): r["enclosing"] for r in ownership.innermost(points, ranges, ["path"]).collect()}
    assert found == {("a", 1): None, ("a", 5): "inner", ("a", 70): "late", ("a", 300): None, ("b", 5): None}


def test_ownership_of_overlapping_ranges(spark):
    blame = spark.createDataFrame([("r", "f", n, "ann" if n % 3 else "bob", f"c{n // 50}", n) for n in range(1, 201)], "repo string, file string, line int, author string, commit string, at int")
    ranges = spark.createDataFrame([("r", "f", 1, 10, 12), ("r", "f", 2, 1, 200), ("r", "f", 3, 150, 400), ("q", "f", 4, 1, 9), ("r", "f", 5, 9, 3)], "repo string, file string, symbol_id int, start_line int, end_line int")
    facts, evidence = ownership.symbol_ownership(blame, ranges, ["repo", "file"])
    got = {r["subject_id"]: r for r in facts.collect()}
    assert set(got) == {1, 2, 3} and got[1]["body"] == "Ownership: ann (66%, 2/3 lines); bob (33%, 1/3 lines)"
    assert got[2]["source_quote"] == "blame: top contributor ann"
    assert {(r["subject_id"], r["author"]): r["source_ref"] for r in evidence.collect()}[1, "ann"] == "c0"
    # another commit on one line changes the digests of the ranges over it only
    later = blame.selectExpr("repo", "file", "line", "author", "case when line = 11 then 'new' else commit end as commit", "at")
    fresh, _ = ownership.symbol_ownership(later, ranges.filter("symbol_id <> 3"), ["repo", "file"])
    assert {r["subject_id"]: r["why"] for r in ownership.stale_ownership(facts, fresh).collect()} == {1: "changed", 2: "changed", 3: "gone"}


def test_added_readers(spark):
    """A reader of the caller's reads its own ending, one that fails leaves an unparsed row, and none may go beyond the tier."""
    def reader():
        def read(text):
            if "bad" in text:
                raise ValueError(text)
            return [(line[3:], "func", "implements" if "deep" in text else "defines", None, n, 1.0) for n, line in enumerate(text.split("\n"), 1) if line.startswith("fn ")]

        return read

    files = spark.createDataFrame([("a.rs", "fn one\nfn two"), ("b.rs", "bad"), ("c.py", "def f(): pass"), ("d.test.py", "fn three")], "path string, text string")
    found = code.extract(files, {".rs": ("rust", reader()), ".test.py": ("spec", reader())})
    assert {tuple(r) for r in found.select("path", "language", "symbol_name", "predicate").collect()} == {("a.rs", "rust", "one", "defines"), ("a.rs", "rust", "two", "defines"), ("b.rs", "rust", "b.rs", "unparsed"), ("c.py", "python", "f", "defines"), ("d.test.py", "spec", "three", "defines")}
    with pytest.raises(Exception, match="beyond the tier"):
        code.extract(spark.createDataFrame([("a.rs", "fn deep")], "path string, text string"), {".rs": ("rust", reader())}).collect()
