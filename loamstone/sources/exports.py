"""Names that source files export, by language, with built-in expressions over whole files: Go, Python and TypeScript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import text as T

_ID = r"[A-Za-z_][A-Za-z0-9_]*"
_IDS = rf"{_ID}(?:, *{_ID})*"
_TS_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _listed(lists: Column) -> Column:
    """The names of lists like 'A, B'."""
    return F.flatten(F.transform(lists, lambda names: F.split(names, ", *")))


def go_exports(text: Column) -> Column:
    """Capitalised functions, methods as Type.Name, types, variables and constants, also those of a declaration in brackets."""
    method = rf"(?m)^func \((?:{_ID} +)?\*?({_ID})(?:\[[^\]]*\])?\) ([A-Z][A-Za-z0-9_]*)"
    methods = F.zip_with(_all(text, method, 1), _all(text, method, 2), lambda t, n: F.concat(t, F.lit("."), n))
    blocks = _all(text, r"(?ms)^(?:type|var|const) \(\n(.*?)^\)")
    inside = F.flatten(F.transform(blocks, lambda b: _all(b, rf"(?m)^\t({_IDS})")))
    names = F.concat(_all(text, rf"(?m)^func ({_ID})"), _listed(F.concat(_all(text, rf"(?m)^(?:type|var|const) ({_IDS})"), inside)))
    return F.concat(F.filter(names, lambda n: n.rlike("^[A-Z]")), methods)


def python_exports(text: Column) -> Column:
    """Functions, classes and variables of the top level without a leading underscore."""
    found = [_all(text, p) for p in (rf"(?m)^(?:async +)?def +({_ID})", rf"(?m)^class +({_ID})", rf"(?m)^({_ID}) *(?::[^=\n]+)?=(?!=)")]
    return F.filter(F.concat(*found), lambda n: ~n.startswith("_"))


def typescript_exports(text: Column) -> Column:
    """Declared functions, classes, interfaces, types, enums, constants, and the names of export lists."""
    declared = _all(text, rf"(?m)^export +(?:default +)?(?:async +)?(?:function\*?|class|interface|type|enum|const|let) +({_TS_ID})")
    lists = F.flatten(F.transform(_all(text, r"(?ms)^export +(?:type +)?\{([^}]*)\}"), lambda names: F.split(names, ",")))
    return F.concat(F.filter(declared, lambda n: n != "enum"), F.filter(F.transform(lists, lambda n: F.regexp_extract(n, rf"^\s*({_TS_ID})", 1)), lambda n: n != ""))


def exports(files: DataFrame) -> DataFrame:
    """(folder, name) of every export of the (path, text) files of a folder, without its subfolders; tests and type stubs give none."""
    name = T.base_name(F.col("path"))
    found = (
        F.when(name.endswith(".go") & ~name.endswith("_test.go"), go_exports(F.col("text")))
        .when(name.endswith(".py") & ~name.rlike(r"^test_|_test\.py\z"), python_exports(F.col("text")))
        .when(name.rlike(r"\.tsx?\z") & ~name.rlike(r"\.(test|spec)\.tsx?\z|\.d\.ts\z"), typescript_exports(F.col("text")))
    )
    return files.select(T.folder_of(F.col("path")).alias("folder"), F.explode(found).alias("name")).distinct()
