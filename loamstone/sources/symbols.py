"""Index symbols: four heads and a path of descriptors, as one string. Read and written with built-in expressions.

A descriptor is a name and a suffix: ``/`` namespace, ``#`` type, ``.`` term, ``().`` function. Names with special characters stand between
backticks, which are doubled inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUFFIXES = {"namespace": "/", "type": "#", "term": ".", "method": "()."}
SUFFIX_KINDS = {"#": "type", "().": "func", ".": "var"}
KIND_SUFFIXES = {"type": "#", "func": "().", "method": "().", "var": ".", "const": "."}
INDEX_KINDS = {
    "type": ("Class", "Interface", "Enum", "Struct", "TypeParameter"),
    "func": ("Function", "Method", "Constructor", "AbstractMethod"),
    "const": ("Constant", "EnumMember"),
    "var": ("Variable", "Field", "Property"),
    "module": ("Module", "Namespace", "Package"),
}
_QUOTED, _PLAIN, _SUFFIX = r"`(?:[^`]|``)*`", r"(?!`)(?:[^/#.(]|\((?!\)\.))*", r"/|#|\(\)\.|\."
_DESCRIPTOR = f"({_QUOTED}|{_PLAIN})({_SUFFIX})"


def parsed(symbol: Column) -> Column:
    """struct(scheme, manager, package, version, descriptors of name and suffix, error); after an error the other parts are null."""
    heads = F.split(symbol, " ", 5)
    path = F.get(heads, F.lit(4))
    plain = lambda n: F.when(n.startswith("`"), F.replace(F.substring(n, F.lit(2), F.length(n) - 2), F.lit("``"), F.lit("`"))).otherwise(n)
    every = lambda g: F.regexp_extract_all(path, F.lit(_DESCRIPTOR), F.lit(g))
    descriptors = F.zip_with(every(1), every(2), lambda n, s: F.struct(plain(n).alias("name"), s.alias("suffix")))
    error = (
        F.when(F.coalesce(symbol, F.lit("")) == "", "empty symbol")
        .when(F.size(heads) < 5, "too few parts")
        .when(~path.rlike(f"^(?:{_DESCRIPTOR})*\\z"), "bad descriptor")
    )
    sound = lambda c: F.when(error.isNull(), c)
    parts = [sound(heads[k]).alias(n) for k, n in enumerate(("scheme", "manager", "package", "version"))]
    return F.struct(*parts, sound(descriptors).alias("descriptors"), error.alias("error"))


def escaped(name: Column) -> Column:
    return F.when(name.rlike(r"[ /.#()`]"), F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(name)


def formatted(scheme: Column, manager: Column, package: Column, version: Column, descriptors: Column) -> Column:
    """The string of a symbol; ``descriptors`` is an array of (name, suffix)."""
    path = F.array_join(F.transform(descriptors, lambda d: F.concat(escaped(d["name"]), d["suffix"])), "")
    return F.concat_ws(" ", scheme, manager, package, version, path)


def go_symbol(module: Column, version: Column, package: Column, name: Column, kind: Column, owner: Column) -> Column:
    """The symbol of a Go declaration: its package below the module as namespaces, a method's type, and the name."""
    below = F.when(package.startswith(module), F.substring(package, F.length(module) + 1, F.length(package))).otherwise(package)
    spaces = F.transform(F.filter(F.split(below, "/"), lambda s: s != ""), lambda s: F.struct(s.alias("name"), F.lit("/").alias("suffix")))
    suffix = reduce(lambda out, k: F.when(kind == k, KIND_SUFFIXES[k]).otherwise(out), KIND_SUFFIXES, F.lit("."))
    none = F.array().cast("array<struct<name:string,suffix:string>>")
    held = F.when((kind == "method") & (F.coalesce(owner, F.lit("")) != ""), F.array(F.struct(owner.alias("name"), F.lit("#").alias("suffix")))).otherwise(none)
    return formatted(F.lit("scip-go"), F.lit("gomod"), module, version, F.concat(spaces, held, F.array(F.struct(name.alias("name"), suffix.alias("suffix")))))


def decomposed(symbol: Column) -> Column:
    """struct(import_path, symbol_name, kind, error): namespaces lengthen the package's path, the last other descriptor names the symbol."""
    p = parsed(symbol)
    spaces = F.transform(F.filter(p["descriptors"], lambda d: d["suffix"] == "/"), lambda d: d["name"])
    last = F.element_at(F.filter(p["descriptors"], lambda d: d["suffix"] != "/"), -1)
    error = F.when(symbol.startswith("local "), "local symbol").otherwise(p["error"])
    named = F.exists(p["descriptors"], lambda d: (d["suffix"] != "/") & (d["name"] != ""))
    error = F.when(error.isNull() & ~F.coalesce(named, F.lit(False)), "no name").otherwise(error)
    kind = reduce(lambda out, s: F.when(last["suffix"] == s, SUFFIX_KINDS[s]).otherwise(out), SUFFIX_KINDS, F.lit("unknown"))
    path = F.regexp_replace(F.concat_ws("/", F.array(p["package"]), spaces), r"/+\z", "")
    sound = lambda c: F.when(error.isNull(), c)
    return F.struct(sound(path).alias("import_path"), sound(last["name"]).alias("symbol_name"), sound(kind).alias("kind"), error.alias("error"))


def index_kind(kind: Column) -> Column:
    """Kind of a symbol by its index's own word."""
    return reduce(lambda out, k: F.when(kind.isin(*INDEX_KINDS[k]), k).otherwise(out), INDEX_KINDS, F.lit("unknown"))


def index_visibility(name: Column, language: Column) -> Column:
    """Go names that start with a small letter or an underscore are internal; all others are public."""
    return F.when((language == "go") & name.rlike("^[a-z_]"), "internal").otherwise("public")
