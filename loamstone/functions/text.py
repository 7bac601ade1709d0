"""Column functions over texts, paths and times: built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, P.java(pattern), by)


def scrub(body: Column) -> Column:
    """A body without mentions, file and line references, final punctuation, case and runs of white space, in this order."""
    for pattern, sign in ((P.AT_MENTION, "@"), (P.FILE_LINE, ".go:"), (P.LINE_REF, "L")):
        body = _let(body, _without(pattern, sign))
    body = F.regexp_replace(body, r"[ \t\n\f\r]+\z", "")
    body = _replaced(body, P.TRAILING, "")
    return F.trim(F.regexp_replace(F.lower(body), r"[ \t\n\f\r]+", " "))


def _without(pattern: str, sign: str):
    """Texts without the sign that every match holds stay as they are."""
    return lambda t: F.when(t.contains(sign), _replaced(t, pattern, "")).otherwise(t)


def scrub_hash(body: Column) -> Column:
    return F.sha2(scrub(body), 256)


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of token arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: What every match of a rule holds, as plain text or as a cheap pattern: most texts are passed over by it.
_SIGNS = {"email": "@", "ssn": "-", "secret_key": "sk-", "host_token": "ghp_", "access_key": "AKIA", "phone_intl": "+"}
_SIGN_PATTERNS = {"ip": r"[0-9]\.[0-9]{1,3}\.[0-9]", "phone_us": r"[0-9][-.\s][0-9]{4}"}
#: An address is tried once per run of its characters, and where the last match ended.
_EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def _has_sign(text: Column, name: str) -> Column:
    return text.contains(_SIGNS[name]) if name in _SIGNS else text.rlike(_SIGN_PATTERNS[name])


def _rule(name: str, pattern: str) -> str:
    return _EMAIL if name == "email" else P.java(pattern)


def redact_pii(text: Column) -> Column:
    """Every rule in turn, each over what the one before left."""
    for name, pattern, by in P.REDACTIONS:
        text = _let(text, _redaction(name, _rule(name, pattern), by.replace("[", "\\[").replace("]", "\\]")))
    return _let(text, lambda t: F.when(t.contains("@"), _replaced(t, P.MENTION, "$1" + P.REDACTED_MENTION)).otherwise(t))


def _redaction(name: str, pattern: str, by: str):
    return lambda t: F.when(_has_sign(t, name), F.regexp_replace(t, pattern, by)).otherwise(t)


def _let(value: Column, then) -> Column:
    """``then(value)``, where the value is computed once."""
    return F.transform(F.array(value), then)[0]


def contains_pii(text: Column) -> Column:
    found = [_has_sign(text, n) & text.rlike(_rule(n, p)) for n, p, _ in P.REDACTIONS] + [text.contains("@") & text.rlike(P.java(P.MENTION))]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def sensitive(text: Column) -> Column:
    """Blank and null texts are not sensitive."""
    return F.coalesce(text.rlike(P.SENSITIVE), F.lit(False))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def generated_file(path: Column) -> Column:
    name = base_name(path)
    ends = reduce(lambda a, b: a | b, [name.endswith(s) for s in P.GENERATED_SUFFIXES])
    return ends | name.startswith(P.GENERATED_PREFIX) | name.contains(P.GENERATED_INFIX)


def mining_excluded(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in P.MINING_PREFIXES] + [path.endswith(s) for s in P.MINING_SUFFIXES])


def local_dir(import_path: Column) -> Column:
    """The directory of an import path in its repository, with a final slash; '' for the root of a hosted repository."""
    parts = F.split(import_path, "/")
    hosted = parts[0].isin("github.com", "gitlab.com", "bitbucket.org") & (F.size(parts) >= 3)
    rest = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(hosted, F.when(rest == "", F.lit("")).otherwise(F.concat(rest, F.lit("/")))).otherwise(F.concat(import_path, F.lit("/")))


def strip_version(import_path: Column) -> Column:
    """Without the first ``@version``, keeping what follows it."""
    return F.regexp_replace(import_path, r"^([^@]*)@[^/]*", "$1")


def commit_type(subject: Column) -> Column:
    return F.lower(F.regexp_extract(subject, r"^\s*([A-Za-z]+)\s*[:(!]", 1))


def nontrivial_commit(message: Column) -> Column:
    return (F.octet_length(F.trim(message)) > 20) & ~commit_type(message).isin(*P.TRIVIAL_COMMITS)


def visibility(language: Column, name: Column) -> Column:
    """Go: capitals are public; Python: one underscore is internal, two are private; other languages: public."""
    python = F.when(name.rlike("^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "internal").otherwise("public")
    go = F.when(name.rlike("^[A-Z]"), "public").otherwise("internal")
    return F.when(language == "go", go).when(language == "python", python).otherwise("public")


def is_stale(ts: Column, now: Column) -> Column:
    """Older than seven days; an unreadable time is not stale."""
    return F.coalesce(F.try_to_timestamp(ts.cast("string")) < now - F.expr(f"interval {P.STALE_DAYS} days"), F.lit(False))


def human_age(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0))
    days, hours = F.floor(s / 86400), F.floor(s / 3600)
    months = F.floor(days / 30)
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}s ago"))
    short = F.when(hours == 0, "just now").when(hours == 1, "1 hour ago").otherwise(many(hours, "hour"))
    return F.when(days == 0, short).when(days == 1, "1 day ago").when(days < 30, many(days, "day")).when(months == 1, "1 month ago").otherwise(many(months, "month"))


def poll_interval(age_seconds: Column) -> Column:
    """Seconds between polls; a null age was never queried."""
    out = F.lit(P.COLD_INTERVAL)
    for limit, interval in reversed(P.FRESHNESS_TIERS):
        out = F.when(age_seconds <= limit, F.lit(interval)).otherwise(out)
    return out


def error_category(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(P.OTHER_ERROR)
    for words, category in reversed(P.ERROR_CATEGORIES):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), category).otherwise(out)
    return F.when(message.isNull(), P.NO_ERROR).otherwise(out)


def first_bytes(text: Column, n: int) -> Column:
    """The longest start of a text of at most ``n`` bytes that cuts no character in two."""
    whole = text.cast("binary")
    # a cut in the middle of a character leaves up to three of its bytes, which are taken back
    starts = F.filter(F.sequence(F.lit(n), F.lit(max(0, n - 3)), F.lit(-1)), lambda k: ~F.hex(F.substring(whole, k + 1, 1)).rlike("^[89AB]"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(whole, F.lit(1), F.coalesce(F.get(starts, F.lit(0)), F.lit(n))).cast("string"))


def truncated(text: Column, n: int, end: str = "...") -> Column:
    """A text of more than ``n`` bytes is cut to ``n``, the final dots among them."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(first_bytes(text, max(0, n - len(end))), F.lit(end)))


def strip_control(text: Column, max_bytes: int = 4096) -> Column:
    """Without control characters but tabs; at most ``max_bytes`` bytes."""
    return first_bytes(F.regexp_replace(text, r"[\p{Cntrl}&&[^\t]]", ""), max_bytes)


def version_triple(text: Column) -> Column:
    """[major, minor, patch] of a version like 2.46.1 in a text; null where there is none."""
    parts = [F.regexp_extract(text, r"(\d+)\.(\d+)\.(\d+)", k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.array(*[p.cast("int") for p in parts]))


def normal_path(path: Column) -> Column:
    """A path without '.', '..' and empty segments; '..' at the root is dropped."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        none,
        lambda out, s: F.when(s.isin("", "."), out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))),
    )
    return F.array_join(kept, "/")


def folder_of(path: Column) -> Column:
    """The folder of a path, '' at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def go_kind(declared: Column) -> Column:
    """Kind of a Go object by the checker's word for it; anything else is a variable."""
    return F.when(declared == "TypeName", "type").when(declared == "Func", "func").when(declared == "Const", "const").otherwise("var")


def go_visibility(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "private").when(name.rlike(r"^\p{Lu}"), "public").otherwise("internal")


def clamp_confidence(c: Column) -> Column:
    return F.when(c >= 1, 0.95).when(c <= 0, 0.1).otherwise(c)


def mention_confidence(symbol: Column, text: Column) -> Column:
    return F.when(F.lower(text).contains(F.lower(symbol)), 0.8).otherwise(0.4)


def stability(commits: Column) -> Column:
    return F.when(commits <= 5, "High stability").when(commits <= 20, "Moderate stability").otherwise("Low stability")


def remote_parts(url: Column) -> tuple[Column, Column]:
    """(owner, repository) of an https or ssh remote."""
    pattern = r"(?:https?://[^/]+/|git@[^:]+:)([^/]+)/([^/]+?)(?:\.git)?/?\z"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)


def repo_name(place: Column) -> Column:
    """The repository's name by its remote, or by the last folder of a path."""
    named = remote_parts(place)[1]
    return F.when(named != "", named).otherwise(F.regexp_replace(F.substring_index(F.regexp_replace(place, "/+\\z", ""), "/", -1), "\\.git\\z", ""))


def commit_sha(text: Column) -> Column:
    return F.regexp_extract(text, P.java(r"\b([0-9a-f]{40})\b"), 1)


def glob_pattern(glob: str, doublestar: bool = False) -> str:
    """A Java pattern for a glob: * and ? do not cross '/'; ** does only where ``doublestar`` is set."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and doublestar:
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + (".*" if doublestar else "[^/]*"), i + 2
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1], end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c != "/" else c)
        i += 1
    return "^" + out + "\\z"


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def badge_colour(count: Column) -> Column:
    return F.when(count == 0, "green").when(count <= 3, "yellow").otherwise("red")
