"""All patterns of the engine, in one place.

Patterns are written for RE2's meaning of ``\\b`` and ``\\w`` (ASCII). ``java`` turns them into Java patterns of the same meaning, because
Java's word boundary knows Unicode letters and its ``$`` also matches before a final line end.
"""

from __future__ import annotations

import re

# The patterns, words and thresholds below define the results and must not be changed.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SECRET_KEY = r"\bsk-[a-zA-Z0-9]{20,}\b"
HOST_TOKEN = r"\bghp_[a-zA-Z0-9]{30,}\b"
ACCESS_KEY = r"\bAKIA[A-Z0-9]{12,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE_INTL = r"\+\d[\d\s\-]{7,}\d"
PHONE_US = r"(?:\(\d{3}\)\s?|\b\d{3}[\-.\s])\d{3}[\-.\s]\d{4}\b"
MENTION = r"(^|[\s(])(@[a-zA-Z0-9_]{1,39})\b"
#: (name, pattern, replacement), in the order of application.
REDACTIONS = (
    ("email", EMAIL, "[REDACTED_EMAIL]"),
    ("ssn", SSN, "[REDACTED_SSN]"),
    ("secret_key", SECRET_KEY, "[REDACTED_TOKEN]"),
    ("host_token", HOST_TOKEN, "[REDACTED_TOKEN]"),
    ("access_key", ACCESS_KEY, "[REDACTED_TOKEN]"),
    ("ip", IPV4, "[REDACTED_IP]"),
    ("phone_intl", PHONE_INTL, "[REDACTED_PHONE]"),
    ("phone_us", PHONE_US, "[REDACTED_PHONE]"),
)
REDACTED_MENTION = "[REDACTED_MENTION]"
AT_MENTION = r"@[A-Za-z0-9_-]+"
FILE_LINE = r"\w+\.go:\d+"
LINE_REF = r"\bL\d+\b"
TRAILING = r"[.!?:;]+$"
SENSITIVE = r"(?i)(password|secret|token|credential|api_key)"
MARKER = r"(?i)\b(TODO|FIXME|XXX|HACK|NOTE|WHY)[\s:](.*)"
BACKTICK = r"`([A-Za-z_][A-Za-z0-9_.]*)`"
#: One alternation, which takes what it matches: dotted, camel case, snake case, Pascal case.
PROSE = (
    r"\b([a-zA-Z_][a-zA-Z0-9_]*\.[A-Z][a-zA-Z0-9_]*)\b|\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b"
    r"|\b([a-zA-Z][a-zA-Z0-9]*_[a-zA-Z0-9_]+)\b|\b([A-Z][a-z]+[A-Z][a-zA-Z0-9]*)\b"
)
CAMEL = r"\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b"
SNAKE = r"\b([a-zA-Z][a-zA-Z0-9]*_[a-zA-Z0-9_]+)\b"
PASCAL = r"\b([A-Z][a-z]+[A-Z][a-zA-Z0-9]*)\b"
TERMS = (PASCAL, CAMEL, SNAKE)
PACKAGE = r"k8s\.io/[a-zA-Z0-9_/-]+"
RELATIVE_PACKAGE = r"(?:^|[\s`\"])([a-z][a-z0-9_-]*/[a-z][a-z0-9_/-]*)"
NO_PACKAGE = ("com/", "org/", "io/", "forum/", "msg/", "dev/", "authn/")
URL_LINE = r"https?://|git://"
QUOTED_PATH = r"`([./~]?[a-zA-Z0-9_-]+(?:/[a-zA-Z0-9_.~*-]+)+(?:\.[a-zA-Z0-9]+)?/?)`"
BARE_PATH = r"(?:^|\s)([./]?[a-zA-Z0-9_-]+(?:/[a-zA-Z0-9_.-]+)+\.[a-zA-Z0-9]{1,10})(?:\s|$|[,;:)])"
GO_IMPORT = r"`([a-zA-Z][a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/[a-zA-Z0-9_./-]+)`"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
BRANCH_PREFIXES = ("feature/", "fix/", "bugfix/", "hotfix/", "release/", "chore/", "docs/", "refactor/", "perf/", "ci/")
SLASH_PAIRS = ("if/else", "true/false", "input/output", "read/write", "get/set", "push/pull", "client/server", "src/dst", "dx/dy", "req/res", "stdin/stdout", "yes/no", "on/off", "open/close", "start/stop")
CODE_EXTENSIONS = (
    "go", "py", "ts", "tsx", "js", "jsx", "rs", "rb", "java", "kt", "swift", "c", "cpp", "h", "hpp", "cs", "php", "sh", "bash", "zsh",
    "yaml", "yml", "json", "toml", "md", "sql", "html", "css", "scss", "proto", "graphql", "tf",
)
UNSEARCHED_FOLDERS = (".git", "vendor", "node_modules", "_output")
SOURCE_LINE = r"(?m)^\s*-\s+\[([^\]]+)\]\(([^)]+)\)\s*$"
SOURCE_LINK = r"^/([^?#]+?)/-/blob/([^?#]+)\?(?:[^#]*&)?L(\d+)(?:-(\d+))?(?:[#&].*)?$"
REPO_MENTION = r"\b(github\.com|gitlab\.com|bitbucket\.org)/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+\b"
GENERATED_SUFFIXES = ("_generated.go", "pb.go")
GENERATED_PREFIX, GENERATED_INFIX = "zz_generated", "_zz_generated"
MINING_PREFIXES, MINING_SUFFIXES = ("vendor/", "third_party/", "testdata/"), (".pb.go", "_gen.go", "_test.go")
MARKER_KINDS = {"TODO": "todo", "FIXME": "todo", "XXX": "todo", "HACK": "quirk", "NOTE": "quirk", "WHY": "quirk"}
TRIVIAL_COMMITS = ("chore", "ci", "docs", "style")
#: Words of an error text, most specific first, and its category.
ERROR_CATEGORIES = (
    (("context canceled", "context deadline exceeded"), "context_canceled"),
    (("unique constraint",), "unique_constraint_violation"),
    (("check constraint",), "check_constraint_violation"),
    (("foreign key constraint",), "foreign_key_constraint"),
    (("not null constraint",), "not_null_constraint"),
    (("database is busy", "sqlite_busy"), "database_busy"),
    (("is locked", "sqlite_locked"), "database_locked"),
    (("sqlite", "no such table", "no such column", "syntax error"), "database_error"),
    (("provenance", "missing source_quote", "invalid evidence"), "provenance_validation_failed"),
)
OTHER_ERROR, NO_ERROR = "upsert_failed", "nil_error"
#: (age in seconds up to which, poll interval in seconds); beyond, the cold interval.
FRESHNESS_TIERS, COLD_INTERVAL = ((3600, 10), (86400, 60)), 300
STALE_DAYS = 7


def java(pattern: str) -> str:
    """The Java pattern of the same meaning. Every ``\\b`` here stands beside a word character that the pattern itself asks for."""
    out = re.sub(r"\\b(?=$|[)|])", "(?![A-Za-z0-9_])", pattern).replace(r"\b", "(?<![A-Za-z0-9_])")
    return out if "(?m)" in pattern else re.sub(r"\$$", r"\\z", out)
