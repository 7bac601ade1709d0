"""Extraction from texts, and drift between documents and code, over texts that every row of a table gives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loamstone.functions import patterns as P
from loamstone.functions import text as T
from loamstone.operators import detect, drift, joins, ownership, reads, stats
from loamstone.sources import code, exports, lines

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _lines(view: str) -> str:
    """Every line of a view's texts: path, n, line."""
    return f"(select path, unnest(range(1, len(l) + 1)) as n, unnest(l) as line from (select path, string_split(text, chr(10)) as l from {view}))"


_SECTIONS = f"""
marked as (select *, sum(cast(line like '## %' as int)) over (partition by path order by n) as s from {_lines('readmes')}),
parts as (select path, max(case when line like '## %' then trim(substring(line, 4)) end) as heading, string_agg(case when line like '## %' then '' else line end, chr(10) order by n) as body from marked group by path, s),
sections as (select path, coalesce(heading, 'Overview') as heading, regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', '') as body from parts where regexp_matches(body, '\\S'))"""


@query(f"with {_SECTIONS} select path, heading, sha256(body) as body_sha256 from sections")
def section_split(m):
    return lines.sections(m.readmes).select("path", "heading", F.sha2("body", 256).alias("body_sha256"))


@query(f"""with {_SECTIONS}, said as (select path, heading, heading || ' ' || substring(body, 1, 500) as x from sections),
found as (select path, heading, unnest(list_concat(regexp_extract_all(x, '`([^`]+)`', 1), regexp_extract_all(x, {_quoted(P.PASCAL)}, 1), regexp_extract_all(x, {_quoted(P.CAMEL)}, 1), regexp_extract_all(x, {_quoted(P.SNAKE)}, 1))) as term from said),
ranked as (select path, heading, term, row_number() over (partition by path, heading order by term) as k from (select distinct path, heading, term from found where length(term) >= 2))
select path, heading, string_agg(term, ',' order by term) as terms from ranked where k <= 8 group by 1, 2""")
def section_key_terms(m):
    terms = lines.key_terms(F.col("heading"), F.col("body"))
    return lines.sections(m.readmes).select("path", "heading", F.array_join(terms, ",").alias("terms")).filter("terms <> ''")


def _reader(system: str, prompt: str) -> str:
    """A stand-in that calls a section accurate if it names a known symbol, and else tells by the heading's length."""
    heading = prompt.split("\n", 1)[0].removeprefix("Section: ")
    known = prompt.rsplit("\n\nSymbols:\n", 1)[1].startswith("- ")
    return json.dumps({"verdict": "accurate" if known else "Stale" if len(heading) % 2 == 0 else "perhaps", "reason": heading})


_PART_SYMBOL = "case p_partkey % 3 when 0 then concat('New', p_partkey, 'Store') when 1 then concat('parseJSON', p_size % 3) else concat('x', p_partkey) end"


@query(f"""with {_SECTIONS}, said as (select path, heading, heading || ' ' || substring(body, 1, 500) as x from sections),
found as (select path, heading, unnest(list_concat(regexp_extract_all(x, '`([^`]+)`', 1), regexp_extract_all(x, {_quoted(P.PASCAL)}, 1), regexp_extract_all(x, {_quoted(P.CAMEL)}, 1), regexp_extract_all(x, {_quoted(P.SNAKE)}, 1))) as term from said),
ranked as (select path, heading, term, row_number() over (partition by path, heading order by term) as k from (select distinct path, heading, term from found where length(term) >= 2)),
known as (select distinct path, heading from ranked where k <= 8 and term in (select {_PART_SYMBOL} from part))
select s.path, s.heading, case when k.path is not null then 'accurate' when length(s.heading) % 2 = 0 then 'stale' else 'unclear' end as verdict, s.heading as reason from sections s left join known k on k.path = s.path and k.heading = s.heading""")
def sections_checked(m):
    """From texts to verdicts: sections, key terms, the symbols named so, the model's reply."""
    symbols = m.table("part").select(F.expr(_PART_SYMBOL).alias("symbol_name"), F.lit("func").alias("kind"), F.concat(F.lit("f"), "p_partkey").alias("file_path"))
    return detect.checked_sections(detect.section_prompts(m.readmes, symbols), _reader).select("path", "heading", "verdict", "reason")


@query(f"""
with s as (select *, sum(cast(contains(line, '/*') as int)) over w - sum(cast(contains(line, '*/') as int)) over w + cast(contains(line, '*/') as int) as open_ from {_lines('sources')} window w as (partition by path order by n)),
c as (select path, n, regexp_replace(regexp_replace(trim(case when open_ > 0 then line else regexp_extract(line, '((?://|#).*)$', 1) end), '^(?://+|#+|/?\\*+)\\s*', ''), '\\s*\\*/\\s*$', '') as comment from s),
f as (select path, n, comment, upper(regexp_extract(comment, {_quoted(P.MARKER)}, 1)) as marker from c where regexp_matches(comment, {_quoted(P.MARKER)}))
select path, n as line_no, marker, comment, case when marker in ('TODO', 'FIXME', 'XXX') then 'todo' else 'quirk' end as kind from f""")
def line_markers(m):
    return lines.markers(m.sources).select("path", "line_no", "marker", "comment", "kind")


@query(f"""
with s as (select path, n, regexp_extract(line, '^func (?:\\([^)]*\\) )?([A-Za-z_][A-Za-z0-9_]*)', 1) as f, line from {_lines('sources')})
select path, n as line_no, 'panic' as form, last_value(nullif(f, '') ignore nulls) over (partition by path order by n) as function, trim(line) as statement from s qualify contains(line, ' panic(')""")
def code_invariants(m):
    return lines.invariants(m.sources)


@query(f"""
with r as (select path, n, trim(regexp_replace(line, '\\s*#.*$', '')) as rule from {_lines('owner_files')}), p as (select path, n, string_split_regex(rule, '\\s+') as p from r where rule <> '')
select path, n as line_no, p[1] as pattern, unnest(p[2:]) as owner from p where len(p) >= 2""")
def codeowners_rules(m):
    return lines.code_owners(m.owner_files)


@query(f"""
with l as (select *, nullif(regexp_extract(line, '^--- (?:a/)?(.*)$', 1), '') as o, nullif(regexp_extract(line, '^\\+\\+\\+ (?:b/)?(.*)$', 1), '') as w from {_lines('diffs')}),
p as (select *, last_value(o ignore nulls) over (partition by path order by n) as old_file, last_value(w ignore nulls) over (partition by path order by n) as new_file from l),
h as (select path, case when new_file = '/dev/null' then old_file else new_file end as file, regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', ['a', 'b', 'c', 'd']) as x from p where regexp_matches(line, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@'))
select path, file, cast(x.a as int) as old_start, coalesce(cast(nullif(x.b, '') as int), 1) as old_count, cast(x.c as int) as new_start, coalesce(cast(nullif(x.d, '') as int), 1) as new_count from h""")
def diff_hunks(m):
    return lines.hunks(m.diffs).select("path", "file", "old_start", "old_count", "new_start", "new_count")


@query(f"select path, n as line_no, line from {_lines('diffs')} where starts_with(line, '@@') and not regexp_matches(line, '^@@ -[0-9,]+ [+][0-9,]+ @@')")
def diff_errors(m):
    return lines.diff_errors(m.diffs)


@query(f"""
with l as (select path, n, regexp_extract(line, '^\\s*-\\s+\\[[^\\]]+\\]\\(/([^?#)]+?)/-/blob/([^?#)]+)\\?(?:[^#)]*&)?L(\\d+)(?:-(\\d+))?\\)', ['r', 'f', 'a', 'b']) as x from {_lines('answers')})
select distinct path, x.r as repo, x.f as file, cast(x.a as int) as first, coalesce(cast(nullif(x.b, '') as int), cast(x.a as int)) as last from l where x.r <> ''""")
def citation_parse(m):
    return lines.citations(m.answers).select("path", "repo", "file", "first", "last")


_NO_PACKAGE = " and ".join(f"not starts_with(x, '{p}')" for p in P.NO_PACKAGE)
_REFS = f"""
l as (select path, regexp_replace(path, '/[^/]*$', '') as folder, line, trim(line) as bare from {_lines('readmes')} where not (starts_with(trim(line), '[') and contains(line, ']:'))),
names as (select distinct path, folder, unnest(list_concat(list_filter(regexp_extract_all(line, {_quoted(P.BACKTICK)}, 1), lambda x: length(x) >= 2 and not regexp_matches(x, '^v[0-9]')),
  case when starts_with(bare, '```') then [] else list_filter(regexp_extract_all(line, {_quoted(P.PROSE)}), lambda x: length(x) >= 2) end)) as name from l),
packages as (select distinct path, folder, unnest(list_concat(regexp_extract_all(line, '{P.PACKAGE}'), case when contains(line, '://') then [] else list_filter(regexp_extract_all(line, {_quoted(P.RELATIVE_PACKAGE)}, 1), lambda x: {_NO_PACKAGE}) end)) as name from l)"""


@query(f"with {_REFS} select path, name, false as is_package from names union all select path, name, true from packages")
def readme_references(m):
    return lines.references(m.readmes)


_EXPORTS = f"""
src as (select *, case when line in ('var (', 'const (', 'type (') then 1 when line = ')' then -1 else 0 end as step from {_lines('sources')}),
blocks as (select *, sum(step) over (partition by path order by n) as depth from src),
raw as (
  select path, case when m.t <> '' then m.t || '.' || m.n else m.n end as name from (select path, regexp_extract(line, '^func (?:\\((?:\\w+ )?\\*?(\\w+)\\) )?(\\w+)\\(', ['t', 'n']) as m from src where path like '%/a.go') where m.n <> '' and regexp_matches(m.n, '^[A-Z]')
  union all select path, unnest(string_split(regexp_extract(line, '^(?:type|var|const) (\\w+(?:, \\w+)*)', 1), ', ')) from src where path like '%/a.go' and regexp_matches(line, '^(type|var|const) \\w')
  union all select path, regexp_extract(line, '^\\t(\\w+)', 1) from blocks where path like '%/a.go' and depth = 1 and line <> 'var ('
  union all select path, regexp_extract(line, '^(?:async )?(?:def|class) (\\w+)', 1) from src where path like '%.py'
  union all select path, regexp_extract(line, '^(\\w+)(?:: \\w+)? = ', 1) from src where path like '%.py'
  union all select path, regexp_extract(line, '^export (?:default )?(?:function|class|type|const) (\\w+)', 1) from src where path like '%.ts'
  union all select path, regexp_extract(trim(x), '^\\w+') from (select path, unnest(string_split(regexp_extract(line, '^export [{{]([^}}]*)[}}]', 1), ',')) as x from src where path like '%.ts')),
known as (select distinct regexp_replace(path, '/[^/]*$', '') as folder, name, regexp_replace(name, '^[^.]+\\.', '') as bare from raw where name <> '' and not starts_with(name, '_') and (path not like '%.go' or regexp_matches(name, '^[A-Z]') or contains(name, '.')))"""


@query(f"with {_EXPORTS} select folder, name from known")
def export_sets(m):
    return exports.exports(m.sources)


_FOUND = f"""with {_REFS}, {_EXPORTS},
files as (select path from sources union all select path from readmes), folders as (select distinct array_to_string(p[:k], '/') as folder from (select p, unnest(range(1, len(p))) as k from (select string_split(path, '/') as p from files))),
found as (
  select path, 'stale' as finding, name from names n where not exists (select 1 from known k where k.folder = n.folder and (k.name = n.name or k.bare = n.name))
  union all select r.path, 'undocumented', k.name from known k join readmes r on regexp_replace(r.path, '/[^/]*$', '') = k.folder where not exists (select 1 from names n where n.path = r.path and n.name in (k.name, k.bare))
  union all select path, 'stale_package', name from packages p where not starts_with(name, 'k8s.io/') and folder || '/' || name not in (select folder from folders))
"""


@query(_FOUND + "select * from found")
def readme_drift(m):
    return drift.findings(m.readmes, m.sources)


@query(_FOUND + "select path, count(finding) filter (finding = 'stale') as stale, count(finding) filter (finding = 'undocumented') as undocumented, count(finding) filter (finding = 'stale_package') as stale_package from readmes left join found using (path) group by 1")
def drift_reports(m):
    return drift.reports(m.readmes, drift.findings(m.readmes, m.sources))


_BRANCH = " or ".join(f"starts_with(lower(x), '{p}')" for p in P.BRANCH_PREFIXES)
_PAIRS = ", ".join(f"'{p}'" for p in P.SLASH_PAIRS)
_PATH = f"contains(x, '/') and not (contains(x, '://') or starts_with(x, '$') or contains(x, '*') or contains(x, '...') or length(x) < 3 or {_BRANCH} or lower(x) in ({_PAIRS}))"
_EXT = "|".join(P.CODE_EXTENSIONS)
_CLAIMED = f"""
cl as (select path, n, line, regexp_replace(line, {_quoted(P.LINK)}, '\\2', 'g') as said, sum(cast(starts_with(trim(line), '```') as int)) over (partition by path order by n) as fences from {_lines('contexts')}),
kept as (select * from cl where fences % 2 = 0 and not starts_with(trim(line), '```')),
claimed as (select path, kind, value, min(n) as line_no from (
  select path, n, 'file_path' as kind, unnest(list_concat(list_filter(regexp_extract_all(said, {_quoted(P.QUOTED_PATH)}, 1), lambda x: {_PATH}), list_filter(regexp_extract_all(said, {_quoted(P.BARE_PATH)}, 1), lambda x: {_PATH} and regexp_matches(lower(x), '\\.({_EXT})$')))) as value from kept
  union all select path, n, 'package_ref', unnest(regexp_extract_all(line, {_quoted(P.GO_IMPORT)}, 1)) from kept) group by 1, 2, 3)"""


@query(f"with {_CLAIMED} select path, kind, value, line_no from claimed")
def context_claims(m):
    return lines.context_claims(m.contexts)


def _normal(column: str) -> str:
    seen = f"list_prepend([]::varchar[], list_transform(string_split({column}, '/'), lambda s: [s]))"
    return f"array_to_string(list_reduce({seen}, lambda a, b: case when b[1] in ('', '.') then a when b[1] = '..' then a[:greatest(len(a) - 1, 0)] else list_concat(a, b) end), '/')"


_UNSEARCHED = ", ".join(f"'{f}'" for f in P.UNSEARCHED_FOLDERS)
_CHECKED = f"""{_CLAIMED},
everything as (select path from tree union all select path from contexts),
heads as (select distinct array_to_string(p[:k], '/') as known, k < len(p) as is_folder from (select p, unnest(range(1, len(p) + 1)) as k from (select string_split(path, '/') as p from everything))),
tails as (select distinct array_to_string(p[k:], '/') as known from (select p, unnest(range(1, len(p) + 1)) as k from (select string_split(known, '/') as p from heads) where not list_has_any(p, [{_UNSEARCHED}]))),
placed as (select path as context_file, value, {_normal('value')} as at_root, {_normal("concat(regexp_replace(path, '/?[^/]*$', ''), '/', regexp_replace(value, '^\\./', ''))")} as beside from claimed where kind = 'file_path'),
checked as (select context_file, value, case when at_root in (select known from heads where not is_folder) then 'exact' when at_root in (select known from heads) then 'directory' when beside in (select known from heads) then 'relative'
  when at_root in (select known from tails) then 'suffix' else 'missing' end as found_as from placed)"""


def _checked(m):
    claims = lines.context_claims(m.contexts).filter("kind = 'file_path'").select(F.col("path").alias("context_file"), "value")
    return drift.path_claims(claims, m.tree.unionByName(m.contexts.select("path")))


@query(f"with {_CHECKED} select context_file, value, found_as, found_as <> 'missing' as valid from checked")
def context_path_claims(m):
    return _checked(m)


@query(f"""with {_CHECKED}, per as (select context_file, count(*) as n_claims, count(*) filter (found_as <> 'missing') as n_valid from checked group by 1)
select context_file, n_claims, n_valid, cast(floor(n_valid * 100 / n_claims) as bigint) as percent from (select * from per union all select '(all)', sum(n_claims), sum(n_valid) from per)""")
def ai_context_accuracy(m):
    return stats.accuracy(_checked(m))


@query(_FOUND.rstrip() + f""", {_CHECKED.strip()}
select *, stale + stale_package + stale_context > 0 as has_drift from (select count(*) filter (finding = 'stale') as stale, count(*) filter (finding = 'undocumented') as undocumented, count(*) filter (finding = 'stale_package') as stale_package,
  (select count(*) from checked where found_as = 'missing') as stale_context from found)""")
def repo_check(m):
    return drift.repo_check(drift.findings(m.readmes, m.sources), _checked(m))


_NAMED = "case when p_partkey % 2 = 0 then concat('store.Open', p_partkey % 60) else concat('parsejson', p_partkey % 5) end"


@query(f"""with {_REFS}, syms as (select p_partkey as id, p_brand as import_path, {_NAMED} as symbol_name from part), held as (select lower(symbol_name) as key, count(distinct import_path) as n from syms group by 1),
gone as (select subject_id, source_file from claims where predicate = 'defines' and source_file not in (select concat('file_', s_suppkey) from supplier where s_suppkey % 30 <> 7))
select path, name, 'HIGH' as severity, 'not found' as detail from names where lower(name) not in (select key from held)
union all select path, name, 'MEDIUM', n || ' packages' from names join held on key = lower(name) where n > 1
union all select path, name, 'HIGH', 'file gone: ' || source_file from names join syms on lower(symbol_name) = lower(name) join gone on subject_id = id""")
def readme_symbol_claims(m):
    symbols = m.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("import_path"), F.expr(_NAMED).alias("symbol_name"))
    files = m.table("supplier").filter("s_suppkey % 30 <> 7").select(F.expr("concat('file_', s_suppkey)").alias("path"))
    return drift.readme_symbols(lines.references(m.readmes).filter("not is_package"), symbols, m.claims, files)


@query("""
select doc, pattern from (select path as doc, regexp_replace(path, '[^/]*$', '') as folder from readmes) join
  (select distinct regexp_replace(path, '[^/]*$', '') as folder, regexp_replace(path, '[^/]*$', '') || '*.' || regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) as pattern from sources) using (folder)""")
def manifest_generation(m):
    return lines.manifest_of(m.readmes.select("path").unionByName(m.sources.select("path")))


@query("""
with f as (select path, path like '%.go' as g, path like '%.py' as p from sources)
select path, case when g then 'go' when p then 'python' else 'typescript' end as language, path like '%_test.go' as is_test from f""")
def source_languages(m):
    found = code.extract(m.sources).groupBy("path", "language").agg(F.bool_or(F.col("predicate") == "is_test").alias("is_test"))
    return found.select("path", "language", "is_test")


@query("""select claim_key, predicate from claims where predicate not in ('defines', 'imports', 'exports', 'has_doc', 'is_test', 'is_generated')""")
def tier_violations(m):
    return code.beyond_tier(m.claims).select("claim_key", "predicate")


@query("""
with docs as (select path, 'README.md' as n from readmes union all select replace(path, 'README.md', x), x from readmes, (values ('README.zh.md'), ('notes.md'), ('SECURITY.md'), ('.cursorrules'), ('vendor/README.md'), ('internal/README.md'), ('sub/AGENTS.md'), ('AGENTS.md.txt')) v(x))
select path, 'document' as kind from docs where regexp_matches(path, '(^|/)(README(\\.[^/]*)?|AGENTS|SECURITY)\\.md$') and not contains(path, '/vendor/') and not contains(path, '/internal/')
union all select path, 'context' from docs where regexp_matches(path, '(^|/)(AGENTS\\.md|\\.cursorrules)$') and not contains(path, '/vendor/')""")
def document_discovery(m):
    names = ("README.md", "README.zh.md", "notes.md", "SECURITY.md", ".cursorrules", "vendor/README.md", "internal/README.md", "sub/AGENTS.md", "AGENTS.md.txt")
    paths = m.readmes.select(F.explode(F.array(*[F.replace("path", F.lit("README.md"), F.lit(n)) for n in names])).alias("path"))
    found = reads.document_files(paths, exclude=("# drafts", "", "internal/")).withColumn("kind", F.lit("document"))
    return found.unionByName(reads.context_files(paths).withColumn("kind", F.lit("context")))


_FACED = "concat('Face', subject_id % 3)"


@query(f"""
with faces as (select distinct import_path, concat('Face', id % 4) as interface from symbols where kind = 'interface'),
tied as (select distinct s.import_path, {_FACED} as interface, s.symbol_name as type_ from claims c join symbols s on s.id = c.subject_id where c.predicate = 'implements')
select import_path, interface, coalesce(string_agg(type_, ',' order by type_), '') as types from faces left join tied using (import_path, interface) group by 1, 2""")
def package_interfaces(m):
    symbols = m.symbols.withColumn("symbol_name", F.expr("case when kind = 'interface' then concat('Face', id % 4) else symbol_name end"))
    named = m.symbols.withColumn("kind", F.lit("type"))
    claims = m.claims.withColumn("object_text", F.expr(f"case when predicate = 'implements' then {_FACED} end"))
    return stats.package_interfaces(symbols, claims, named).select("import_path", "interface", F.array_join("types", ",").alias("types"))


@query("select path, regexp_replace(path, '/?[^/]*$', '') as folder from sources")
def source_folders(m):
    return m.sources.select("path", T.folder_of(F.col("path")).alias("folder"))


_DECLARED = """
rows_ as (select *, p_partkey % 3 as k from part),
declared as (
  select 's' || p_partkey || '/n.go' as path, unnest([
      struct_pack(name := 'Outer' || p_partkey, kind := 'func', owner := null::varchar, line := 4, end_line := 11, doc := 'Doc of Outer' || p_partkey || '.'),
      struct_pack(name := 'T' || p_size, kind := 'type', owner := null::varchar, line := 13, end_line := 15, doc := null::varchar),
      struct_pack(name := 'Do', kind := 'method', owner := 'T' || p_size, line := 17, end_line := 17, doc := null::varchar)]) as d from rows_ where k = 0
  union all select 's' || p_partkey || '/n.ts', unnest([
      struct_pack(name := 'A' || p_partkey, kind := 'class', owner := null::varchar, line := 1, end_line := 5, doc := null::varchar),
      struct_pack(name := 'run', kind := 'method', owner := 'A' || p_partkey, line := 2, end_line := 4, doc := null::varchar),
      struct_pack(name := 'outer' || p_partkey, kind := 'func', owner := null::varchar, line := 7, end_line := 9, doc := 'function hidden() {}'),
      struct_pack(name := 'inner', kind := 'func', owner := 'outer' || p_partkey, line := 8, end_line := 8, doc := null::varchar),
      struct_pack(name := 'E' || p_size, kind := 'enum', owner := null::varchar, line := 10, end_line := 10, doc := null::varchar)]) from rows_ where k = 1
  union all select 's' || p_partkey || '/n.sh', struct_pack(name := 'start' || p_partkey, kind := 'func', owner := null::varchar, line := 2, end_line := 7, doc := 'Starts ' || p_partkey || '.') from rows_ where k = 2
)"""


@query(f"with {_DECLARED} select path, d.name, d.kind, d.owner, d.line, d.end_line, d.doc from declared")
def code_declarations(m):
    """Code inside strings, templates, here-documents and comments declares nothing; nested functions have owners."""
    return code.declarations(m.snippets).select("path", "name", "kind", "owner", "line", "end_line", "doc")


@query("""
select 's' || p_partkey || '/n.go' as path, unnest([9, 17]) as line_no, 'panic' as form, unnest(['Outer' || p_partkey, 'Do']) as enclosing, unnest(['func', 'method']) as enclosing_kind from part where p_partkey % 3 = 0""")
def enclosed_invariants(m):
    found = lines.invariants(m.snippets).select("path", "line_no", "form")
    return ownership.innermost(found, code.declarations(m.snippets), ["path"])


_OWNED = """
r as (select s.symbol_id, b.author, b.line, b.commit, b.at as moment from blame b join placed_symbols s on b.file = s.file and b.line between s.start_line and s.end_line),
a as (select symbol_id, author, count(*) as n, arg_max(commit, (moment, commit)) as latest from r group by 1, 2),
t as (select symbol_id, sum(n) as total from a group by 1),
d as (select symbol_id, line // 64 as bucket, sha256(string_agg(commit || ':' || line || chr(10), '' order by line, commit)) as digest from r group by 1, 2),
h as (select symbol_id, sha256(string_agg(digest, '' order by bucket)) as hash from d group by 1)"""


@query(f"""
with {_OWNED}
select a.symbol_id as subject_id, 'Ownership: ' || string_agg(author || ' (' || (n * 100 // total)::bigint || '%, ' || n || '/' || total::bigint || ' lines)', '; ' order by n desc, author) as body,
  'blame: top contributor ' || arg_min(author, (-n, author)) as source_quote, any_value(hash) as staleness_hash from a join t using (symbol_id) join h using (symbol_id) group by 1""")
def symbol_ownership(m):
    facts, _ = ownership.symbol_ownership(m.blame, m.placed_symbols, ["file"])
    return facts.select("subject_id", "body", "source_quote", "staleness_hash")


@query(f"with {_OWNED} select a.symbol_id as subject_id, author, latest as source_ref, n as lines, hash as content_hash from a join h using (symbol_id)")
def symbol_ownership_evidence(m):
    _, evidence = ownership.symbol_ownership(m.blame, m.placed_symbols, ["file"])
    return evidence.select("subject_id", "author", "source_ref", "lines", "content_hash")


@query(f"""
with later as (select * from blame), {_OWNED.replace("from blame b", "from later b")}, now as (select symbol_id, hash from h),
before_ as (select s.symbol_id, b.line, b.commit from blame b join placed_symbols s on b.file = s.file and b.line between s.start_line and s.end_line where b.author <> 'user3'),
bd as (select symbol_id, line // 64 as bucket, sha256(string_agg(commit || ':' || line || chr(10), '' order by line, commit)) as digest from before_ group by 1, 2),
bh as (select symbol_id, sha256(string_agg(digest, '' order by bucket)) as hash from bd group by 1)
select symbol_id as subject_id, 'changed' as why from bh join now using (symbol_id) where bh.hash <> now.hash""")
def stale_symbol_ownership(m):
    """Symbols with lines that an author has touched since their ownership was taken down."""
    then, _ = ownership.symbol_ownership(m.blame.filter("author <> 'user3'"), m.placed_symbols, ["file"])
    now, _ = ownership.symbol_ownership(m.blame, m.placed_symbols, ["file"])
    return ownership.stale_ownership(then, now).select("subject_id", "why")
