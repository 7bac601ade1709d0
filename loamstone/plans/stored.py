"""Queries over stored tables (incremental extraction, full-text index, mining, liveness), of repositories that share paths, and of patterns as tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.operators import enrich, globs, joins, liveness, pages, reads, stats
from loamstone.operators import fulltext as fts
from loamstone.sources.store import Store
from loamstone.sources.tables import shared_root
from loamstone.streaming import incremental, mining

from .collected import Collected
from .texts import _sql_redacted

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: Buckets of the stores of these queries, whose tables are small.
BUCKETS = 4


# ---- incremental extraction ----------------------------------------------------------------------------------------

_LAST = "last_ as (select repo, path, arg_max(change_id, (changed_at, change_id)) as id, arg_max(status, (changed_at, change_id)) as status from changes group by 1, 2)"


def _maintained(m) -> Store:
    """All changes of files, taken in as three batches in order of time; the second one comes twice."""
    store = Store(m.spark, shared_root(m.spark))
    order = (F.unix_timestamp("changed_at") * 1_000_000 + F.col("change_id")).alias("ord")
    text = F.concat(F.lit('package p\n\nimport "file_'), F.col("change_id") % 100, F.lit('"\n\nfunc F'), F.col("change_id"), F.lit("() {}\n"))
    events = m.changes.select("repo", F.concat("path", F.lit(".go")).alias("path"), "status", text.alias("text"), order, "changed_at")
    parts = [events.filter("changed_at < '1994-06-01'"), events.filter("changed_at >= '1994-06-01' and changed_at < '1996-06-01'"), events.filter("changed_at >= '1996-06-01'")]
    for number, part in zip((0, 1, 1, 2), (parts[0], parts[1], parts[1], parts[2])):
        incremental.apply_batch(store, part.drop("changed_at"), "changes", number, buckets=BUCKETS)
    return store


@query(f"""
with {_LAST}
select repo, path || '.go' as path, predicate, case predicate when 'defines' then 'F' || id else 'file_' || id % 100 end as symbol_name, case predicate when 'defines' then 5 else 3 end as line
from last_, (values ('defines'), ('imports')) p(predicate) where status <> 'D'""")
def incremental_claims(m):
    return _maintained(m).read("claims").select("repo", "path", "predicate", "symbol_name", "line")


@query(f"""
with {_LAST},
held as (select repo, path, case when changed_at < '1994-06-01' then 0 when changed_at < '1996-06-01' then 1 else 2 end as batch, arg_max(status, (changed_at, change_id)) as status from changes group by 1, 2, 3)
select repo, path || '.go' as path, status = 'D' as deleted, case when status <> 'D' then sha256('package p' || chr(10) || chr(10) || 'import "file_' || id % 100 || '"' || chr(10) || chr(10) || 'func F' || id || '() {{}}' || chr(10)) end as content_hash
from last_ l where exists (select 1 from held h where h.repo = l.repo and h.path = l.path and h.status <> 'D')""")
def incremental_files(m):
    """Files that were there at the end of some batch, and whether they are gone."""
    files = _maintained(m).read("files")
    return files.select("repo", "path", "deleted", F.when(~F.col("deleted"), F.col("content_hash")).alias("content_hash"))


# ---- full-text index -----------------------------------------------------------------------------------------------

_TOKENS = "list_filter(string_split_regex(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _begins(word: str, columns: str = "tu") -> str:
    """Where a word stands, those of the second column a million further."""
    each = [f"list_transform(list_filter(range(1, len({c}) + 1), lambda i: {c}[i] = '{word}'), lambda i: i + {1_000_000 * (c == 'u')})" for c in columns]
    return "list_concat(" + ", ".join(each) + ")" if len(each) > 1 else each[0]


def _search_sql(begins: list[str], match: str, counts: list[str] | None = None, rest: str = "") -> str:
    counts = counts or [f"len(s{k})" for k in range(len(begins))]
    parts = " + ".join(f"case when n{k} > 0 then greatest(ln((n_docs - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * n{k} * 2.2 / (n{k} + 1.2 * (0.25 + 0.75 * dl / avg_dl)) else 0 end" for k in range(len(begins)))
    return f"""
with docs as (select id, kind, status, {_TOKENS.format(c="coalesce(body, '')")} as t, {_TOKENS.format(c="coalesce(source_quote, '')")} as u from facts),
p as (select id, kind, status, len(t) + len(u) as dl, {", ".join(f"{b} as s{k}" for k, b in enumerate(begins))} from docs),
size as (select count(*) as n_docs, avg(dl) as avg_dl, {", ".join(f"count(*) filter (len(s{k}) > 0) as df{k}" for k in range(len(begins)))} from p),
n as (select *, {", ".join(f"{c} as n{k}" for k, c in enumerate(counts))} from p where {match})
select id, kind, round({parts}, 6) as score from n, size where status = 'active' {rest} order by round({parts}, 6) desc, id limit 10"""


def _index(facts: DataFrame) -> fts.Index:
    index = fts.Index(Store(facts.sparkSession, shared_root(facts.sparkSession)))
    index.rebuild(facts, BUCKETS)
    return index


_NEAR = "list_filter(list_distinct(list_concat(s0, s1)), lambda m: len(list_filter(s0, lambda x: x <= m and x >= m - 4)) > 0 and len(list_filter(s1, lambda x: x <= m and x >= m - 4)) > 0)"


@query(_search_sql([_begins("license"), _begins("the")], f"len({_NEAR}) > 0", [f"len(list_filter({s}, lambda y: len(list_filter({_NEAR}, lambda l: y <= l and y >= l - 4)) > 0))" for s in ("s0", "s1")]))
def fts_near_search(m):
    """Two words with at most three words between them."""
    return _index(m.facts).search(fts.near(fts.word("license"), fts.word("the"), within=3), m.facts)


@query(_search_sql([_begins("the", "u"), _begins("de")], "len(s0) > 0 or len(s1) > 0"))
def fts_column_search(m):
    """A word in the quotation, or another one anywhere."""
    return _index(m.facts).search(fts.any_of(fts.word("the", "source_quote"), fts.word("de")), m.facts)


@query(_search_sql([_begins("license"), _begins("la"), _begins("der")], "len(s0) > 0 or len(s1) > 0 or len(s2) > 0"))
def fts_best_blocks(m):
    """Words whose best facts are found without reading all blocks of their postings."""
    return _index(m.facts).search(fts.any_of(*map(fts.word, ("license", "la", "der"))), m.facts)


@query(_search_sql([_begins("the"), _begins("la")], "len(s0) > 0 and not len(s1) > 0", ["len(s0)", "0"]))
def fts_synced_search(m):
    """The index of other facts, brought up to date by those that changed: every third had another text, every seventh was not there."""
    then = m.facts.filter("id % 7 <> 0").withColumn("body", F.when(F.col("id") % 3 == 0, F.concat("source_quote", F.lit(" the la la"))).otherwise(F.col("body")))
    index = _index(then)
    index.sync(then.filter("id % 3 = 0"), m.facts.filter("id % 3 = 0 or id % 7 = 0"), "facts", 0)
    index.sync(then.filter("id % 3 = 0"), m.facts.filter("id % 3 = 0 or id % 7 = 0"), "facts", 0)  # comes again
    return index.search(fts.but(fts.word("the"), fts.word("la")), m.facts)


# ---- mining --------------------------------------------------------------------------------------------------------

BUDGET = 400
_NOW = "2024-03-01T00:00:00Z"
_CALLS = f"""
with talks as (select 'repo' || conv_id % 5 as repo, 'file_' || conv_id % 20 as path, conv_id as change, conv_id || ':' || turn as url, conv_id % 3 = 2 as second_, length({_sql_redacted('text')}) as n from conversations),
calls as (select *, case when n % 97 = 5 then 'praise' else (['rationale', 'invariant', 'quirk', '', ''])[n % 5 + 1] end as kind from talks),
f1 as (select repo, path, count(distinct change) as n_observed, count(*) as n_new, bool_or(kind = 'praise') as broken, max(change) as newest, count(*) filter (kind in ('rationale', 'invariant', 'quirk')) as n_facts from calls where not second_ group by 1, 2),
o1 as (select *, case when sum(n_new) over (order by md5(repo || chr(1) || path)) > {BUDGET} then 'budget_exceeded' when broken then 'extraction_failed' else 'mined' end as outcome from f1),
f2 as (select c.repo, c.path, count(distinct change) as n_observed, count(*) as n_new, bool_or(kind = 'praise') as broken, coalesce(max(change) < any_value(o1.newest) filter (o1.outcome = 'mined'), false) as back, count(*) filter (kind in ('rationale', 'invariant', 'quirk')) as n_facts
  from calls c left join o1 on o1.repo = c.repo and o1.path = c.path where second_ group by 1, 2),
o2 as (select *, case when back then 'cursor_regression' when sum(case when back then 0 else n_new end) over (order by md5(repo || chr(1) || path)) > {BUDGET} then 'budget_exceeded' when broken then 'extraction_failed' else 'mined' end as outcome from f2),
told as (select 0 as batch, repo, path, outcome, n_observed, n_new, case when outcome = 'mined' then n_facts else 0 end as n_facts from o1 union all select 1, repo, path, outcome, n_observed, n_new, case when outcome = 'mined' then n_facts else 0 end from o2)
"""


def _mined(m) -> Store:
    """All turns of conversations as review comments, in two batches; the second comes twice."""
    store = Store(m.spark, shared_root(m.spark))
    talk = m.table("conversations")
    comments = talk.select(
        F.concat(F.lit("repo"), F.col("conv_id") % 5).alias("repo"), F.concat(F.lit("file_"), F.col("conv_id") % 20).alias("path"), F.col("conv_id").alias("change"), F.col("text").alias("body"),
        F.lit("@@ -1 +1 @@").alias("hunk"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("url"), F.col("role").alias("author"), F.col("turn").alias("created_at"),
    )
    second = F.col("change") % 3 == 2
    for number, part in ((0, comments.filter(~second)), (1, comments.filter(second)), (1, comments.filter(second))):
        mining.mine(store, part, "comments", number, mining.stand_in, _NOW, BUDGET, "m1", BUCKETS)
    return store


@query(_CALLS + "select * from told")
def mined_outcomes(m):
    return _mined(m).read("outcomes").select("batch", "repo", "path", "outcome", "n_observed", "n_new", "n_facts")


@query(_CALLS + """, taken as (select c.* from calls c join told t on t.repo = c.repo and t.path = c.path and t.batch = c.second_::int and t.outcome = 'mined' where kind in ('rationale', 'invariant', 'quirk'))
select repo, path, kind, 'note ' || n % 7 as body, count(*) as corroboration, 'active' as status from taken group by 1, 2, 3, 4""")
def mined_facts(m):
    return _mined(m).read("facts").select("repo", "path", "kind", "body", "corroboration", "status")


@query(_CALLS + """
select batch as day, count(*) as n_attempts, count(*) filter (outcome = 'mined') as n_mined, count(*) filter (outcome = 'budget_exceeded') as n_over_budget,
  count(*) filter (outcome in ('extraction_failed', 'cursor_regression')) as n_failed, sum(n_facts) as n_facts from told group by 1""")
def mining_attempts(m):
    return mining.attempts_per_day(_mined(m).read("outcomes"), F.col("batch"))


# ---- repositories that share paths ---------------------------------------------------------------------------------


@query("""
select distinct f.repo, f.relative_path from repo_files f join repo_claims c on c.repo = f.repo and c.source_file = f.relative_path join symbols s on s.id = c.subject_id
where s.import_path = 'Brand#3' and not f.deleted""")
def files_for_package_of_repos(m):
    return reads.files_for_package(m.repo_files, m.repo_claims, m.symbols, "Brand#3")


@query("""
with changed as (select distinct repo, relative_path as path from repo_files where never_mined),
defined as (select distinct c.repo, s.import_path from repo_claims c join symbols s on s.id = c.subject_id join changed d on d.repo = c.repo and d.path = c.source_file where c.predicate = 'defines')
select repo, path, 'changed' as why from changed
union all select distinct c.repo, c.source_file, 'depends' from repo_claims c join defined d on d.repo = c.repo and d.import_path = c.object_text where predicate = 'imports'
  and not exists (select 1 from changed x where x.repo = c.repo and x.path = c.source_file)""")
def reverse_deps_of_repos(m):
    changed = m.repo_files.filter("never_mined").select("repo", F.col("relative_path").alias("path"))
    return joins.with_reverse_dependencies(m.symbols, m.repo_claims, changed)


@query("""
with ps as (select repo, source_file, subject_id, count(*) as n from repo_claims group by 1, 2, 3),
pf as (select ps.repo, source_file, count(*) filter (where visibility = 'public') as pub, sum(n) as fan from ps join symbols s on s.id = ps.subject_id group by 1, 2),
kf as (select repo, source_file, sum(k.n) as facts_n from ps join (select subject_id, count(*) as n from facts where status = 'active' group by 1) k using (subject_id) group by 1, 2)
select f.repo, relative_path, never_mined, cast(coalesce(pub, 0) * 3 + coalesce(fan, 0) - coalesce(facts_n, 0) * 5 as bigint) as priority
from repo_files f left join pf on pf.repo = f.repo and pf.source_file = relative_path left join kf on kf.repo = f.repo and kf.source_file = relative_path
where not deleted order by never_mined desc, priority desc, relative_path, f.repo limit 20""")
def mining_priority_of_repos(m):
    return stats.mining_priority(m.repo_files, m.symbols, m.repo_claims, m.facts, 20)


_FILE_SYMBOLS = "case when id % 2 = 0 then concat('file_', id % 100) else import_path end"


@query(f"""
with s as (select id, repo, {_FILE_SYMBOLS} as import_path, visibility from symbols),
per as (select f.repo, f.relative_path, count(distinct s.id) filter (where s.visibility = 'public') as pub, count(c.claim_key) as fan
  from source_files f left join s on s.import_path = f.relative_path and s.repo = f.repo left join claims c on c.subject_id = s.id group by 1, 2),
held as (select s.import_path, count(*) as n from facts k join s on s.id = k.subject_id where k.status = 'active' group by 1)
select f.repo, f.relative_path, never_mined, cast(pub * 3 + fan - coalesce(held.n, 0) * 5 as bigint) as priority
from source_files f join per on per.repo = f.repo and per.relative_path = f.relative_path left join held on held.import_path = f.relative_path
where not deleted order by never_mined desc, priority desc, f.relative_path, f.repo limit 20""")
def file_priority_topk(m):
    """Half of the symbols stand for files: their import path is the file's."""
    return stats.file_priority(m.source_files, m.symbols.withColumn("import_path", F.expr(_FILE_SYMBOLS)), m.claims, m.facts, 20)


@query("""
with known as (select id from symbols where id in (select subject_id from facts where status = 'active')),
covered as (select distinct repo, source_file from repo_claims where subject_id in (select id from known))
select count(*) as live_files, count(c.repo) as covered_files, max(case when never_mined then greatest(date_diff('day', cast(last_indexed as date), date '2024-07-01'), 0) end) as oldest_unmined_days
from repo_files f left join covered c on c.repo = f.repo and c.source_file = relative_path where not deleted""")
def coverage_of_repos(m):
    return stats.coverage(m.repo_files, m.symbols, m.facts, m.repo_claims, F.lit("2024-07-01").cast("timestamp"))


@query("""
with p as (select import_path, max(case when claim_tier = 'semantic' then last_verified end) as seen from symbols left join repo_claims on symbols.id = subject_id group by 1),
f as (select import_path, max(last_indexed) as indexed from symbols join repo_claims c on symbols.id = subject_id join repo_files r on r.repo = c.repo and r.relative_path = c.source_file and not deleted group by 1)
select import_path, seen is null as never, coalesce(cast(indexed as timestamp) > seen, false) as stale from p left join f using (import_path)""")
def enrichment_of_repos(m):
    told = stats.enrichment_status(m.symbols, m.repo_claims, m.repo_files, F.lit("2002-01-01").cast("timestamp"))
    return told.select("import_path", (F.col("enriched") == "Not yet enriched").alias("never"), F.col("enriched").startswith("Enrichment stale").alias("stale"))


# ---- patterns and prefixes of tables -------------------------------------------------------------------------------

_DIRECTIVES = "select 'mod' || p_partkey % 97 || case when p_partkey % 3 = 0 then '/sub' else '' end as old, min('staging/' || p_partkey) as new from part group by 1"


def _directives(m) -> DataFrame:
    key = F.col("p_partkey")
    old = F.concat(F.lit("mod"), key % 97, F.when(key % 3 == 0, "/sub").otherwise(""))
    return m.table("part").groupBy(old.alias("old")).agg(F.min(F.concat(F.lit("staging/"), key)).alias("new"))


@query(f"""
with d as ({_DIRECTIVES}), p as (select distinct 'mod' || p_partkey % 120 || case p_size % 3 when 0 then '' when 1 then '/sub/x' else '/subway@v1/y' end as path from part),
met as (select path, new || substring(path, length(old) + 1) as module, row_number() over (partition by path order by length(old) desc) as place from p join d on path = old or starts_with(path, old || '/'))
select p.path, coalesce(module, regexp_replace(p.path, '^([^@]*)@[^/]*', '\\1')) as module from p left join met on met.path = p.path and place = 1""")
def replaced_modules(m):
    """Every directive is a row of a table, and a path meets the longest of them."""
    path = F.concat(F.lit("mod"), F.col("p_partkey") % 120, F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "/sub/x").otherwise("/subway@v1/y"))
    return globs.replaced_paths(m.table("part").select(path.alias("path")).distinct(), _directives(m))


@query(f"""
with d as ({_DIRECTIVES}), q as (select distinct 'staging/' || p_partkey || '/z' as module from part),
met as (select module, old || substring(module, length(new) + 1) as path, row_number() over (partition by module order by length(new) desc, old desc) as place from q join d on starts_with(module, new || '/'))
select q.module, met.path from q left join met on met.module = q.module and place = 1""")
def original_modules(m):
    modules = m.table("part").select(F.concat(F.lit("staging/"), "p_partkey", F.lit("/z")).alias("module")).distinct()
    return globs.original_paths(modules, _directives(m))


@query("""
with g as (select 'pkg' || p_partkey % 400 || case p_partkey % 4 when 0 then '/*.go' when 1 then '/lib.*' when 2 then '/tools/*/a_test.go' else '/[l-m]*.??' end as glob, 'doc' || p_partkey % 50 || '.md' as doc, p_partkey % 4 as k, p_partkey % 400 as n from part)
select distinct path, doc from sources join g on regexp_matches(path, case k when 0 then '^pkg' || n || '/[^/]*\\.go$' when 1 then '^pkg' || n || '/lib\\.[^/]*$' when 2 then '^pkg' || n || '/tools/[^/]*/a_test\\.go$' else '^pkg' || n || '/[l-m][^/]*\\.[^/][^/]$' end)""")
def manifest_of_table(m):
    """A manifest of as many globs as there are parts; each path is tried against those of its folders."""
    key = F.col("p_partkey")
    glob = F.concat(F.lit("pkg"), key % 400, F.when(key % 4 == 0, "/*.go").when(key % 4 == 1, "/lib.*").when(key % 4 == 2, "/tools/*/a_test.go").otherwise("/[l-m]*.??"))
    manifest = m.table("part").select(glob.alias("glob"), F.concat(F.lit("doc"), key % 50, F.lit(".md")).alias("doc"))
    return globs.manifest_docs(m.sources.select("path"), manifest)


# ---- enrichment plan and liveness ----------------------------------------------------------------------------------


@query("""
with worth as (select s.id, coalesce(f.n, 0) as fan_in from symbols s left join (select object_text, count(*) as n from claims where predicate = 'imports' and object_text is not null group by 1) f on f.object_text = s.import_path
  where s.kind in ('func', 'type', 'method', 'interface') and s.visibility = 'public'),
lost as (select distinct l_partkey as id from lineitem where l_partkey % 11 = 0 and l_partkey in (select l_partkey from lineitem group by 1 having count(*) >= 3)),
ranked as (select *, row_number() over (order by fan_in desc, md5(id::varchar)) as place from worth where id not in (select id from lost)),
capped as (select * from ranked where place <= 120),
known as (select *, id in (select subject_id from claims where claim_tier = 'semantic' and id % 2 = 0) as cached from capped),
todo as (select id, row_number() over (order by fan_in desc, md5(id::varchar)) as turn from known where not cached),
calls as (select k.*, case when cached then 0 else least(4, greatest(0, 150 - (turn - 1) * 4)) end as n_calls from known k left join todo t on t.id = k.id)
select id, fan_in, place, case when cached then 'cached' when n_calls > 0 then 'enrich' else 'over_budget' end as state, n_calls::bigint as n_calls from calls
union all select id, fan_in, null, 'given_up', 0 from worth where id in (select id from lost)""")
def enrichment_plan(m):
    """A cap of 120 symbols and a budget of 150 calls; files of even symbols are as they were when enriched, every eleventh symbol has failed three times."""
    version = F.when(F.col("subject_id") % 2 == 0, F.concat(F.lit("v1@"), F.md5(F.col("subject_id").cast("string")))).otherwise("v1@old")
    hashes = m.symbols.select(F.col("id").alias("subject_id"), F.md5(F.col("id").cast("string")).alias("content_hash"))
    attempts = m.table("lineitem").filter("l_partkey % 11 = 0").select(F.col("l_partkey").alias("subject_id"), F.col("l_orderkey").alias("ord"), F.lit(False).alias("ok"))
    return enrich.plan(m.symbols, m.claims.withColumn("extractor_version", version), hashes, attempts, "v1", 120, 150)


def _there(ref: str) -> tuple[bytes, bool]:
    """A source is gone where its conversation's number ends in 3, and cannot be reached where it ends in 7."""
    number = int(ref.split(":")[0])
    if number % 10 == 7:
        raise TimeoutError(ref)
    return ref.encode(), number % 10 != 3


_CHECKED = """
with refs as (select distinct source_ref as ref, cast(split_part(source_ref, ':', 1) as int) as n from evidence),
first_ as (select ref, n from (select *, row_number() over (order by md5(ref)) as turn from refs) where turn <= 100),
kept as (select ref from first_ where n % 10 <> 7),
second_ as (select ref, n, row_number() over (order by md5(ref)) as turn from refs where ref not in (select ref from kept)),
told as (select ref, case when ref in (select ref from kept) then 'cached' end as how, n from refs where ref in (select ref from kept)
  union all select ref, case when turn > 100 then 'unchecked' when n % 10 = 7 then 'failed' else 'probed' end, n from second_)
"""


def _checked(m) -> DataFrame:
    """The sources of all evidence, asked about twice within a day, each time with a budget of 100 probes."""
    store = Store(m.spark, shared_root(m.spark))
    refs = m.evidence.select("source_ref").distinct()
    liveness.check(store, refs, _there, dt.datetime(2024, 3, 1), 100, buckets=BUCKETS)
    return liveness.check(store, refs, _there, dt.datetime(2024, 3, 1, 12), 100, buckets=BUCKETS)


@query(_CHECKED + "select ref as source_ref, how, case how when 'failed' then null when 'unchecked' then true else n % 10 <> 3 end as live from told")
def source_liveness(m):
    return _checked(m).select("source_ref", "how", "live")


@query(_CHECKED + """, gone as (select distinct fact_id from evidence join told on ref = source_ref where source_type = 'pr_comment' and (how in ('cached', 'probed'))),
changed as (select e.fact_id from evidence e join facts f on f.id = e.fact_id group by 1 having bool_or(e.content_hash <> f.staleness_hash))
select id, status, case when status in ('superseded', 'deleted') then status when subject_id not in (select id from symbols) then 'quarantined'
  when status = 'active' and (id in (select fact_id from changed) or id in (select fact_id from gone)) then 'stale' else status end as new_status from facts""")
def drift_with_liveness(m):
    """A probed source that is there reads otherwise than the fact's own text, so each fact with a known source goes stale."""
    return liveness.live_drift_status(m.facts, m.evidence, m.symbols, _checked(m))


# ---- package pages -------------------------------------------------------------------------------------------------

_PAGED = "case id % 10 when 0 then 'Test' when 5 then 'Example' else 'S' end || case when id % 10 in (0, 5) then id else 1 + id % 200 end"


@query(f"""
with s as (select id, repo, import_path, {_PAGED} as name, case when kind in ('interface', 'method') then 'type' when kind in ('const', 'var') then 'func' else kind end as kind, visibility, language from symbols),
m as (select s.*, c.predicate, c.object_text as o, c.source_file as f, c.claim_tier, c.last_verified, c.claim_key as k from s join page_claims c on c.subject_id = s.id),
own as (select id, bool_or(predicate = 'has_kind' and o = 'interface') as face, arg_min(o, k) filter (predicate = 'has_kind' and o <> '') as first_kind, arg_max(o, k) filter (predicate = 'has_kind') as last_kind,
  coalesce(string_agg(o, ', ' order by k) filter (predicate = 'encloses' and o <> ''), '') as methods from m group by 1),
e as (select s.*, coalesce(face, false) as face, coalesce(nullif(first_kind, ''), 'Other') as fc, coalesce(nullif(last_kind, ''), 'Other') as tc, coalesce(methods, '') as methods from s left join own using (id)),
fn as (select repo, import_path, fc as c, count(*) as n, string_agg(name, ', ' order by name) as l from e where kind = 'func' and visibility = 'public' and not regexp_matches(name, '^(Test|Benchmark|Example)') group by 1, 2, 3),
fns as (select repo, import_path, '## Exported Functions by Category' || chr(10) || chr(10) || string_agg('**' || c || ' (' || n || '):** ' || l || chr(10), chr(10) order by c) || chr(10) as t from fn group by 1, 2),
ty as (select repo, import_path, tc as c, string_agg(name, ', ' order by name) as l from e where kind = 'type' and visibility = 'public' and not face group by 1, 2, 3),
tys as (select repo, import_path, '## Exported Types by Category' || chr(10) || chr(10) || string_agg('**' || c || ':** ' || l || chr(10), chr(10) order by c) || chr(10) as t from ty group by 1, 2),
im as (select repo, import_path, o, string_agg(name, ', ' order by name) as l from m where predicate = 'implements' and o <> '' group by 1, 2, 3),
fs as (select e.repo, e.import_path, '## Exported Interfaces (' || count(*) || ')' || chr(10) || chr(10) || '| Interface | Methods | Key Implementations |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| `' || name || '` | ' || methods || ' | ' || coalesce(l, '—') || ' |', chr(10) order by name, id) || chr(10) || chr(10) as t
  from e left join im on im.repo = e.repo and im.import_path = e.import_path and im.o = e.name where kind = 'type' and visibility = 'public' and face group by 1, 2),
sa as (select repo, import_path, name, string_agg('`' || o || '`', ', ' order by o) as l from m where predicate = 'implements' and o <> '' and visibility = 'public' group by 1, 2, 3),
sas as (select repo, import_path, '## Implements' || chr(10) || chr(10) || string_agg('- `' || name || '` implements ' || l, chr(10) order by name) || chr(10) || chr(10) as t from sa group by 1, 2),
up as (select distinct repo, import_path, substring(o, 13) as u from m where predicate = 'exports' and starts_with(o, 'reverse_dep:')),
ups as (select repo, import_path, '## Used By' || chr(10) || chr(10) || count(*) || ' packages depend on this package:' || chr(10) || chr(10) || string_agg('- `' || u || '`', chr(10) order by u) || chr(10) || chr(10) as t from up group by 1, 2),
dp as (select distinct repo, import_path, o as u from m where predicate = 'imports' and o <> ''),
dps as (select repo, import_path, '## Cross-Package References' || chr(10) || chr(10) || '**Direct dependencies:**' || chr(10) || chr(10) || string_agg('- `' || u || '`', chr(10) order by u) || chr(10) || chr(10) as t from dp group by 1, 2),
tf as (select repo, import_path, f, bool_or(predicate = 'is_test' and o = 'true') as told from m group by 1, 2, 3),
tfs as (select repo, import_path, count(*) filter (not (coalesce(told, false) or ends_with(f, '_test.go'))) as n_s, count(*) filter (coalesce(told, false) or ends_with(f, '_test.go')) as n_t,
  case when bool_or(told) then '## Test Coverage' || chr(10) || chr(10) || count(*) filter (told) || ' test files: ' || string_agg(f, ', ' order by f) filter (told) || chr(10) end as t from tf group by 1, 2),
en as (select repo, import_path, chr(10) || '---' || chr(10) || chr(10) || '## Semantic Enrichment' || chr(10) || chr(10) || '> *Last enriched: ' || strftime(max(last_verified), '%Y-%m-%d %H:%M UTC') || '*' || chr(10) || '>' || chr(10)
  || '> Semantic claims below are AI-generated snapshots and may be stale.' || chr(10) as t from m where claim_tier = 'semantic' group by 1, 2),
pk as (select repo, import_path, arg_min(language, id) as language from s group by 1, 2)
select pk.repo, pk.import_path, '# ' || pk.import_path || chr(10) || chr(10) || '> Tier 1 — Claims-backed structural documentation' || chr(10) || chr(10) || '**Import path:** `' || pk.import_path || '`' || chr(10)
  || case when coalesce(n_s, 0) > 0 or coalesce(n_t, 0) > 0 then '**Source files:** ' || n_s || ' (non-test)' || case when n_t > 0 then ', ' || n_t || ' (test)' else '' end || chr(10) else '' end || '**Language:** ' || language || chr(10) || chr(10)
  || coalesce(fs.t, '') || coalesce(sas.t, '') || coalesce(ups.t, '') || coalesce(dps.t, '') || coalesce(fns.t, '') || coalesce(tys.t, '') || coalesce(tfs.t, '') || coalesce(en.t, '') as markdown
from pk left join fs using (repo, import_path) left join sas using (repo, import_path) left join ups using (repo, import_path) left join dps using (repo, import_path)
  left join fns using (repo, import_path) left join tys using (repo, import_path) left join tfs using (repo, import_path) left join en using (repo, import_path)""")
def package_pages(m):
    kind = F.expr("case when kind in ('interface', 'method') then 'type' when kind in ('const', 'var') then 'func' else kind end")
    symbols = m.symbols.withColumn("symbol_name", F.expr(_PAGED)).withColumn("kind", kind)
    return pages.package_pages(pages.package_sections(symbols, m.page_claims, ["claim_key"]))
