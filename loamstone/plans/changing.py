"""Maintenance, diff, drift and verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.operators import drift, joins, merge, reads, stats

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql

def _now():
    return F.lit("2024-07-01").cast("date")

_CURRENT = """current as (select concat('repo', o_custkey % 5) as repo, concat('file_', o_custkey % 100) as relative_path, max(sha256(o_orderstatus)) as content_hash
  from orders group by 1, 2)"""


def _current(m):
    """What the working tree holds: a hash per changed path."""
    return m.table("orders").groupBy(F.expr("concat('repo', o_custkey % 5)").alias("repo"), F.expr("concat('file_', o_custkey % 100)").alias("relative_path")).agg(F.max(F.sha2("o_orderstatus", 256)).alias("content_hash"))


@query("""
with wanted as (select repo, relative_path, case when size_bytes % 3 = 0 then 'changed' else content_hash end as content_hash, 'v' || size_bytes % 2 as extractor, case when size_bytes % 4 = 0 then 'g1' end as grammar from source_files),
held as (select repo, relative_path, content_hash, deleted, 'v1' as extractor, case when size_bytes % 8 = 0 then 'g1' else '' end as grammar from source_files)
select repo, relative_path, content_hash from wanted w where exists (select 1 from held h where not h.deleted and h.repo = w.repo and h.relative_path = w.relative_path and h.content_hash = w.content_hash
  and h.extractor = w.extractor and coalesce(h.grammar, '') = coalesce(w.grammar, ''))""")
def cache_hit_files(m):
    files = m.source_files
    wanted = files.select("repo", "relative_path", F.expr("case when size_bytes % 3 = 0 then 'changed' else content_hash end as content_hash"), F.expr("concat('v', size_bytes % 2) as extractor"), F.expr("case when size_bytes % 4 = 0 then 'g1' end as grammar"))
    held = files.select("repo", "relative_path", "content_hash", "deleted", F.lit("v1").alias("extractor"), F.expr("case when size_bytes % 8 = 0 then 'g1' else '' end as grammar"))
    return reads.cache_hits(held, wanted).select("repo", "relative_path", "content_hash")


@query("with " + _CURRENT + """
select repo, relative_path, case when n.content_hash is null then 'tombstone' when o.content_hash is null then 'new' else 'changed' end as action
from (select * from source_files where not deleted) o full outer join current n using (repo, relative_path)
where n.content_hash is null or o.content_hash is null or o.content_hash <> n.content_hash""")
def cache_reconcile(m):
    return merge.reconcile(m.source_files, _current(m))


@query("""
select repo, relative_path, deleted, size_bytes from (select *, sum(size_bytes) over (partition by repo) as total,
  coalesce(sum(size_bytes) over (partition by repo order by deleted desc, last_indexed, relative_path rows between unbounded preceding and 1 preceding), 0) as before from source_files)
where total - before > 1500""")
def cache_evict(m):
    return stats.eviction(m.source_files, F.lit(1500))


@query("""
with incoming as (select * replace ('new' as object_text) from claims where source_line % 10 = 0 and predicate = 'has_doc'),
after as (select * from claims c where not exists (select 1 from incoming i where i.extractor = c.extractor and i.source_file = c.source_file) union all select * from incoming)
select extractor, count(*) as n_claims, count(*) filter (where object_text = 'new') as n_new from after group by 1""")
def replace_file_claims(m):
    incoming = m.claims.filter("source_line % 10 = 0 and predicate = 'has_doc'").withColumn("object_text", F.lit("new"))
    after = merge.replace_claims(m.claims, incoming)
    return after.groupBy("extractor").agg(F.count(F.lit(1)).alias("n_claims"), F.sum((F.coalesce("object_text", F.lit("")) == "new").cast("long")).alias("n_new"))


@query("select claim_tier, count(*) as n_claims from claims where not (claim_tier = 'semantic' and confidence < 0.95) group by 1")
def delete_low_confidence(m):
    return merge.delete_uncertain(m.claims, 0.95).groupBy("claim_tier").agg(F.count(F.lit(1)).alias("n_claims"))


@query("select doc_id from documents where not regexp_matches(coalesce(text, ''), '(?i)(password|secret|token|credential|api_key)')")
def delete_sensitive(m):
    return merge.delete_sensitive(m.table("documents"), "text").select("doc_id")


@query("""
select repo, count(*) as n_symbols, count(*) filter (where visibility = 'private') as n_private from
(select repo, import_path, symbol_name, case when id % 3 = 0 then 'private' else visibility end as visibility from symbols) group by 1""")
def upsert_symbols(m):
    overlay = m.symbols.filter("id % 3 = 0").withColumn("visibility", F.lit("private"))
    after = merge.upsert(m.symbols, overlay, ["repo", "import_path", "symbol_name"])
    return after.groupBy("repo").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum((F.col("visibility") == "private").cast("long")).alias("n_private"))


@query("""
select repo, relative_path, deleted or (repo, relative_path) in (select repo, path from changes where status = 'D') as deleted from source_files""")
def tombstone_files(m):
    gone = m.changes.filter("status = 'D'").select("repo", F.col("path").alias("relative_path"))
    return merge.tombstone(m.source_files, gone).select("repo", "relative_path", "deleted")


@query("""
select count(*) as n_claims from claims where not (claim_tier = 'semantic' and extractor = 'ex-A' and subject_id in (select id from symbols where import_path = 'Brand#3'))""")
def delete_package_semantics(m):
    return merge.delete_semantic(m.claims, m.symbols, "ex-A", "Brand#3").agg(F.count(F.lit(1)).alias("n_claims"))


@query("""
with keyed as (select id % 20 as subject_id, kind, sha256(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
  '@[A-Za-z0-9_-]+', '', 'g'), '\\w+\\.go:\\d+', '', 'g'), '\\bL\\d+\\b', '', 'g'), '[ \\t\\n\\f\\r]+$', ''), '[.!?:;]+$', '')), '[ \\t\\n\\f\\r]+', ' ', 'g'))) as cluster_key, id, ord, corroboration, last_verified from facts),
calls as (select *, row_number() over (partition by subject_id, kind, cluster_key order by ord, id) as call from keyed),
refs as (select distinct subject_id, kind, cluster_key, call, last_verified, regexp_replace(source_ref, '^[0-9]+', '') as ref from calls join evidence on fact_id = id),
brought as (select distinct subject_id, kind, cluster_key, call, last_verified from refs r where not exists (select 1 from refs x where x.subject_id = r.subject_id and x.kind = r.kind and x.cluster_key = r.cluster_key and x.ref = r.ref and x.call < r.call)),
more as (select subject_id, kind, cluster_key, count(*) as more, arg_max(last_verified, call) as seen_at from brought where call > 1 group by 1, 2, 3)
select subject_id, kind, cluster_key, id, corroboration + coalesce(more, 0) as corroboration, cast(coalesce(seen_at, last_verified) as varchar) as last_verified, n_rows
from calls left join more using (subject_id, kind, cluster_key) join (select subject_id, kind, cluster_key, count(*) as n_rows from keyed group by 1, 2, 3) using (subject_id, kind, cluster_key) where call = 1""")
def fact_cluster_merge(m):
    facts = m.facts.withColumn("subject_id", F.col("id") % 20)
    evidence = m.evidence.select("fact_id", F.regexp_replace("source_ref", "^[0-9]+", "").alias("source_ref"))
    return merge.merge_facts(facts, evidence).select("subject_id", "kind", "cluster_key", "id", "corroboration", F.col("last_verified").cast("string").alias("last_verified"), "n_rows")


@query("""
with tok as (select id, list_distinct(list_filter(string_split_regex(lower(body), '\\s+'), lambda t: t <> '')) as t, sha256(body) as k from facts),
recent as (select * from tok order by id desc limit 200),
l as (select id, k, len(t) as n, unnest(t) as token from tok), r as (select id as other, k as ok, len(t) as m, unnest(t) as token from recent),
met as (select id, other, n, m, count(*) as shared from l join r using (token) where k <> ok group by 1, 2, 3, 4)
select id, arg_max(other, (round(shared / cast(n + m - shared as double), 9), other)) as nearest, max(round(shared / cast(n + m - shared as double), 9)) as jaccard from met group by 1""")
def nearest_body_jaccard(m):
    return merge.nearest_body(m.facts)


@query("""
with per as (select repo, list_sort(list_distinct(list(change_id) filter (where status <> 'D'))) as seen, list_sort(list_distinct(list(change_id) filter (where new_count > 1))) as observed from changes group by 1)
select repo, len(list_distinct(list_concat(seen, observed))) as n_seen, len(list_filter(observed, lambda x: not list_contains(seen, x))) as n_new, coalesce(list_max(observed) < list_max(seen), false) as went_back from per""")
def pr_cursor_merge(m):
    per = m.changes.groupBy("repo").agg(F.collect_set(F.when(F.col("status") != "D", F.col("change_id"))).alias("seen"), F.collect_set(F.when(F.col("new_count") > 1, F.col("change_id"))).alias("observed"))
    known, new, back = merge.cursor(F.col("seen"), F.col("observed"))
    return per.select("repo", F.size(known).cast("long").alias("n_seen"), F.size(new).cast("long").alias("n_new"), back.alias("went_back"))


@query("""
with ch as (select e.fact_id, bool_or(e.content_hash <> f.staleness_hash) as changed from evidence e join facts f on f.id = e.fact_id group by 1)
select id, status, case when status in ('superseded', 'deleted') then status when subject_id not in (select id from symbols) then 'quarantined'
  when status = 'active' and coalesce(changed, false) then 'stale' else status end as new_status from facts left join ch on ch.fact_id = facts.id""")
def fact_drift_status(m):
    return merge.drift_status(m.facts, m.evidence, m.symbols)


@query("""
select id, cast(last_verified as varchar) as last_verified, row_number() over (order by last_verified, id) as position, row_number() over (order by last_verified, id) <= 20 as within_budget
from (select * from facts where status = 'active' and model <> '' and last_verified < date '2024-02-10' order by last_verified, id limit 50)""")
def reverify_plan(m):
    plan = reads.reverify_plan(m.facts, F.lit("2024-02-10").cast("date"), 50, 20)
    return plan.select("id", F.col("last_verified").cast("string").alias("last_verified"), F.col("position").cast("long").alias("position"), "within_budget")


@query("""
select id, case when id % 3 = 2 then 'stale' else status end as status, round(case when id % 3 = 1 then confidence * 0.6e0 else confidence end, 9) as confidence,
  cast(case when id % 3 = 0 then date '2024-07-01' else last_verified end as varchar) as last_verified from facts""")
def reverify_outcome(m):
    verdicts = m.facts.select("id", F.when(F.col("id") % 3 == 0, "accept").when(F.col("id") % 3 == 1, "downgrade").otherwise("reject").alias("verdict"))
    return merge.apply_verdicts(m.facts, verdicts, _now()).withColumn("last_verified", F.col("last_verified").cast("string"))


@query("""
select status, count(*) as n_facts from (select case when id in (select fact_id from corrections where action = 'delete') then 'deleted'
  when id in (select fact_id from corrections where action = 'supersede') then 'superseded' else status end as status from facts) group by 1""")
def corrected_facts(m):
    return merge.correct(m.facts, m.corrections).groupBy("status").agg(F.count(F.lit(1)).alias("n_facts"))


_DRIFT = """
with sharp as (select * from doc_manifests where not fuzzy),
at_place as (select entry_id, min(p.symbol_id) as located_id from sharp e join placed_symbols p on p.repo = e.repo and p.file = e.file and p.start_line <= e.end_line and p.end_line >= e.start_line where e.file <> '' and e.start_line > 0 group by 1),
marked as (select e.doc_id, e.pos, case when e.symbol_id is not null and c.symbol_id is null then case when located_id <> e.symbol_id then 'renamed' else 'deleted' end
  when e.symbol_id is not null and e.signature <> '' and c.signature <> '' and e.signature <> c.signature then 'signature'
  when e.symbol_id is not null and e.content <> c.content then 'body' when e.symbol_id is null and e.file <> '' and e.start_line > 0 and located_id is null then 'deleted' end as change
  from sharp e left join placed_symbols c on c.symbol_id = e.symbol_id left join at_place l using (entry_id)),
found as (select doc_id, pos, case when change in ('renamed', 'deleted') then 'orphaned' when change = 'signature' then 'hot' else 'warm' end as severity, change from marked where change is not null
  union all select doc_id, null, 'cold', 'age' from documents_kept where max_age_days > 0 and date_diff('day', cast(last_refreshed as date), date '2024-03-01') > max_age_days),
ranked as (select *, list_position(['orphaned', 'hot', 'warm', 'cold'], severity) as rank from found)
"""


@query(_DRIFT + "select doc_id, row_number() over (partition by doc_id order by rank, pos nulls first) - 1 as place, pos, severity, change from ranked")
def evergreen_findings(m):
    return drift.manifest_drift(m.doc_manifests, m.documents_kept, m.placed_symbols, F.lit("2024-03-01").cast("date"))


@query(_DRIFT + "select doc_id, string_agg(severity, ',' order by rank) as severities from (select distinct doc_id, severity, rank from ranked) group by 1")
def evergreen_severities(m):
    return drift.severities(evergreen_findings(m)).select("doc_id", F.array_join("severities", ",").alias("severities"))


@query("select doc_id, 'cold' as severity from documents_kept where max_age_days > 0 and date_diff('day', cast(last_refreshed as date), date '2024-03-01') > max_age_days")
def evergreen_ages_only(m):
    return drift.manifest_drift(m.doc_manifests, m.documents_kept, None, F.lit("2024-03-01").cast("date")).select("doc_id", "severity")


@query("""
select entry_id, (select min(p.symbol_id) from placed_symbols p where p.repo = e.repo and p.file = e.file and p.start_line <= e.end_line and p.end_line >= e.start_line) as located_id from doc_manifests e""")
def located_symbols(m):
    return drift.located(m.doc_manifests, m.placed_symbols)


@query("""
with numbered as (select conv_id as document_id, turn as ord, row_number() over (partition by conv_id order by turn) as revision_num from conversations)
select document_id, revision_num from numbered n where revision_num > (select max(revision_num) from numbered x where x.document_id = n.document_id) - 5""")
def revision_prune(m):
    states = m.table("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), F.lit(0).alias("recorded_at"))
    return stats.keep_last_revisions(merge.numbered_revisions(states)).select("document_id", F.col("revision_num").cast("long").alias("revision_num"))


@query("""
with w as (select path, bool_or(status = 'D') as gone from changes group by 1)
select case when gone is null then 'verified' when gone then 'invalid' else 'stale' end as state, count(*) as n_anchors from claims left join w on w.path = claims.source_file group by 1""")
def anchor_invalidation(m):
    return stats.anchor_summary(joins.anchor_states(joins.anchors_of(m.claims), m.changes))


@query("""
with hit as (select claim_key, 'stale' as impact from claims c where exists (select 1 from changes h where h.status <> 'D' and h.path = c.source_file
    and greatest(c.source_line - 5, 1) <= h.old_start + greatest(h.old_count, 1) - 1 and c.source_line + 5 >= h.old_start)
  union all select claim_key, 'invalid' from claims where source_file in (select path from changes where status = 'D'))
select claim_key, source_file, source_line, impact from claims join (select claim_key, min(impact) as impact from hit group by 1) using (claim_key)""")
def pr_impact(m):
    return joins.pr_impact(m.claims, m.changes).select("claim_key", "source_file", "source_line", "impact")


@query("""
with a as (select claim_key from claims c where source_file = 'file_7' and exists (select 1 from changes h where h.path = c.source_file
    and greatest(c.source_line - 3, 1) <= h.old_start + greatest(h.old_count, 1) - 1 and c.source_line + 3 >= h.old_start))
select claim_key, source_line, case when claim_key in (select claim_key from a) then 'stale' else 'verified' end as status from claims where source_file = 'file_7' and source_line between 5 and 40""")
def verify_section(m):
    inside = reads.claims_in_range(m.claims, "file_7", 5, 40)
    hit = joins.overlapping(joins.anchors_of(inside, 3), joins.hunks_of(m.changes)).select(F.col("claim_id").alias("claim_key"), F.lit(True).alias("hit"))
    return inside.join(hit, "claim_key", "left").select("claim_key", "source_line", F.when(F.col("hit"), "stale").otherwise("verified").alias("status"))


_MANIFEST = [("file_1*", ["docs/one.md", "README.md"]), ("file_?", ["docs/short.md"]), ("cmd/**/*.go", ["docs/cli.md"])]


@query("""
with c as (select distinct path from changes where status <> 'D'), g(pattern, doc) as (values ('^file_1[^/]*$', 'docs/one.md'), ('^file_1[^/]*$', 'README.md'), ('^file_[^/]$', 'docs/short.md'))
select doc, count(distinct path) as n_paths from c join g on regexp_matches(path, pattern) group by 1""")
def manifest_affected_docs(m):
    return joins.manifest_docs(reads.changed_paths(m.changes), _MANIFEST).groupBy("doc").agg(F.countDistinct("path").alias("n_paths"))


_FILES = "(select concat('file_', s_suppkey) as path, s_suppkey % 40 as n_lines, s_suppkey % 9 * 100 as size_bytes, (timestamp '1995-01-01' + to_days(cast(s_suppkey * 20 % 2500 as int))) as modified_at from supplier where s_suppkey % 10 <> 3)"


@query("""
with f as """ + _FILES + """
select case when f.path is null then 'HIGH missing file' when predicate = 'defines' and source_line > n_lines then 'MEDIUM line beyond end'
  when predicate = 'has_signature' and size_bytes = 0 then 'HIGH empty file' when modified_at > last_verified then 'LOW file newer than claim' else 'OK' end as finding, count(*) as n_claims
from (select * replace (case when predicate = 'has_kind' then 'has_signature' else predicate end as predicate) from claims) left join f on f.path = source_file group by 1""")
def claim_verification_severity(m):
    files = m.table("supplier").filter("s_suppkey % 10 <> 3").select(F.expr("concat('file_', s_suppkey)").alias("path"), F.expr("s_suppkey % 40").alias("n_lines"), F.expr("s_suppkey % 9 * 100").alias("size_bytes"), F.expr("cast(date_add(date '1995-01-01', cast(s_suppkey * 20 % 2500 as int)) as timestamp)").alias("modified_at"))
    claims = m.claims.withColumn("predicate", F.expr("case when predicate = 'has_kind' then 'has_signature' else predicate end"))
    return merge.claim_severity(claims, files).groupBy("finding").agg(F.count(F.lit(1)).alias("n_claims"))


@query("""
select claim_key, case when last_verified < timestamp '1996-01-01' then 'STALE' else 'FRESH' end as state from claims where source_file = 'file_3'""")
def staleness_report(m):
    found = reads.claims_in_range(m.claims, "file_3")
    return found.select("claim_key", F.when(F.col("last_verified") < F.lit("1996-01-01").cast("timestamp"), "STALE").otherwise("FRESH").alias("state"))


@query("select claim_key, source_file from claims order by sha256('7:' || claim_key), claim_key limit 50")
def canary_sample(m):
    return stats.canary(m.claims, "claim_key", 50, 7).select("claim_key", "source_file")


@query("""
with v as (select distinct p_partkey as subject_id, 'purpose' as predicate, case p_partkey % 4 when 0 then 'accept' when 1 then 'downgrade' when 2 then 'reject' else 'odd' end as verdict from part where p_partkey % 5 <> 0)
select claim_key, round(case when verdict = 'downgrade' then confidence * 0.6e0 else confidence end, 9) as confidence from claims left join v using (subject_id, predicate)
where claim_tier = 'semantic' and coalesce(verdict, 'accept') in ('accept', 'downgrade')""")
def llm_verify_gate(m):
    verdicts = m.symbols.filter("id % 5 <> 0").select(F.col("id").alias("subject_id"), F.lit("purpose").alias("predicate"), F.when(F.col("id") % 4 == 0, "accept").when(F.col("id") % 4 == 1, "downgrade").when(F.col("id") % 4 == 2, "reject").otherwise("odd").alias("verdict"))
    return merge.gate_claims(m.claims.filter("claim_tier = 'semantic'"), verdicts).select("claim_key", "confidence")


@query("""
with reports as (select language, id % 4 as stale, id % 2 as stale_packages from symbols)
select language, count(*) as n_reports, count(*) filter (where stale = 0 and stale_packages = 0) as n_fresh, round(count(*) filter (where stale = 0 and stale_packages = 0) * 100 / cast(count(*) as double), 6) as percent from reports group by 1""")
def audit_freshness(m):
    return stats.freshness(m.symbols.select("language", (F.col("id") % 4).alias("stale"), (F.col("id") % 2).alias("stale_packages")), ["language"])


@query("""
with att as (select user_id as subject_id, event_id as ord, event_type <> 'error' as ok from events),
l as (select subject_id, max(ord) filter (where ok) as last_ok from att group by 1),
f as (select subject_id, count(*) filter (where not ok and coalesce(last_ok, -1) < ord) as failures from att join l using (subject_id) group by 1)
select *, case when failures = 0 then 'ok' when failures < 3 then 'enrichment_failed' else 'enrichment_permanently_failed' end as state from f""")
def enrichment_failures(m):
    attempts = m.table("events").select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"))
    return merge.failures(attempts)
