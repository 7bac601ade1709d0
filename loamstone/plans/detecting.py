"""Freshness, verification, cost and look-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.operators import detect, reads

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("""
with n as (select concat('repo', s_suppkey % 5) as repo, concat('file_', s_suppkey) as relative_path, sha256(case when s_suppkey % 4 = 0 then 'x' else s_name end) as now_hash from supplier where s_suppkey % 6 <> 0)
select repo, relative_path, case when now_hash is null then 'tombstone' when now_hash <> content_hash then 'stale' else 'fresh' end as action
from source_files left join n using (repo, relative_path) where not deleted""")
def package_staleness(m):
    current = m.table("supplier").filter("s_suppkey % 6 <> 0").select(F.expr("concat('repo', s_suppkey % 5)").alias("repo"), F.expr("concat('file_', s_suppkey)").alias("relative_path"), F.expr("sha2(case when s_suppkey % 4 = 0 then 'x' else s_name end, 256)").alias("content_hash"))
    return detect.package_staleness(m.source_files, current)


@query("""
select concat('repo', n_nationkey) as repo, n_name as head, case when n_regionkey = 1 then 'in_progress' when n_regionkey = 2 then 'already_fresh' else 'queued' end as answer from nation""")
def extraction_requests(m):
    nation = m.table("nation").withColumn("repo", F.expr("concat('repo', n_nationkey)"))
    meta = nation.filter("n_regionkey in (0, 2)").select("repo", F.expr("case when n_regionkey = 2 then n_name else 'old' end").alias("commit_sha"))
    return detect.extraction_requests(nation.select("repo", F.col("n_name").alias("head")), meta, nation.filter("n_regionkey = 1"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'none' when o_orderstatus = 'P' then 'full' when o_orderkey % 2 = 0 then 'incremental' else 'full' end as mode from orders""")
def run_modes(m):
    orders = m.table("orders")
    stored = F.when(F.col("o_orderstatus") == "F", "head").when(F.col("o_orderstatus") != "P", "older")
    return orders.select("o_orderkey", detect.run_mode(stored, F.lit("head"), F.col("o_orderkey") % 2 == 0).alias("mode"))


@query("select repo, cast(sum(size_bytes) as bigint) as total_bytes, cast(coalesce(sum(size_bytes) filter (where not deleted), 0) as bigint) as live_bytes from source_files group by 1")
def cache_sizes(m):
    return detect.cache_sizes(m.source_files)


@query("select file, count(*) as n_commits, case when count(*) <= 5 then 'High stability' when count(*) <= 20 then 'Moderate stability' else 'Low stability' end as label from blame group by 1")
def stability_labels(m):
    return detect.stability_labels(m.blame, "file")


@query("""
with c as (select b.file, b.commit as sha, b.at as seen, case when line % 3 = 0 then 'chore: bump the versions of all things' when line % 3 = 1 then 'feat(store): keep the claims of a file together' else 'fix: x' end as message from blame b)
select file, arg_max(sha, (seen, sha)) as commit from c where strlen(message) > 20 and message not like 'chore%' group by 1""")
def newest_rationale(m):
    message = F.expr("case when line % 3 = 0 then 'chore: bump the versions of all things' when line % 3 = 1 then 'feat(store): keep the claims of a file together' else 'fix: x' end")
    return detect.newest_rationale(m.blame.withColumn("message", message))


@query("select case id % 4 when 0 then 'accept' when 1 then 'downgrade' else 'reject' end as verdict, count(*) as n_claims from symbols group by 1")
def verification_summary(m):
    return detect.verification_summary(m.symbols.select(F.expr("case id % 4 when 0 then 'accept' when 1 then 'downgrade' when 2 then 'reject' else 'odd' end").alias("verdict")))


@query("select repo, count(*) * 4 as calls, least(count(*) * 4, 1000) as calls_in_budget, round(least(count(*) * 4, 1000) * 0.003e0, 6) as cost_usd from symbols group by 1")
def enrichment_cost(m):
    return detect.enrichment_cost(m.symbols, 1000)


@query("""
with ch as (select regexp_replace(path, '/[^/]*$', '') as folder, path like '%.py' as gone from sources), dirs as (select folder from ch union select regexp_replace(folder, '/?[^/]*$', '') from ch where not gone),
docs as (select path from readmes union all select replace(path, 'README', 'CHANGES') from readmes union all select replace(path, 'README.md', 'sub/x.md') from readmes)
select path from docs where regexp_replace(path, '/[^/]*$', '') in (select folder from dirs where folder <> '') and not path like '%CHANGES.md'""")
def documents_near_changes(m):
    named = lambda new: m.readmes.select(F.replace("path", F.lit("README.md"), F.lit(new)).alias("path"))
    documents = named("README.md").unionByName(named("CHANGES.md")).unionByName(named("sub/x.md"))
    gone = F.col("path").like("%.py")
    return detect.documents_near(m.sources.filter(~gone).select("path"), m.sources.filter(gone).select("path"), documents)


@query("select distinct concat('repo', p_partkey % 5) as repo from part where p_brand = 'Brand#4'")
def repos_of_document(m):
    doc_map = m.table("part").select(F.expr("concat('repo', p_partkey % 5)").alias("repo"), F.col("p_name").alias("source"), F.array("p_brand", "p_type").alias("docs"))
    return detect.documents_of_sources(doc_map, "Brand#4")


@query("select import_path, symbol_name, id as subject_id from symbols")
def known_replies(m):
    asked = m.symbols.select("import_path", "symbol_name")
    strange = m.symbols.select("import_path", F.lit("invented").alias("symbol_name"))
    return detect.known_replies(asked.unionByName(strange), m.symbols)


@query("select import_path, count(*) as n_symbols, count(*) filter (where id in (select subject_id from claims where predicate = 'has_doc')) as n_described, cast(floor(count(*) filter (where id in (select subject_id from claims where predicate = 'has_doc')) * 100 / count(*)) as bigint) as percent from symbols group by 1")
def documented_share(m):
    return detect.index_cover(m.symbols, m.claims.filter("predicate = 'has_doc'"))


@query("""
with c as (select fact_id, arg_max(action, ord) as action, arg_max('body ' || ord, ord) as body from (select user_id as fact_id, event_id as ord, case event_id % 3 when 0 then 'correct' when 1 then 'delete' else 'supersede' end as action from events) where action in ('correct', 'supersede') group by 1)
select fact_id, subject_id, kind, c.body, c.action as source_ref, 'correction' as source_type, 'active' as status from facts join c on c.fact_id = facts.id""")
def replacement_facts(m):
    return detect.replaced_facts(m.facts, m.corrections)


@query("select distinct source_file from claims")
def distinct_source_files(m):
    return m.claims.select("source_file").distinct()


@query("select distinct import_path from symbols where symbol_name ilike 'blue%'")
def packages_of_symbol(m):
    return reads.symbols_like(m.symbols, "blue%").select("import_path").distinct()


@query("select path from changes where status = 'D' group by 1")
def deleted_paths(m):
    return reads.deleted_paths(m.changes)


@query("select distinct repo from symbols where lower(substring(symbol_name, 1, 3)) = 'red'")
def repos_to_search(m):
    return reads.repos_to_search(reads.routing_prefixes(m.symbols), m.symbols, "Red w")
