"""Text functions over documents, and extraction over fixture texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.functions import patterns as P
from loamstone.functions import text as T
from loamstone.operators import stats

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _sql_redacted(column: str) -> str:
    for _, pattern, by in P.REDACTIONS:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"regexp_replace({column}, '{P.MENTION}', '\\1{P.REDACTED_MENTION}', 'g')"


@query(f"select doc_id, sha256({_sql_redacted('text')}) as redacted_sha256 from documents")
def redact_pii(m):
    return m.table("documents").select("doc_id", F.sha2(T.redact_pii(F.col("text")), 256).alias("redacted_sha256"))


@query("select doc_id from documents where " + " or ".join(f"regexp_matches(text, '{p}')" for p in [r[1] for r in P.REDACTIONS] + [P.MENTION]))
def pii_flags(m):
    return m.table("documents").filter(T.contains_pii(F.col("text"))).select("doc_id")


@query("select doc_id from documents where regexp_matches(text, '(?i)(password|secret|token|credential|api_key)')")
def sensitive_flags(m):
    return m.table("documents").filter(T.sensitive(F.col("text"))).select("doc_id")


@query("""
select call_id, case when age <= 3600 then 10 when age <= 86400 then 60 else 300 end as poll_seconds from
(select call_id, date_diff('second', ts, timestamp '2024-02-15') as age from tool_calls)""")
def freshness_intervals(m):
    age = F.unix_timestamp(F.lit("2024-02-15").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "ts"))
    return m.tool_calls.select("call_id", T.poll_interval(age).alias("poll_seconds"))


_STATUS = """
with p as (select import_path, max(case when claim_tier = 'semantic' then last_verified end) as seen from symbols left join claims on symbols.id = subject_id group by 1),
f as (select import_path, max(last_indexed) as indexed from symbols join claims on symbols.id = subject_id join source_files on relative_path = source_file and not deleted group by 1)
select import_path, case when seen is null then 'Not yet enriched' when cast(indexed as timestamp) > seen then 'Enrichment stale: source changed since ' || strftime(seen, '%Y-%m-%d')
  else 'Enriched at ' || strftime(seen, '%Y-%m-%d') || ' (' || case when days < 1 then 'just now' when days = 1 then '1 day ago' when days < 30 then days || ' days ago' when days < 60 then '1 month ago' else (days // 30) || ' months ago' end || ')' end as enriched
from (select *, date_diff('day', cast(seen as date), date '2002-01-01') as days from p left join f using (import_path))"""


@query(_STATUS)
def enrichment_status(m):
    return stats.enrichment_status(m.symbols, m.claims, m.source_files, F.lit("2002-01-01").cast("timestamp"))


@query("""
select relative_path, ends_with(b, '_generated.go') or ends_with(b, 'pb.go') or starts_with(b, 'zz_generated') or contains(b, '_zz_generated') as is_generated,
  starts_with(p, 'vendor/') or starts_with(p, 'third_party/') or starts_with(p, 'testdata/') or ends_with(p, '.pb.go') or ends_with(p, '_gen.go') or ends_with(p, '_test.go') as is_excluded
from (select relative_path, case s_ % 5 when 0 then 'vendor/' when 1 then 'pkg/api_' else 'src/' end || relative_path || case s_ % 4 when 0 then '.pb.go' when 1 then '_test.go' when 2 then '_generated.go' else '.go' end as p,
  regexp_replace(p, '^.*/', '') as b from (select relative_path, cast(substring(relative_path, 6) as int) as s_ from source_files))""")
def file_kinds(m):
    n = F.expr("cast(substring(relative_path, 6) as int)")
    path = F.concat(F.when(n % 5 == 0, "vendor/").when(n % 5 == 1, "pkg/api_").otherwise("src/"), F.col("relative_path"), F.when(n % 4 == 0, ".pb.go").when(n % 4 == 1, "_test.go").when(n % 4 == 2, "_generated.go").otherwise(".go"))
    return m.source_files.select("relative_path", T.generated_file(path).alias("is_generated"), T.mining_excluded(path).alias("is_excluded"))


@query("""
select lang, count(*) as n_docs, count(distinct sha256(trim(regexp_replace(lower(regexp_replace(text, '[.!?:;]+$', '')), '[ \\t\\n\\f\\r]+', ' ', 'g')))) as n_bodies from documents group by 1""")
def scrubbed_bodies(m):
    return m.table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(T.scrub_hash(F.col("text"))).alias("n_bodies"))
