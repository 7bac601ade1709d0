"""Batch twins of the streaming jobs, and the model hook with its deterministic stand-in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loamstone.operators import generated
from loamstone.sources import config
from loamstone.sources.tables import shared_root
from loamstone.streaming import jobs

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("""
with g as (select *, case when ts - lag(ts) over (partition by repo order by ts) < interval 30 minutes then 0 else 1 end as fresh from tool_calls),
s as (select *, sum(fresh) over (partition by repo order by ts rows unbounded preceding) as batch from g)
select repo, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started_at, count(*) as n_events, string_agg(distinct path, ',' order by path) as paths from s group by repo, batch""")
def debounced_batches(m):
    return jobs.debounced(m.tool_calls)


@query("""
select call_id, row_number() over (partition by session, cast(ts as date) order by ts, call_id) <= 2 as admitted from tool_calls""")
def daily_budget_admission(m):
    return jobs.daily_budget(m.tool_calls, 2).select("call_id", "admitted")


@query("""
select repo, path, arg_min(call_id, (ts, call_id)) as call_id, count(*) as n_joined from tool_calls group by repo, path, time_bucket(interval 1 day, ts, timestamp '1970-01-01')""")
def dedup_inflight(m):
    return jobs.in_flight(m.tool_calls, "1 day")


def _bucket_sql(name: str, source: str, key: str, rate: str, burst: float) -> str:
    """A token bucket replayed call by call."""
    now = f"least({burst}::double, tokens + ({rate}) * greatest(0, n.t - b.t))"
    return f"""
{name}_n as (select call_id, {key} as key, epoch(ts) as t, row_number() over (partition by {key} order by ts, call_id) as place from {source}),
{name}_b as (
  select call_id, key, place, t, {burst}::double - 1 as tokens, true as admitted from {name}_n where place = 1
  union all
  select n.call_id, n.key, n.place, n.t, case when {now} < 1 then {now} else {now} - 1 end, {now} >= 1 from {name}_b b join {name}_n n on n.key = b.key and n.place = b.place + 1
)"""


_RATE = "1.0::double / 36000"


@query(f"with recursive {_bucket_sql('s', 'tool_calls', 'session', _RATE, 5)} select key::varchar as key, call_id, admitted from s_b")
def token_bucket_admission(m):
    return jobs.token_bucket(m.tool_calls, rate=1 / 36000, burst=5)


@query(f"""
with recursive {_bucket_sql('s', 'tool_calls', 'session', _RATE, 5)},
passed as (select t.* from tool_calls t join s_b on s_b.call_id = t.call_id and s_b.admitted),
{_bucket_sql('p', 'passed', "session || '|' || path", _RATE, 2)}
select s_b.call_id, s_b.admitted as by_session, coalesce(p_b.admitted, false) as admitted from s_b left join p_b on p_b.call_id = s_b.call_id""")
def two_level_admission(m):
    return jobs.two_level(m.tool_calls, (1 / 36000, 1 / 36000), (5.0, 2.0))


@query("""
with crons as (select 'repo' || s_suppkey as repo, s_suppkey * 7 % 60 as m, s_suppkey % 24 as h, s_suppkey % 7 as w, s_suppkey % 5 <> 0 as weekly from supplier),
days as (select timestamp '2024-01-10' + to_days(d::int) as day from range(0, 9) r(d))
select repo, m || ' ' || h || ' * * ' || case when weekly then w::varchar else '*' end as cron,
  strftime(min(day + to_hours(h::int) + to_minutes(m::int)), '%Y-%m-%d %H:%M') as next_run
from crons, days where day + to_hours(h::int) + to_minutes(m::int) > timestamp '2024-01-10 10:07:00' and (not weekly or dayofweek(day) = w) group by repo, m, h, w, weekly""")
def cron_next_runs(m):
    """Schedules are written as a file of one JSON object a line, with a broken one among them, and read back."""
    key = F.col("s_suppkey")
    cron = F.concat_ws(" ", (key * 7 % 60).cast("string"), (key % 24).cast("string"), F.lit("*"), F.lit("*"), F.when(key % 5 != 0, (key % 7).cast("string")).otherwise("*"))
    root = shared_root(m.spark)
    rows = m.table("supplier").select(F.to_json(F.struct(F.concat(F.lit("repo"), key).alias("repo"), cron.alias("cron"))).alias("value"))
    rows.unionByName(rows.limit(1).select(F.lit("{broken").alias("value"))).write.text(f"{root}/schedules")
    found, _ = config.schedules(m.spark, f"{root}/schedules")
    return jobs.next_runs(found, dt.datetime(2024, 1, 10, 10, 7)).withColumn("next_run", F.date_format("next_run", "yyyy-MM-dd HH:mm"))


@query("""
select id as subject_id, p.predicate, p.predicate || ' of ' || symbol_name as object_text, p.confidence from symbols,
  (values ('purpose', 0.7e0), ('usage_pattern', 0.6e0), ('complexity', 0.6e0), ('stability', 0.5e0)) p(predicate, confidence)""")
def llm_stub_generate(m):
    return generated.generate(m.symbols, generated.stand_in).select("subject_id", "predicate", "object_text", F.col("confidence"))
