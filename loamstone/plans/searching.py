"""Full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.operators import search

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _sql(labels: dict[str, str], needed: str, rest: str = "", columns: str = "id, kind, round(score, 6) as score", joined: str = "") -> str:
    """``labels`` maps a label to an expression over the list t of a fact's terms that counts it."""
    counts = " union all ".join(f"select id, {k} as k, '{label}' as label, {count} as tf from docs" for k, (label, count) in enumerate(sorted(labels.items())))
    return f"""
with docs as (select id, kind, status, subject_id, list_filter(string_split_regex(translate(lower(concat_ws(' ', body, source_quote)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t from facts),
size as (select count(*) as n_docs, avg(len(t)) as avg_dl from docs),
posts as (select * from ({counts}) where tf > 0),
df as (select label, count(*) as df from posts group by 1),
w as (select posts.id, k, label, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 0) as raw, tf, len(t) as dl, avg_dl from posts join df using (label) join docs using (id), size),
scored as (select id, sum(case when raw <= 0 then 1e-6 else raw end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) order by k) as score, list(label) as held from w group by 1)
select {columns} from scored join docs using (id) {joined} where status = 'active' and ({needed}) {rest} order by round(score, 6) desc, id limit 10"""


def _word(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


@query(_sql({"license": _word("license"), "the": _word("the")}, "len(held) = 2"))
def bm25_search(m):
    return search.search(m.facts, ["license", "the"])


@query(_sql({"of": _word("of")}, "len(held) = 1", "and kind = 'todo'"))
def bm25_search_by_kind(m):
    return search.search(m.facts, ["of"], kind="todo")


@query(_sql({"the": _word("the"), "licen*": "len(list_filter(t, lambda x: starts_with(x, 'licen') and x <> 'the'))"}, "len(held) = 2"))
def bm25_prefix_search(m):
    return search.search(m.facts, ["the"], prefixes=("licen",))


@query(_sql({'"under the"': "len(list_filter(range(1, len(t)), lambda i: t[i] = 'under' and t[i + 1] = 'the'))"}, "len(held) = 1"))
def bm25_phrase_search(m):
    return search.search(m.facts, [], phrases=("under the",))


@query(_sql({"license": _word("license"), "la": _word("la"), "der": _word("der")}, "len(held) >= 1", "and not list_contains(t, 'the')"))
def bm25_any_but(m):
    return search.search(m.facts, [], any_of=("license", "la", "der"), none_of=("the",))


@query(_sql({"the": _word("the")}, "len(held) = 1", columns="id, kind, round(score, 6) as score, repo", joined="left join (select id as subject_id, repo from symbols) using (subject_id)"))
def bm25_search_of_repos(m):
    return search.search(m.facts, ["the"], repos=m.symbols.select(F.col("id").alias("subject_id"), "repo"))


@query("""
with docs as (select id, list_filter(string_split_regex(translate(lower(concat_ws(' ', body, source_quote)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as t from facts)
select term, count(distinct id) as n_facts, count(*) as n_places from (select id, unnest(t) as term from docs) group by 1""")
def index_terms(m):
    return search.index(m.facts).groupBy("term").agg(F.count(F.lit(1)).alias("n_facts"), F.sum("tf").alias("n_places"))
