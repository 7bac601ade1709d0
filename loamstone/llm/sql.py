"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

#: crc32 by its polynomial: a table of 256 entries by rule, then a fold over the bytes.
OP5 = """
with recursive
eight as (select range(8) as steps),
table_ as (select list(list_reduce(list_prepend(b, steps), lambda c, s: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by b) as t from range(256) r(b), eight),
docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
bytes as (select rid, doc_id, octet_length(encode(text)) + 16 as size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as b from docs),
sums as (select rid, doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) as crc from bytes, table_),
jumps as (
  select doc_id, n, 1 as step, 0::bigint as at_, 0::bigint as next_ from (select distinct doc_id from documents) d, (values (40), (41)) s(n)
  union all
  select doc_id, n, step + 1, next_, least(floor((next_ + 1) / ((cast('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || step), 1, 13) as bigint) + 1) / 4503599627370496.0::double)), n)::bigint from jumps where next_ < n
),
placed as (
  select s.rid, s.doc_id, s.size, s.crc, a.at_ as shard, b.at_ as grown
  from sums s join jumps a on a.doc_id is not distinct from s.doc_id and a.n = 40 and a.next_ >= 40 join jumps b on b.doc_id is not distinct from s.doc_id and b.n = 41 and b.next_ >= 41
),
chunks as (select greatest(1, ceil(max(k) / 5000.0))::bigint as chunks from (select count(*) as k from placed group by shard))
select doc_id, size, crc::bigint as text_crc32, 'key' as law, shard::int as shard, grown::int as grown_shard,
  row_number() over (partition by shard order by cast('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':0'), 1, 8) as bigint) % chunks, doc_id, size, crc) - 1 as slot
from placed, chunks
"""

OP6 = f"""
with recursive
words as (select doc_id, regexp_extract_all({_FOLD}, '{_WORDS}') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s from words
),
sized as (select doc_id, s, len(s) as n from sets),
flat as (select doc_id, n, unnest(s) as shingle from sized),
links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.shingle = b.shingle and a.doc_id < b.doc_id and a.n * 100 >= b.n * 80 and b.n * 100 >= a.n * 80
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
both_ways as (select a, b from links union select b, a from links),
reach as (select a as x, a as y from both_ways union select r.x, e.b from reach r join both_ways e on e.a = r.y),
least_ as (select x, min(y) as label from reach group by x)
select doc_id, n::bigint as n_shingles, coalesce(label, doc_id) as component_id from sized left join least_ on x = doc_id
"""

OP8 = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
words as (select rid, doc_id, text, regexp_extract_all(text, '{_WORDS}') as w from docs),
triples as (select rid, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as k from words)),
again as (select rid, k from (select rid, k, count(*) over (partition by rid, g) as c from triples) where c > 1),
covered as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([k, k + 1, k + 2]) as p from again) group by rid),
lines as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '{_WORDS}') group by rid),
counted as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from words left join covered using (rid) left join lines using (rid)
),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * n_symbols <= 20 * n_words and 100 * n_dup_lines <= 60 * n_lines and word_chars >= 1.5 * n_words and word_chars <= 25 * n_words as kept
from failed
"""

_PARTS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
with items as (select item_id, regexp_extract_all({_FOLD}, '{_PARTS}') as w from benchmark),
windows as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[k:k + 9], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from items where len(w) > 0)),
sizes as (select distinct size from windows),
docs as (select row_number() over () as rid, doc_id, regexp_extract_all({_FOLD}, '{_PARTS}') as w from documents),
runs as (select rid, size, k, array_to_string(w[k:k + size - 1], ' ') as g from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as k from docs, sizes where len(w) >= size)),
hits as (select r.rid, r.k, r.size, i.item_id from runs r join windows i on i.size = r.size and i.g = r.g),
places as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + size)) as p from (select distinct rid, k, size from hits)) group by rid),
found as (select rid, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct rid, item_id::varchar as item_id from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join places using (rid) left join found using (rid)
"""

_CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _escaped_length(column: str) -> str:
    """Each control string and each escape character takes one character more; no control string overlaps itself or begins another."""
    return f"(length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (*_CONTROL, "␛")) + ")"


OP10 = f"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns as (select *, lag(role) over o as before_, row_number() over o as place, count(*) over (partition by conv_id) as n from rows_ window o as (partition by conv_id order by turn nulls first, role, text)),
checked as (
  select *, case when before_ is null then role in ('system', 'user') when before_ in ('system', 'assistant') then role = 'user' when before_ = 'user' then role = 'assistant' else false end as allowed from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len("<|turn|>") + 1 + len("<|end|>") + 1} + {_escaped_length("role")} + {_escaped_length("text")})::bigint as formatted_chars,
  bool_and(allowed) and bool_or(place = n and role = 'assistant') as valid
from checked group by conv_id
"""

OP11 = f"""
with recursive
docs as (select row_number() over () as rid, doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
judged as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
firsts as (select t, min(doc_id) as first_id from docs group by t),
rated as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(first_id < d.doc_id, false)::int as mask
  from docs d join firsts using (t) left join judged j on j.doc_id = d.doc_id
),
chains as (
  select '' as o, 0 as step, 0 as bit, 0 as before_
  union all
  select o || l, step + 1, b, before_ + bit from chains, (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(l, b) where not contains(o, l)
),
steps as (select a.o as filter_order, b.step, b.bit, b.before_ from chains a join chains b on a.step = 5 and b.step > 0 and starts_with(a.o, b.o)),
told as (
  select part, filter_order, step, bit, count(*) filter (mask & (before_ | bit) = 0) as kept, count(*) filter (mask & bit > 0 and mask & before_ = 0) as removed,
    count(*) filter (mask & bit > 0 and mask & before_ > 0) as redundant, count(*) filter (mask = bit) as unique_fails,
    count(*) filter (mask & bit > 0 and mask & before_ = 0 and good = 1) as good_lost, count(*) filter (mask & bit > 0 and mask & before_ = 0 and toxic = 1) as toxic_lost
  from rated, steps group by part, filter_order, step, bit
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from told
"""

OP12 = f"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
windows as (select rid, doc_id, k, array_to_string(w[k:k + 19], ' ') as g from (select rid, doc_id, w, unnest(range(1, len(w) - 18)) as k from docs where len(w) >= 20)),
ranked as (select rid, k, row_number() over (partition by g order by doc_id, k) as place from windows),
gone as (select distinct rid, unnest(range(k, k + 20)) as p from ranked where place > 1),
flat as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
kept as (select rid, count(*) as n, string_agg(word, ' ' order by p) as t from flat anti join gone using (rid, p) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (rid)
"""

OP13 = r"""
with docs as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select doc_id, t, u, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as y,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 100 then 'plain' when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 50 then 'spm' else 'psm' end as form
  from docs
),
parts as (select *, array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(u[greatest(x, y) + 1:], '') as s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parts
"""
