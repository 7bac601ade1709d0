"""Scalar functions over whole tables, point reads, list orders, inserts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators import detect, merge, reads, stats
from loamstone.sources import code, lines, symbols

from .collected import Collected

query = Collected()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("""
with d as (select distinct case when p_size % 3 = 0 then 'github.com/o/' || p_type when p_size % 3 = 1 then 'github.com/o/' || p_type || '/pkg/' || p_brand else p_brand || '/x' end as import_path from part)
select import_path, case when starts_with(import_path, 'github.com/') then case when len(string_split(import_path, '/')) = 3 then '' else array_to_string(string_split(import_path, '/')[4:], '/') || '/' end else import_path || '/' end as folder from d""")
def local_folders(m):
    path = F.expr("case when p_size % 3 = 0 then concat('github.com/o/', p_type) when p_size % 3 = 1 then concat('github.com/o/', p_type, '/pkg/', p_brand) else concat(p_brand, '/x') end")
    return m.table("part").select(path.alias("import_path")).distinct().select("import_path", T.local_dir(F.col("import_path")).alias("folder"))


_NAMES = "case id % 5 when 0 then 'Abc' when 1 then '_x' when 2 then '__y' when 3 then '__z__' else 'plain' end || id"


@query(f"""
select id, case language when 'go' then case when regexp_matches(n, '^[A-Z]') then 'public' else 'internal' end
  when 'python' then case when n like '\\_\\_%\\_\\_' escape '\\' then 'public' when starts_with(n, '__') then 'private' when starts_with(n, '_') then 'internal' else 'public' end else 'public' end as visibility
from (select id, language, {_NAMES} as n from symbols)""")
def symbol_visibility(m):
    name = F.expr("concat(case id % 5 when 0 then 'Abc' when 1 then '_x' when 2 then '__y' when 3 then '__z__' else 'plain' end, id)")
    return m.symbols.select("id", T.visibility(F.col("language"), name).alias("visibility"))


@query("select call_id, case when call_id % 9 = 0 then false else ts < timestamp '2024-01-20' - interval 7 days end as stale from tool_calls")
def stale_calls(m):
    written = F.when(F.col("call_id") % 9 == 0, "no time").otherwise(F.col("ts").cast("string"))
    return m.tool_calls.select("call_id", T.is_stale(written, F.lit("2024-01-20").cast("timestamp")).alias("stale"))


_ERRORS = ("UNIQUE constraint failed: x", "CHECK constraint failed", "database is locked", "no such column: y", "provenance missing", "context canceled", "disk full", "NOT NULL constraint failed", "SQLITE_BUSY: database is busy")
_CATEGORIES = ("unique_constraint_violation", "check_constraint_violation", "database_locked", "database_error", "provenance_validation_failed", "context_canceled", "upsert_failed", "not_null_constraint", "database_busy")


@query("select case call_id % 10 " + " ".join(f"when {k} then '{c}'" for k, c in enumerate(_CATEGORIES)) + " else 'nil_error' end as category, count(*) as n from tool_calls group by 1")
def error_categories(m):
    message = F.element_at(F.array(*map(F.lit, _ERRORS), F.lit(None).cast("string")), (F.col("call_id") % 10 + 1).cast("int"))
    return m.tool_calls.groupBy(T.error_category(message).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_ASCII = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E\\n\\t]', '', 'g')"


@query(f"""
select doc_id, sha256(case when length(x) <= 300 then x else x[:297] || '...' end) as cut_sha256, least(length(regexp_replace(x, '\\n', '', 'g')), 256) as n_bytes from (select doc_id, {_ASCII} as x from documents)""")
def first_bytes_of_texts(m):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\n\t]", "")
    return m.table("documents").select("doc_id", F.sha2(T.truncated(text, 300), 256).alias("cut_sha256"), F.octet_length(T.strip_control(text, 256)).alias("n_bytes"))


@query("""
select case when c >= 1 then 0.95 when c <= 0 then 0.1 else round(c, 9) end as clamped, count(*) as n from (select confidence * 1.2e0 - 0.1e0 as c from claims) group by 1""")
def clamped_confidence(m):
    clamped = F.round(T.clamp_confidence(F.col("confidence") * 1.2 - 0.1), 9)
    return m.claims.groupBy(clamped.alias("clamped")).agg(F.count(F.lit(1)).alias("n"))


@query("select id, case when contains(lower(body), lower(case when id % 2 = 0 then 'The' else 'Der' end)) then 0.8 else 0.4 end as confidence from facts")
def mention_confidences(m):
    return m.facts.select("id", T.mention_confidence(F.when(F.col("id") % 2 == 0, "The").otherwise("Der"), F.coalesce("body", F.lit(""))).alias("confidence"))


@query("""
select s_suppkey, 'own' || s_suppkey % 7 as owner, 'r' || s_suppkey as repo, case when s_suppkey % 2 = 0 then sha256('x' || s_suppkey)[:40] else '' end as sha,
  case when s_suppkey % 3 = 0 then s_suppkey % 5 || '.' || s_suppkey % 7 || '.' || s_suppkey end as version, case when s_suppkey % 6 = 0 then 'green' when s_suppkey % 6 <= 3 then 'yellow' else 'red' end as badge,
  '&lt;' || s_name || '&gt; &amp; &quot;&apos;' as escaped from supplier""")
def remotes_and_badges(m):
    key = F.col("s_suppkey")
    url = F.when(key % 2 == 0, F.concat(F.lit("https://host.org/own"), (key % 7).cast("string"), F.lit("/r"), key.cast("string"), F.lit(".git"))).otherwise(F.concat(F.lit("git@host.org:own"), (key % 7).cast("string"), F.lit("/r"), key.cast("string")))
    owner, repo = T.remote_parts(url)
    log = F.when(key % 2 == 0, F.concat(F.lit("at "), F.substring(F.sha2(F.concat(F.lit("x"), key.cast("string")), 256), 1, 40), F.lit(" now"))).otherwise("at none")
    said = F.when(key % 3 == 0, F.concat(F.lit("tool version "), F.concat_ws(".", (key % 5).cast("string"), (key % 7).cast("string"), key.cast("string")), F.lit(" (2024)"))).otherwise("tool 1.2")
    escaped = T.xml_escaped(F.concat(F.lit("<"), F.col("s_name"), F.lit("> & \"'")))
    version = F.array_join(T.version_triple(said).cast("array<string>"), ".")
    return m.table("supplier").select("s_suppkey", owner.alias("owner"), repo.alias("repo"), T.commit_sha(log).alias("sha"), version.alias("version"), T.badge_colour(key % 6).alias("badge"), escaped.alias("escaped"))


_SYMBOL = "case id % 4 when 0 then 's m ' || import_path || ' v ns' || id % 9 || '/T' || id || '#' when 1 then 's m p v `odd ' || id || '``x`/run().' when 2 then 's m p v a/b/T#v' || id || '.' else case when id % 3 = 0 then 'local ' || id else 's m p v broken' || id end end"


@query(f"""
with s as (select id, import_path, {_SYMBOL} as symbol from symbols)
select id, case id % 4 when 0 then import_path || '/ns' || id % 9 when 1 then 'p/odd ' || id || '`x' when 2 then 'p/a/b' end as path, case id % 4 when 0 then 'T' || id when 1 then 'run' when 2 then 'v' || id end as name,
  case id % 4 when 0 then 'type' when 1 then 'func' when 2 then 'var' end as kind, case when id % 4 = 3 then case when id % 3 = 0 then 'local symbol' else 'bad descriptor' end end as error from s""")
def symbol_parts(m):
    taken = symbols.decomposed(F.expr(_SYMBOL))
    return m.symbols.select("id", taken.alias("d")).select("id", F.col("d.import_path").alias("path"), F.col("d.symbol_name").alias("name"), F.col("d.kind").alias("kind"), F.col("d.error").alias("error"))


@query("""
select id, 'scip-go gomod ' || 'mod v1 ' || case when contains(import_path, '#') then '`' || import_path || '`' else import_path end || '/' || case when kind = 'method' then 'Own#' else '' end || '`' || symbol_name || '`' ||
  case when kind = 'type' then '#' when kind in ('func', 'method') then '().' else '.' end as symbol from symbols""")
def go_symbols(m):
    made = symbols.go_symbol(F.lit("mod"), F.lit("v1"), F.concat(F.lit("mod/"), F.col("import_path")), F.col("symbol_name"), F.col("kind"), F.lit("Own"))
    return m.symbols.select("id", made.alias("symbol"))


@query("""
select error, count(*) as n_claims from (select case when source_line = 1 then 'subject_repo is required' when source_line = 2 then 'invalid kind' when predicate = 'purpose' then 'invalid predicate' when source_line = 3 then 'source_file is required'
  when source_line = 4 and confidence > 0 then 'confidence must be in [0, 1]' when source_line = 5 then 'invalid claim_tier' when source_line = 6 then 'extractor is required' else 'none' end as error from claims) group by 1""")
def claim_errors(m):
    line = F.col("source_line")
    emptied = lambda at, c: F.when(line == at, "").otherwise(c)
    parts = {name: F.lit("x") for name in ("subject_import_path", "subject_name", "language", "extractor_version")}
    parts |= {"subject_repo": emptied(1, F.lit("r")), "kind": F.when(line == 2, "alien").otherwise("func"), "visibility": F.lit("public"), "predicate": F.col("predicate"), "source_file": emptied(3, F.col("source_file"))}
    parts |= {"confidence": F.when(line == 4, F.col("confidence") + 1).otherwise(F.col("confidence")), "claim_tier": F.when(line == 5, "odd").otherwise(F.col("claim_tier")), "extractor": emptied(6, F.col("extractor")), "last_verified": F.col("last_verified")}
    allowed = ("defines", "imports", "exports", "has_doc", "has_kind", "implements")
    return m.claims.groupBy(F.coalesce(lines.validation_error(parts, allowed), F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n_claims"))


@query("select repo, relative_path, content_hash from source_files where repo = 'repo2' and relative_path = 'file_7'")
def source_file_by_path(m):
    return reads.file_by_path(m.source_files, "repo2", "file_7").select("repo", "relative_path", "content_hash")


@query("select claim_key, object_text from claims where predicate = 'imports'")
def claims_of_predicate(m):
    return reads.claims_by_predicate(m.claims, "imports").select("claim_key", "object_text")


@query("select fact_id, reason from feedback where fact_id = 7")
def feedback_of_fact(m):
    return reads.feedback_of(m.feedback, 7).select("fact_id", "reason")


@query("select doc_id, row_number() over (order by last_refreshed desc, doc_id) as place from documents_kept")
def document_list(m):
    return reads.documents_in_order(m.documents_kept).select("doc_id", "place")


@query("select claim_key as claim_id from claims where source_line > 40")
def stale_anchor_ids(m):
    anchors = m.claims.select(F.col("claim_key").alias("claim_id"), F.when(F.col("source_line") > 40, "stale").otherwise("verified").alias("state"))
    return reads.anchors_in_state(anchors, "stale")


@query("select case when source_line > 40 and predicate <> 'imports' then 'stale' else 'verified' end as state, count(*) as n_anchors from claims group by 1")
def anchors_after_check(m):
    anchors = m.claims.select(F.col("claim_key").alias("claim_id"), "predicate", F.when(F.col("source_line") > 40, "stale").otherwise("verified").alias("state"))
    seen = anchors.filter("predicate = 'imports'").select("claim_id")
    return stats.anchor_summary(reads.mark_verified(anchors, seen))


@query("select count(*) as n_claims, count(nullif(source_line % 3, 0)) as n_objects from claims")
def inserted_objects(m):
    incoming = m.claims.select("claim_key", (F.col("source_line") % 3).alias("object_id"))
    return merge.inserted_claims(incoming.limit(0), incoming).agg(F.count(F.lit(1)).alias("n_claims"), F.count("object_id").alias("n_objects"))


@query("select id from facts where id not in (select fact_id from evidence)")
def facts_without_evidence(m):
    return merge.without_evidence(m.facts, m.evidence).select("id")


@query("""
with r as (select doc_id as fact_id, case when doc_id % 2 = 0 then doc_id + 1 else doc_id + 100000000 end as nearest_id from documents)
select (case when fact_id in (select id from facts) then fact_id end) as fact_id, (case when nearest_id in (select id from facts) then nearest_id end) as nearest_id from r""")
def dangling_ids(m):
    rows = m.table("documents").select(F.col("doc_id").alias("fact_id"), F.expr("case when doc_id % 2 = 0 then doc_id + 1 else doc_id + 100000000 end").alias("nearest_id"))
    return detect.without_dangling(rows, m.facts)


@query("""
with a as (select strftime(ts, '%Y-%m-%d') as day, tool, repo from tool_calls) select day, tool, count(*) as calls, string_agg(distinct repo, ',' order by repo) as repos from a group by 1, 2""")
def merged_telemetry(m):
    def days(calls):
        return calls.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.collect_set("repo").alias("repos"))

    odd, even = m.tool_calls.filter("call_id % 2 = 1"), m.tool_calls.filter("call_id % 2 = 0")
    return stats.merged_days(days(odd), days(even)).select("day", "tool", "calls", F.array_join("repos", ",").alias("repos"))


@query("select extractor, count(*) as n_claims from claims group by 1")
def zero_claim_guard(m):
    """An extraction without any claim changes nothing."""
    return stats.claims_by(merge.guarded_replace(m.claims, m.claims.limit(0)), "extractor")


@query("select o_orderkey, o_orderkey % 3 <> 0 and o_custkey % 2 = 0 as warned from orders")
def empty_difference_warnings(m):
    warned = detect.unchanged_warning(F.lit("r0"), F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")), F.col("o_custkey") % 2)
    return m.table("orders").select("o_orderkey", warned.alias("warned"))


@query("""
select doc_id as section, case when doc_id % 4 = 0 then 'accurate' when doc_id % 4 = 1 then 'stale' else 'unclear' end as verdict from documents""")
def section_verdicts(m):
    docs = m.table("documents").select(F.col("doc_id").alias("section"))
    reply = F.when(F.col("section") % 4 == 0, '{"verdict": "Accurate", "reason": "r"}').when(F.col("section") % 4 == 1, '```json\n{"verdict": "stale"}\n```').when(F.col("section") % 4 == 2, "no verdict")
    return detect.section_verdicts(docs, docs.filter("section % 4 < 3").withColumn("reply", reply)).select("section", "verdict")


@query("select id, id + 1 as nearest_id from facts where id >= (select max(id) - 49 from facts)")
def calibration_rows(m):
    """The newest rows stay, and are still valid within ninety days."""
    now = F.lit("2024-01-01").cast("date")
    pairs = m.facts.select("id", (F.col("id") + 1).alias("nearest_id"))
    none = pairs.limit(0).withColumn("written_at", now).withColumn("expires_at", now)
    return detect.unexpired(detect.calibration(none, pairs, now, most=50), F.lit("2024-03-01").cast("date")).select("id", "nearest_id")


@query("""
with c as (select o_orderkey, case o_orderkey % 4 when 0 then 'A' when 1 then 'M' when 2 then 'R' else 'error' end as kind from orders)
select kind, count(*) as n_rows, count(*) filter (kind = 'R') as n_moved from c group by 1""")
def change_listings(m):
    """Name-status listings: one line per order, of which some are malformed."""
    key = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("A\t"), key)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("M\t"), key)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("R100\told"), key, F.lit("\tnew"))).otherwise(F.concat(F.lit("M "), key))
    found = lines.name_status(m.table("orders").select(key.alias("path"), F.concat(line, F.lit("\n")).alias("text")))
    return found.groupBy(F.coalesce("status", F.lit("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("old_file").alias("n_moved"))


@query("""
with b as (select s_suppkey, unnest(range(1, 4)) as line from supplier)
select s_suppkey as path, line, case when line < 3 then sha256('a' || s_suppkey)[:40] else sha256('b' || s_suppkey)[:40] end as commit, case when line < 3 then 'x' || s_suppkey || '@y' else 'z@y' end as author, case when line < 3 then s_suppkey else 9 end as at from b""")
def blame_listing(m):
    key = F.col("s_suppkey").cast("string")
    sha = lambda x: F.substring(F.sha2(F.concat(F.lit(x), key), 256), 1, 40)
    text = F.concat(sha("a"), F.lit(" 1 1 2\nauthor X\nauthor-mail <x"), key, F.lit("@y>\nauthor-time "), key, F.lit("\n\tone\n"), sha("a"), F.lit(" 2 2\n\ttwo\n"), sha("b"), F.lit(" 1 3 1\nauthor-mail <z@y>\nauthor-time 9\n\tthree\n"))
    return lines.blame_lines(m.table("supplier").select(F.col("s_suppkey").alias("path"), text.alias("text"))).select("path", F.col("line").cast("long").alias("line"), "commit", "author", "at")


@query("""
with e as (select s_suppkey, s_name, unnest([1, 2]) as k from supplier)
select s_suppkey as path, case when k = 1 then 'feat: ' || s_name else 'fix' end as subject, case when k = 1 then 'body' || chr(10) || 'more' else '' end as message from e""")
def log_listing(m):
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("sha1\nX\n2024-01-01\nfeat: "), name, F.lit("\nbody\nmore\n---END---\nsha2\nY\n2024-01-0"), key, F.lit("\nfix\n---END---\n"))
    return lines.log_entries(m.table("supplier").select(F.col("s_suppkey").alias("path"), text.alias("text"))).select("path", "subject", "message")


@query("select n_name as repo, n_regionkey as v, cast(null as varchar) as added from nation")
def published_table(m):
    """A table published twice and read with a column that it lacks."""
    from loamstone.sources.tables import Catalogue, shared_root

    store = Catalogue(m.spark, shared_root(m.spark))
    nation = m.table("nation").select(F.col("n_name").alias("repo"), F.col("n_regionkey").alias("v"))
    store.publish("nation", nation.withColumn("v", F.lit(-1).cast("long")))
    store.publish("nation", nation)
    wanted = nation.withColumn("added", F.lit(None).cast("string")).schema
    return store.read("nation", wanted).select("repo", "v", "added")


@query("select path, count(*) as n_defined from (" + " union all ".join(f"select path from sources where path like '{p}'" for p in ["%/a.go"] * 8 + ["%.py"] * 5 + ["%.ts"] * 5 + ["%_test.go"]) + ") group by 1")
def defined_symbols(m):
    found = code.extract(m.sources).filter("predicate = 'defines'")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n_defined"))


@query("""
with ids as (select distinct repo, change_id from changes)
select repo, sha256(string_agg(upper(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)), '' order by change_id)) as hex_sha256, count(*) as n_ids, max(change_id) as last_id from (select *, printf('%08x', change_id) as h from ids) group by 1""")
def id_set_codec(m):
    per = m.changes.groupBy("repo").agg(merge.encoded_ids(F.array_append(F.collect_set("change_id"), F.lit(-5))).alias("blob"))
    ids = merge.decoded_ids(F.col("blob"))
    return per.select("repo", F.sha2(F.hex("blob"), 256).alias("hex_sha256"), F.size(ids).cast("long").alias("n_ids"), F.element_at(ids, -1).alias("last_id"))


@query("""
with s as (select source_file from claims order by sha256('7:' || claim_key), claim_key limit 50), c as (select count(*) as n, count(*) filter (cast(substring(source_file, 6) as int) % 10 = 3) as n_bad from s)
select n, n_bad, n_bad * 100 > 2 * n as failed from c""")
def canary_verdict(m):
    sample = stats.canary(m.claims, "claim_key", 50, 7)
    return stats.canary_verdict(sample.select((F.expr("cast(substring(source_file, 6) as int)") % 10 == 3).alias("bad")))


@query("""
select error, count(*) as n from (select case when ord % 7 = 0 then 'fact_id is required' when ord % 7 = 1 then 'unknown action' when ord % 7 = 2 and action <> 'delete' then 'new_body is required' else 'none' end as error from corrections) group by 1""")
def correction_errors(m):
    n = F.col("ord") % 7
    error = merge.correction_error(F.when(n != 0, F.col("fact_id")), F.when(n == 1, "undo").otherwise(F.col("action")), F.when(n == 2, " ").otherwise(F.col("new_body")))
    return m.corrections.groupBy(F.coalesce(error, F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when event_type = 'purchase' then 'unknown reason' else 'none' end as error, count(*) as n from events group by 1")
def feedback_errors(m):
    reason = F.expr("case event_type when 'error' then 'wrong' when 'view' then 'stale' when 'click' then 'misleading' when 'purchase' then 'praise' else 'offensive' end")
    return m.table("events").groupBy(F.coalesce(merge.feedback_error(F.col("user_id"), reason), F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with gone as (select fact_id as document_id from corrections where action = 'delete'),
d as (select doc_id as document_id from documents), r as (select conv_id as document_id, turn from conversations)
select 'documents' as kind, count(*) as n from d where document_id not in (select document_id from gone) union all select 'revisions', count(*) from r where document_id not in (select document_id from gone)""")
def document_deletion(m):
    gone = m.corrections.filter("action = 'delete'").select(F.col("fact_id").alias("document_id"))
    documents, revisions = merge.deleted_documents(m.table("documents").select(F.col("doc_id").alias("document_id")), m.table("conversations").select(F.col("conv_id").alias("document_id"), "turn"), gone)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(documents, "documents").unionByName(count(revisions, "revisions"))
