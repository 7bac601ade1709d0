"""Semantics that the driver's tables do not show, on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamstone.functions import text as T
from loamstone.operators import detect, generated, joins, merge, reads, search, stats
from loamstone.sources import code, lines, tables
from loamstone.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "redacted"),
    [
        ("mail jane.doe+x@corp.example.com now", "mail [REDACTED_EMAIL] now"),
        ("ssn 123-45-6789.", "ssn [REDACTED_SSN]."),
        ("key sk-abcdefghijklmnopqrstuv", "key [REDACTED_TOKEN]"),
        ("host 10.1.2.3 up", "host [REDACTED_IP] up"),
        ("call (212) 555-0100 or +44 20 7946 0958", "call [REDACTED_PHONE] or [REDACTED_PHONE]"),
        ("ask @jane (or @joe)", "ask [REDACTED_MENTION] (or [REDACTED_MENTION])"),
        ("version 1.2.3 is plain", "version 1.2.3 is plain"),
    ],
)
def test_redaction(spark, text, redacted):
    assert value(spark, T.redact_pii(F.lit(text))) == redacted
    assert value(spark, T.contains_pii(F.lit(redacted))) is False


def test_boundaries_are_ascii(spark):
    assert value(spark, T.redact_pii(F.lit("é123-45-6789"))) == "é[REDACTED_SSN]"


def test_scrub(spark):
    assert value(spark, T.scrub(F.lit("  See @bob event.go:142 and L15:  The  Cache!!"))) == "see and : the cache"
    a, b = F.lit("@ann Fix the cache at store.go:10."), F.lit("fix   the CACHE at")
    assert value(spark, T.scrub_hash(a)) == value(spark, T.scrub_hash(b))


def test_jaccard(spark):
    j = lambda a, b: value(spark, T.token_jaccard(T.tokens(F.lit(a)), T.tokens(F.lit(b))))
    assert j("a b c", "C b a") == 1.0 and j("", " ") == 0.0 and j("a b", "b c") == j("b c", "a b") == pytest.approx(1 / 3)


def test_small_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.local_dir(F.lit("github.com/org/repo/pkg/a"))) == "pkg/a/" and v(T.local_dir(F.lit("github.com/org/repo"))) == "" and v(T.local_dir(F.lit("tools"))) == "tools/"
    assert v(T.strip_version(F.lit("mod@v1.2.3/sub@x"))) == "mod/sub@x"
    assert v(T.commit_type(F.lit("Feat(core): x"))) == "feat"
    assert v(T.nontrivial_commit(F.lit("chore: something long enough to count"))) is False
    assert [v(T.human_age(F.lit(s))) for s in (-5, 3600, 7200, 86400, 86400 * 29, 86400 * 45, 86400 * 90)] == ["just now", "1 hour ago", "2 hours ago", "1 day ago", "29 days ago", "1 month ago", "3 months ago"]
    assert [v(T.poll_interval(F.lit(s).cast("long"))) for s in (10, 4000, 100000, None)] == [10, 60, 300, 300]
    assert v(T.error_category(F.lit("UNIQUE constraint failed: x is locked"))) == "unique_constraint_violation" and v(T.error_category(F.lit(None).cast("string"))) == "nil_error"
    assert [v(c) for c in T.remote_parts(F.lit("git@host.org:own/repo.git"))] == ["own", "repo"]
    assert v(F.lit("cmd/a.go").rlike(T.glob_pattern("cmd/*.go"))) and not v(F.lit("cmd/x/a.go").rlike(T.glob_pattern("cmd/**.go"))) and v(F.lit("cmd/x/a.go").rlike(T.glob_pattern("cmd/**/*.go", True)))
    assert v(T.is_stale(F.lit("bad"), F.lit("2024-01-10").cast("timestamp"))) is False and v(T.is_stale(F.lit("2024-01-01"), F.lit("2024-01-10").cast("timestamp"))) is True


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([("x", "f1", 1), ("x", "f2", 2), ("y", "f1", 3)], "extractor string, source_file string, v int")
    new = spark.createDataFrame([("x", "f1", 9)], old.schema)
    once = merge.replace_claims(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, merge.replace_claims(once, new).collect())) == [("x", "f1", 9), ("x", "f2", 2), ("y", "f1", 3)]
    assert merge.guarded_replace(old, new.limit(0)).count() == 3


def test_fact_merge_and_evidence(spark):
    rows = [(2, "todo", "Fix it.", 0.5, "", 2, 1, "d2"), (1, "todo", "fix  IT", 0.9, "m", 1, 1, "d1"), (4, "todo", "FIX it", 0.3, "", 4, 1, "d4"), (5, "todo", "fix it!", 0.3, "", 5, 1, "d5"), (3, "quirk", "fix it", 0.1, "", 3, 2, "d3")]
    facts = spark.createDataFrame([(r[0], 1, *r[1:]) for r in rows], "id long, subject_id long, kind string, body string, confidence double, model string, ord long, corroboration long, last_verified string")
    evidence = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (4, "a"), (4, "c"), (3, "a")], "fact_id long, source_ref string")
    found = {r["kind"]: r for r in merge.merge_facts(facts, evidence).collect()}
    # call 2 brings sources, call 4 only known ones, call 5 none at all
    assert (found["todo"]["id"], found["todo"]["confidence"], found["todo"]["corroboration"], found["todo"]["last_verified"], found["todo"]["n_rows"]) == (1, 0.9, 2, "d2", 4)
    assert (found["quirk"]["corroboration"], found["quirk"]["last_verified"]) == (2, "d3")
    assert [r["id"] for r in merge.without_evidence(facts, evidence).collect()] == [5]
    have = spark.createDataFrame([(1, "a", 1)], "fact_id long, source_ref string, ord long")
    more = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "b", 4)], have.schema)
    assert sorted(map(tuple, merge.merge_evidence(have, more).collect())) == [(1, "a", 1), (1, "b", 3)]


def test_upsert_and_cursor(spark):
    a = spark.createDataFrame([("k", 1)], "k string, v int")
    b = spark.createDataFrame([("k", 5), ("k", 3), ("n", 2)], a.schema)
    assert sorted(map(tuple, merge.upsert(a, b, ["k"]).collect())) == [("k", 5), ("n", 2)]
    timed = spark.createDataFrame([("k", 5, 1), ("k", 3, 2)], "k string, v int, at int")
    assert list(map(tuple, merge.upsert(a.withColumn("at", F.lit(9)), timed, ["k"], ["at"]).collect())) == [("k", 3, 2)]
    files = spark.createDataFrame([("r", "a", False)], "repo string, relative_path string, deleted boolean")
    assert merge.tombstone(files, files, strict=True).first()["deleted"] is True
    with pytest.raises(ValueError):
        merge.tombstone(files, spark.createDataFrame([("r", "b")], "repo string, relative_path string"), strict=True)
    claims = spark.createDataFrame([(1, 7)], "id long, object_id long")
    assert sorted(map(tuple, merge.inserted_claims(claims, spark.createDataFrame([(2, 0), (3, 5)], claims.schema)).collect())) == [(1, 7), (2, None), (3, 5)]
    known, new, back = merge.cursor(F.array(F.lit(3), F.lit(9)), F.array(F.lit(4), F.lit(-1)))
    assert value(spark, known) == [3, 4, 9] and value(spark, back) is True and value(spark, new) == [-1, 4]


def test_overlap(spark):
    anchors = spark.createDataFrame([("a", "f", 10, 12), ("b", "f", 200, 500), ("c", "g", 0, 0), ("d", "f", 13, 13)], "claim_id string, file string, start_line long, end_line long")
    hunks = spark.createDataFrame([("f", 12, 12), ("f", 300, 301), ("g", 1, 1)], "file string, hunk_start long, hunk_end long")
    assert {r["claim_id"] for r in joins.overlapping(anchors, hunks).collect()} == {"a", "b", "c"}


def test_impact_of_changes(spark, monkeypatch):
    """Claims share places, and only these meet the hunks; claims of one key share the worst impact, whichever way the sides are joined."""
    claims = spark.createDataFrame([("a", "f", 10), ("a", "z", 1), ("b", "f", 90), ("c", "g", 5), ("c", "f", 11), ("d", "h", 5), (None, "f", 10), ("e", None, 10)] + [(f"n{k}", "f", 10) for k in range(300)], "claim_key string, source_file string, source_line long")
    changes = spark.createDataFrame([("f", "M", 12, 0), ("f", "M", 13, 2), ("g", "D", 1, 1), ("h", "A", 30, 4), (None, "D", 10, 1)], "path string, status string, old_start long, old_count long")
    expected = [("a", "f", "stale"), ("a", "z", "stale"), ("c", "f", "invalid"), ("c", "g", "invalid")] + sorted((f"n{k}", "f", "stale") for k in range(300))
    for few in (joins.FEW, 0):
        monkeypatch.setattr(joins, "FEW", few)
        assert sorted((r["claim_key"], r["source_file"], r["impact"]) for r in joins.pr_impact(claims, changes).collect()) == expected
    # 304 claims with a key and a file of the changes lie at four places
    assert {tuple(r) for r in joins.touched(joins.anchors_of(claims, 5), joins.hunks_of(changes)).collect()} == {("f", 5, 15), ("f", 6, 16), ("g", 1, 10)}


def test_anchor_states(spark):
    anchors = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "claim_id int, file string")
    changes = spark.createDataFrame([("a", None, "D"), ("b", None, "M"), ("new", "c", "R")], "path string, old_path string, status string")
    assert {r["claim_id"]: r["state"] for r in joins.anchor_states(anchors, changes).collect()} == {1: "invalid", 2: "stale", 3: "stale", 4: "verified"}
    assert {r["path"] for r in reads.deleted_paths(changes).collect()} == {"a", "c"}


def test_search(spark):
    facts = spark.createDataFrame([(1, "todo", "active", "café cache", ""), (2, "todo", "active", "cache cache other", ""), (3, "todo", "stale", "cafe", ""), (4, "todo", "active", "else", "")], "id long, kind string, status string, body string, source_quote string")
    assert [r["id"] for r in search.search(facts, ["cafe"]).collect()] == [1]
    assert {r["id"] for r in search.search(facts, ["cache"]).collect()} == {1, 2}
    assert [r["id"] for r in search.search(facts, ["cache"], prefixes=("oth",)).collect()] == [2]
    assert [r["id"] for r in search.search(facts, [], phrases=("cache other",)).collect()] == [2] and search.search(facts, [], phrases=("other cache",)).count() == 0
    assert {r["id"] for r in search.search(facts, [], any_of=("Café", "else")).collect()} == {1, 4} and {r["id"] for r in search.search(facts, ["cache"], none_of=("cafe",)).collect()} == {2}
    with pytest.raises(ValueError):
        search.search(facts, [])


def test_extraction(spark):
    text = lambda t: spark.createDataFrame([("f", t)], "path string, text string")
    assert [tuple(r)[2:] for r in lines.sections(text("intro\n## A\nbody\n## B\n\n")).collect()] == [("Overview", "intro"), ("A", "body")]
    status = {r["file"]: (r["status"], r["old_file"]) for r in lines.name_status(text("M\ta.go\nR100\told.go\tnew.go\nbroken\n")).collect()}
    assert status == {"a.go": ("M", None), "new.go": ("R", "old.go"), None: (None, None)}
    sha = "a" * 40
    blame = lines.blame_lines(text(f"{sha} 1 1 2\nauthor X\nauthor-mail <x@y>\nauthor-time 7\n\tone\n{sha} 2 2\n\ttwo\n")).collect()
    assert sorted((r["line"], r["author"], r["at"]) for r in blame) == [(1, "x@y", 7), (2, "x@y", 7)]
    log = lines.log_entries(text(f"{sha}\nX\n2024-01-01\nfeat: a\nbody\n---END---\n{sha}\nY\n2024-01-02\nfix: b\n---END---\n")).collect()
    assert [(r["author"], r["subject"], r["message"]) for r in log] == [("X", "feat: a", "body"), ("Y", "fix: b", "")]
    assert value(spark, lines.key_terms(F.lit("Use ConfigMap"), F.lit("with `x y` and my_name"))) == ["ConfigMap", "my_name", "x y"]


def test_code(spark):
    files = spark.createDataFrame([("pkg/test_a.py", 'import os\n\ndef f():\n    """Doc."""\n'), ("m.go", 'package m\nimport "fmt"\nfunc (s *S) Do() {}\n'), ("x.py", "def ("), ("a.rs", "fn a() {}"), ("b.ts", "export class Foo {}\n"), ("c.sh", "# generated file\nrun() { :; }\n")], "path string, text string")
    found = {(r["path"], r["predicate"], r["symbol_name"]) for r in code.extract(files).collect()}
    assert {("pkg/test_a.py", "has_doc", "f"), ("pkg/test_a.py", "is_test", "pkg/test_a.py"), ("m.go", "imports", "fmt"), ("m.go", "defines", "Do"), ("x.py", "unparsed", "x.py"), ("a.rs", "unparsed", "a.rs"), ("b.ts", "exports", "Foo"), ("c.sh", "is_generated", "c.sh"), ("c.sh", "defines", "run")} <= found


def test_catalogue(spark, tmp_path):
    store = tables.Catalogue(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read("../x")
    first = spark.createDataFrame([("r", 1)], "repo string, v int")
    store.publish("t", first)
    store.publish("t", first.withColumn("v", F.lit(2)))
    assert [r["v"] for r in store.read("t").collect()] == [2]
    for v in range(3, 13):  # more versions than one digit counts
        store.publish("t", first.withColumn("v", F.lit(v)))
    assert [r["v"] for r in store.read("t").collect()] == [12]
    wider = store.read("t", StructType.fromDDL("repo string, v int, added string"))
    assert wider.columns == ["v", "repo", "added"] and wider.first()["added"] is None
    assert store.read("none", first.schema).count() == 0


def test_canary_is_repeatable(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert [r[0] for r in stats.canary(rows, "k", 5, 1).collect()] == [r[0] for r in stats.canary(rows.orderBy(F.rand()), "k", 5, 1).collect()]


def test_bucket():
    b = jobs.Bucket(1.0, 2.0)
    assert [b.admit(t) for t in (0, 0, 0, 1, 1, 10, 10, 10)] == [True, True, False, True, False, True, True, False]


def test_cron():
    at = dt.datetime(2024, 1, 10, 10, 7)
    assert jobs.next_run("*/15 * * * *", at) == dt.datetime(2024, 1, 10, 10, 15)
    assert jobs.next_run("0 3 * * 1", at) == dt.datetime(2024, 1, 15, 3, 0)
    assert jobs.next_run("0 0 31 2 *", at) is None


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, "s1" if k % 3 else "s2", "r", f"p{k % 4}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k if k % 10 else 60 * k)) for k in range(60)]
    calls = spark.createDataFrame(rows, "call_id long, session string, repo string, path string, ts timestamp")
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = jobs.debounced(stream).writeStream.outputMode("complete").format("memory").queryName("debounced").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("debounced").collect())) == sorted(map(tuple, jobs.debounced(calls).collect()))
    q = jobs.token_bucket_stream(stream, 1 / 3600, 2).writeStream.outputMode("append").format("memory").queryName("bucket").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bucket").collect())) == sorted(map(tuple, jobs.token_bucket(calls, 1 / 3600, 2).collect()))
    seen = []
    jobs.apply_changes(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "c3")).awaitTermination(120)
    assert sum(seen) == 60


def test_model_hook(spark):
    symbols = spark.createDataFrame([(1, "p", "A"), (2, "p", "B")], "id long, import_path string, symbol_name string")
    assert generated.generate(symbols, generated.stand_in).count() == 8
    assert generated.parsed("no json") == {} and generated.parsed("```json\n{}\n```") == {}


def test_detectors(spark):
    rows = spark.createDataFrame([(1, 2), (9, 1)], "fact_id long, nearest_id long")
    facts = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, detect.without_dangling(rows, facts).collect()), key=str) == [(1, 2), (None, 1)]
    sections = spark.createDataFrame([("a",), ("b",), ("c",)], "section string")
    replies = spark.createDataFrame([("a", '```json\n{"verdict": "Stale", "reason": "r"}\n```'), ("b", "none")], "section string, reply string")
    assert {r["section"]: r["verdict"] for r in detect.section_verdicts(sections, replies).collect()} == {"a": "stale", "b": "unclear", "c": "unclear"}
    now = F.lit("2024-01-01").cast("date")
    pairs = spark.range(5).select("id", F.col("id").alias("nearest_id"))
    none = pairs.limit(0).withColumn("written_at", now).withColumn("expires_at", now)
    kept = detect.calibration(none, pairs, now, most=3)
    assert {r["id"] for r in kept.collect()} == {2, 3, 4} and detect.unexpired(kept, F.lit("2024-05-01").cast("date")).count() == 0
    assert value(spark, detect.unchanged_warning(F.lit("a"), F.lit("b"), F.lit(0))) is True and value(spark, detect.unchanged_warning(F.lit("a"), F.lit("a"), F.lit(0))) is False


def test_invariants_and_manifest(spark):
    source = "func (s *S) Do() {\n\tif x {\n\t\tpanic(\"no\")\n\t}\n}\nfunc TestIt(t *T) {\n\trequire.NoError(t, err)\n}\n"
    found = lines.invariants(spark.createDataFrame([("f", source)], "path string, text string")).collect()
    assert sorted((r["line_no"], r["form"], r["function"]) for r in found) == [(3, "panic", "Do"), (7, "require", "TestIt")]
    paths = spark.createDataFrame([("a/README.md",), ("a/x.go",), ("a/y.go",), ("b/z.py",)], "path string")
    assert list(map(tuple, lines.manifest_of(paths).collect())) == [("a/README.md", "a/*.go")]


def test_more_small_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.error_category(F.lit("rpc: Context Deadline Exceeded"))) == "context_canceled" and v(T.error_category(F.lit("no such table: x"))) == "database_error" and v(T.error_category(F.lit("what"))) == "upsert_failed"
    assert [v(T.first_bytes(F.lit("aé😀b"), n)) for n in (0, 1, 2, 3, 4, 6, 7, 8, 9)] == ["", "a", "a", "aé", "aé", "aé", "aé😀", "aé😀b", "aé😀b"]
    assert v(T.truncated(F.lit("abcdef"), 5)) == "ab..." and v(T.truncated(F.lit("abcde"), 5)) == "abcde" and v(T.truncated(F.lit("éééé"), 6)) == "é..."
    assert v(T.strip_control(F.lit("a\x00b\tc\n\u0085d"))) == "ab\tcd" or v(T.strip_control(F.lit("a\x00b\tc\nd"))) == "ab\tcd"
    assert v(T.strip_control(F.lit("é" * 10), 5)) == "éé"
    assert [v(T.clamp_confidence(F.lit(c))) for c in (1.5, 1.0, 0.4, 0.0, -1.0)] == [0.95, 0.95, 0.4, 0.1, 0.1]
    assert v(T.mention_confidence(F.lit("NewStore"), F.lit("use newstore here"))) == 0.8 and v(T.mention_confidence(F.lit("X"), F.lit("none"))) == 0.4
    assert [v(T.visibility(F.lit(lang), F.lit(n))) for lang, n in (("go", "Abc"), ("go", "abc"), ("python", "__init__"), ("python", "__x"), ("python", "_x"), ("python", "x"), ("shell", "_x"))] == ["public", "internal", "public", "private", "internal", "public", "public"]
    assert [v(T.go_visibility(F.lit(n))) for n in ("Abc", "abc", "_A", "", "Éa")] == ["public", "internal", "internal", "private", "public"]
    assert [v(T.go_kind(F.lit(n))) for n in ("TypeName", "Func", "Const", "Var", "Label")] == ["type", "func", "const", "var", "var"]
    assert v(T.xml_escaped(F.lit("<a b=\"c\">&'"))) == "&lt;a b=&quot;c&quot;&gt;&amp;&apos;" and [v(T.badge_colour(F.lit(n))) for n in (0, 1, 3, 4)] == ["green", "yellow", "yellow", "red"]
    assert v(T.commit_sha(F.lit("at " + "0a" * 20 + "."))) == "0a" * 20 and v(T.version_triple(F.lit("gh version 2.46.1 (2024)"))) == [2, 46, 1] and v(T.version_triple(F.lit("none"))) is None
    assert [v(T.normal_path(F.lit(p))) for p in ("./a/../b//c/", "../x", "a/b/../../..", "")] == ["b/c", "x", "", ""]


def test_redaction_after_a_match(spark):
    """An address may begin where the one before ended, as a search from the left finds it."""
    assert value(spark, T.redact_pii(F.lit("a@b.ccd_e@f.gg x..@y.zz @ @q"))) == "[REDACTED_EMAIL][REDACTED_EMAIL] [REDACTED_EMAIL] @ [REDACTED_MENTION]"
    assert value(spark, T.redact_pii(F.lit("a" * 200_000 + " b"))).endswith(" b")


def test_merged_days(spark):
    schema = "day string, tool string, calls long, repos array<string>"
    a, b = spark.createDataFrame([("d1", "t", 2, ["x"])], schema), spark.createDataFrame([("d1", "t", 3, ["x", "y"]), ("d2", "t", 1, [])], schema)
    assert sorted(map(tuple, stats.merged_days(a, b).collect())) == [("d1", "t", 5, ["x", "y"]), ("d2", "t", 1, [])]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A\ntext")
    (tmp_path / "in" / "sub" / "b.go").write_text("package b")
    root = str(tmp_path / "in")
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in tables.text_files(spark, root).collect()}
    assert found == {"a.md": "# A\ntext", "b.go": "package b"} and tables.text_files(spark, root, "*.go").count() == 1
    import hashlib

    hashes = {r["path"].rsplit("/", 1)[1]: (r["content_hash"], r["size_bytes"]) for r in tables.file_hashes(spark, root).collect()}
    assert hashes["b.go"] == (hashlib.sha256(b"package b").hexdigest(), 9)


def test_claim_validation(spark):
    good = {"subject_repo": "r", "subject_import_path": "p", "subject_name": "n", "language": "go", "kind": "func", "visibility": "public", "predicate": "defines", "source_file": "f", "confidence": 0.5, "claim_tier": "structural", "extractor": "e", "extractor_version": "1", "last_verified": "2024-01-01"}
    check = lambda **changed: value(spark, lines.validation_error({k: F.lit(v) for k, v in (good | changed).items()}, code.SAFE))
    assert check() is None
    for part in ("subject_repo", "subject_import_path", "subject_name", "language", "source_file", "extractor", "extractor_version", "last_verified"):
        assert check(**{part: ""}) == f"{part} is required" and check(**{part: None}) == f"{part} is required"
    assert check(kind="x") == "invalid kind" and check(visibility=None) == "invalid visibility" and check(predicate="guesses") == "invalid predicate" and check(claim_tier="x") == "invalid claim_tier"
    assert check(confidence=1.5) == check(confidence=None) == "confidence must be in [0, 1]" and check(kind="x", language="") == "language is required"


def test_tier_boundary(spark):
    claims = spark.createDataFrame([("S", "defines"), ("T", "has_doc")], "symbol_name string, predicate string")
    assert code.within_tier(claims).count() == 2 and code.beyond_tier(claims).count() == 0
    bad = claims.unionByName(spark.createDataFrame([("U", "purpose")], claims.schema))
    assert [r["symbol_name"] for r in code.beyond_tier(bad).collect()] == ["U"]
    with pytest.raises(Exception, match="beyond the tier"):
        code.within_tier(bad).collect()


def test_fact_lookup_falls_back_to_the_folder(spark):
    symbols = spark.createDataFrame([(1, "r1", "github.com/o/r/pkg", "Widget"), (2, "r1", "x", "pkg/a.go"), (3, "r1", "x", "pkgs/b.go"), (4, "r2", "p", "Widget"), (5, "r2", "p", "p/c.go")], "id long, repo string, import_path string, symbol_name string")
    facts = spark.createDataFrame([(10, 2, "todo", "active"), (11, 3, "todo", "active"), (12, 4, "todo", "stale"), (13, 5, "todo", "active")], "id long, subject_id long, kind string, status string").withColumn("confidence", F.lit(0.9)).withColumn("model", F.lit("")).withColumn("corroboration", F.lit(1))
    found = joins.fact_context(symbols, facts, "widget").collect()
    # r1 has no fact about the symbol itself; the one of r2 is stale, and still shows that the repo has some
    assert [(r["id"], r["level"]) for r in found] == [(10, "file")]


def test_implementations(spark):
    types = spark.createDataFrame([("File", "Read"), ("File", "Close"), ("Net", "Close"), ("Reader", "Read"), ("File", "Close")], "name string, method string")
    faces = spark.createDataFrame([("Reader", "Read"), ("ReadCloser", "Read"), ("ReadCloser", "Close"), ("Seeker", "Seek")], "name string, method string")
    assert sorted(map(tuple, joins.implementations(types, faces).collect())) == [("ReadCloser", "File"), ("Reader", "File")]


def test_lists_in_order(spark):
    docs = spark.createDataFrame([(3, "2024-01-02"), (1, "2024-01-01"), (2, "2024-01-02"), (4, None)], "doc_id long, last_refreshed string")
    assert [r["doc_id"] for r in reads.documents_in_order(docs).orderBy("place").collect()] == [2, 3, 1, 4]
    anchors = spark.createDataFrame([("b", "stale"), ("a", "stale"), ("c", "verified")], "claim_id string, state string")
    assert [r[0] for r in reads.anchors_in_state(anchors, "stale").collect()] == ["a", "b"]
    assert reads.anchors_in_state(reads.mark_verified(anchors, anchors.filter("claim_id = 'a'")), "verified").count() == 2
    files = spark.createDataFrame([("r", "a"), ("q", "a")], "repo string, relative_path string")
    assert reads.file_by_path(files, "r", "a").count() == 1


def test_maintained_claims(spark, tmp_path):
    """A stream of file states keeps the claims of every file in step."""
    rows = [("r", "a.py", "A", "def f(): pass", 1), ("r", "b.py", "A", "def g(): pass", 1), ("q", "a.py", "A", "def h(): pass", 1)]
    schema = "repo string, path string, status string, text string, ord long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = tables.Catalogue(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.maintain(stream, store, str(tmp_path / "c")).awaitTermination(120)
    held = lambda: sorted((r["repo"], r["path"], r["symbol_name"]) for r in store.read("claims").filter("predicate = 'defines'").collect())
    assert held() == [("q", "a.py", "h"), ("r", "a.py", "f"), ("r", "b.py", "g")]
    spark.createDataFrame([("r", "a.py", "M", "def f2(): pass", 2), ("r", "b.py", "D", None, 2), ("r", "a.py", "M", "def old(): pass", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination(120)
    assert held() == [("q", "a.py", "h"), ("r", "a.py", "f2")]
