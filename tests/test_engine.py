"""Repositories that share paths, patterns as tables, configuration files, liveness, enrichment, limiters in event time."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from loamstone.operators import enrich, globs, joins, liveness, reads, stats
from loamstone.sources import config, lines
from loamstone.sources.store import Store
from loamstone.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# ---- repositories that share paths ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shared(spark):
    """Both repositories have a.go and b.go; in r1 a.go defines lib, which b.go imports, in r2 only b.go imports it."""
    symbols = spark.createDataFrame([(1, "r1", "lib", "public"), (2, "r2", "other", "public"), (3, "r2", "lib", "internal"), (4, "r1", "b.go", "public"), (5, "r1", "app", "internal")], "id long, repo string, import_path string, visibility string")
    claims = spark.createDataFrame(
        [("r1", "a.go", 1, "defines", None, "k1"), ("r1", "b.go", 5, "imports", "lib", "k2"), ("r2", "b.go", 5, "imports", "lib", "k3"), ("r2", "a.go", 2, "defines", None, "k4"), ("r1", "c.go", 4, "has_doc", None, "k5")],
        "repo string, source_file string, subject_id long, predicate string, object_text string, claim_key string",
    ).withColumns({"claim_tier": F.lit("semantic"), "last_verified": F.lit("2024-01-02").cast("timestamp")})
    files = spark.createDataFrame([(r, p, False, True, dt.date(2024, 1, 1 if r == "r1" else 5)) for r in ("r1", "r2") for p in ("a.go", "b.go")], "repo string, relative_path string, deleted boolean, never_mined boolean, last_indexed date")
    facts = spark.createDataFrame([(1, "active"), (3, "active"), (4, "active")], "subject_id long, status string")
    return symbols, claims, files, facts


def test_joins_keep_to_their_repository(spark, shared):
    symbols, claims, files, facts = shared
    assert rows(reads.files_for_package(files, claims, symbols, "lib")) == [("r1", "a.go")]
    changed = spark.createDataFrame([("r1", "a.go"), ("r2", "a.go")], "repo string, path string")
    assert rows(joins.reverse_dependencies(symbols, claims, changed), "repo", "path") == [("r1", "b.go")]
    assert rows(joins.reverse_dependencies(symbols, claims.drop("repo"), changed.select("path").distinct()), "path") == [("b.go",)]
    assert stats.coverage(files, symbols, facts, claims, F.lit("2024-01-11").cast("timestamp")).first()["covered_files"] == 1
    told = {r["import_path"]: r["enriched"] for r in stats.enrichment_status(symbols, claims, files, F.lit("2024-01-03").cast("timestamp")).collect()}
    assert told["lib"].startswith("Enriched at") and told["other"].startswith("Enrichment stale") and told["app"].startswith("Enrichment stale")
    ranked = {(r["repo"], r["relative_path"]): r["priority"] for r in stats.mining_priority(files, symbols, claims, facts, 9).collect()}
    assert ranked == {("r1", "a.go"): 3 + 1 - 5, ("r2", "a.go"): 3 + 1, ("r1", "b.go"): 1, ("r2", "b.go"): 1}
    # by import path: symbol 4 of r1 stands for b.go there; its fact counts for that path in any repository
    by_path = {(r["repo"], r["relative_path"]): r["priority"] for r in stats.file_priority(files, symbols, claims, facts, 9).collect()}
    assert by_path == {("r1", "a.go"): 0, ("r2", "a.go"): 0, ("r1", "b.go"): 3 + 1 - 5, ("r2", "b.go"): -5}


def test_nothing_is_cut(spark):
    owners = " ".join(f"@o{k}" for k in range(10_005))
    assert lines.code_owners(spark.createDataFrame([("f", f"*.go {owners}")], "path string, text string")).count() == 10_005
    long = "old/" + "x" * 12_000
    assert joins.staged_paths(spark.createDataFrame([(long,)], "path string"), [("old", "new")]).first()["module"] == "new" + long[3:]


# ---- patterns and prefixes of tables -------------------------------------------------------------------------------


def test_globs_meet_their_folders(spark):
    paths = spark.createDataFrame([("a/b/c.go",), ("a/c.go",), ("c.go",), ("a/b/c.py",), ("a+b/c.go",), ("a/b.d/Makefile",), ("x/y/z/w.go",)], "path string")
    asked = [("*.go", "1"), ("a/*.go", "2"), ("a/**/*.go", "3"), ("a/b/c.??", "4"), ("a+b/c.go", "5"), ("a/b.d/Make*", "6"), ("[ab]/c.go", "7"), ("**/w.go", "8"), ("a/b/c.go", "9"), (None, "0")]
    table = spark.createDataFrame(asked, "glob string, doc string")
    plain = [("c.go", "1"), ("a/c.go", "2"), ("a/b/c.go", "3"), ("a/b/c.go", "4"), ("a/b/c.py", "4"), ("a+b/c.go", "5"), ("a/b.d/Makefile", "6"), ("a/c.go", "7"), ("a/b/c.go", "9")]
    assert rows(globs.manifest_docs(paths, table)) == sorted(plain)
    deep = rows(globs.manifest_docs(paths, table, doublestar=True))
    assert deep == sorted([*plain, ("a/c.go", "3"), ("x/y/z/w.go", "8")])
    listed = [(g, [d]) for g, d in asked if g]
    assert deep == rows(joins.manifest_docs(paths, listed, doublestar=True).distinct())


def test_many_globs_and_prefixes(spark):
    n = 10_000
    table = spark.range(n).select(F.concat(F.lit("pkg"), "id", F.lit("/*.go")).alias("glob"), F.concat(F.lit("d"), "id").alias("doc"))
    paths = spark.range(3 * n).select(F.concat(F.lit("pkg"), F.col("id") % n, F.lit("/f"), "id", F.when(F.col("id") % 3 == 0, ".go").otherwise(".py")).alias("path"))
    found = globs.manifest_docs(paths, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == n
    old = spark.range(n).select(F.concat(F.lit("m"), "id").alias("old"), F.concat(F.lit("s"), "id").alias("new"))
    told = globs.replaced_paths(spark.range(n).select(F.concat(F.lit("m"), "id", F.lit("/x")).alias("path")), old)
    assert told.filter("module <> concat('s', substring(path, 2))").count() == 0
    back = globs.original_paths(told.select("module"), old)
    assert back.filter("path <> concat('m', substring(module, 2))").count() == 0 and back.count() == n


def test_longest_prefix(spark):
    directives = spark.createDataFrame([("a", "A"), ("a/b", "AB"), ("a/bc", "ABC"), ("", "no")], "old string, new string")
    paths = ["a", "a/b", "a/b/c", "a/bcd", "a/bc/d", "ab", "z@v1/y", "a/b/" + "q" * 11_000]
    told = {r["path"]: r["module"] for r in globs.replaced_paths(spark.createDataFrame([(p,) for p in paths], "path string"), directives).collect()}
    assert told == {"a": "A", "a/b": "AB", "a/b/c": "AB/c", "a/bcd": "A/bcd", "a/bc/d": "ABC/d", "ab": "ab", "z@v1/y": "z/y", paths[-1]: "AB/" + "q" * 11_000}
    plain = {r["path"]: r["module"] for r in joins.staged_paths(spark.createDataFrame([(p,) for p in paths], "path string"), [("a", "A"), ("a/b", "AB"), ("a/bc", "ABC")]).collect()}
    assert told == plain


# ---- configuration files -------------------------------------------------------------------------------------------

DOC_MAP = """# which documents
repos:
  - name: host/org/one   # the first
    short: one
    mappings:
      - source: "cmd/**/*.go"
        docs:
          - docs/01.md
          - 'docs/02 x.md'
      - source: pkg/*.go
        docs:
        - docs/01.md

  - name: host/org/two
    short: two
    mappings:
    - source: "*.py"
      docs:
        - docs/03.md
"""


def test_document_map(spark):
    files = spark.createDataFrame([("m.yaml", DOC_MAP), ("bad.yaml", "repos:\n\t- name: x\n"), ("odd.yaml", "- a\n"), ("empty.yaml", ""), ("none.yaml", None)], "path string, text string")
    assert rows(config.document_map(files), "repo", "short", "glob", "doc") == [
        ("host/org/one", "one", "cmd/**/*.go", "docs/01.md"), ("host/org/one", "one", "cmd/**/*.go", "docs/02 x.md"), ("host/org/one", "one", "pkg/*.go", "docs/01.md"), ("host/org/two", "two", "*.py", "docs/03.md"),
    ]
    errors = {r["path"]: r["error"] for r in config.config_entries(files).filter("error is not null").collect()}
    assert set(errors) == {"bad.yaml", "odd.yaml"} and errors["bad.yaml"].startswith("line 2")
    own = spark.createDataFrame([("manifest", "mappings:\n  - source: a/*.go\n    docs: \n      - a/README.md\n  - source: b.go\n    docs:\n      - b.md\n")], "path string, text string")
    assert rows(config.manifest(own), "glob", "doc") == [("a/*.go", "a/README.md"), ("b.go", "b.md")]
    # the map joined with changed files of its repositories
    changed = spark.createDataFrame([("host/org/one", "cmd/x/y.go"), ("host/org/two", "cmd/x/y.go"), ("host/org/two", "z.py")], "repo string, path string")
    assert rows(globs.glob_join(changed, config.document_map(files).select("repo", "glob", "doc"), True, ("repo",)), "repo", "doc") == [("host/org/one", "docs/01.md"), ("host/org/one", "docs/02 x.md"), ("host/org/two", "docs/03.md")]


def test_schedules(spark, tmp_path):
    path = tmp_path / "schedules.json"
    path.write_text('{"repo": "a", "cron": "*/15 * * * *", "concurrency": 2}\n\n{broken\n{"repo": "b"}\n{"repo": "c", "cron": "0 0 29 2 *", "other": [1]}\n{"repo": "d", "cron": "0 0 30 2 *"}\n')
    found, broken = config.schedules(spark, str(path))
    assert rows(found, "repo", "concurrency") == [("a", 2), ("c", None), ("d", None)]
    assert [r[0] for r in rows(broken)] == ['{"repo":"b"}', "{broken"]
    told = {r["repo"]: r["next_run"] for r in jobs.next_runs(found, dt.datetime(2024, 1, 10, 10, 7)).collect()}
    assert told == {"a": dt.datetime(2024, 1, 10, 10, 15), "c": dt.datetime(2024, 2, 29), "d": None}


# ---- liveness and enrichment ---------------------------------------------------------------------------------------


def prober():
    def probe(ref):
        if "fail" in ref:
            raise OSError("no answer")
        return ref.encode(), "gone" not in ref

    return probe


def test_liveness(spark, tmp_path):
    store, probe = Store(spark, str(tmp_path / "s")), prober()
    refs = spark.createDataFrame([("a",), ("gone",), ("fail",), ("a",), ("",), (None,)], "source_ref string")
    first = liveness.check(store, refs, probe, dt.datetime(2024, 1, 1), buckets=2)
    assert rows(first, "source_ref", "live", "how") == [("a", True, "probed"), ("fail", None, "failed"), ("gone", False, "probed")]
    # within the day what was found holds, after it every source is probed again
    again = liveness.check(store, refs, probe, dt.datetime(2024, 1, 1, 23), buckets=2)
    assert rows(again, "source_ref", "how") == [("a", "cached"), ("fail", "failed"), ("gone", "cached")]
    later = liveness.check(store, refs, probe, dt.datetime(2024, 1, 2), buckets=2)
    assert rows(later, "source_ref", "how") == [("a", "probed"), ("fail", "failed"), ("gone", "probed")]
    assert rows(store.read("liveness"), "source_ref", "checked_at") == [("a", dt.datetime(2024, 1, 2)), ("gone", dt.datetime(2024, 1, 2))]
    # beyond the budget a source counts as live, and is not kept
    many = spark.range(10).select(F.concat(F.lit("gone"), "id").alias("source_ref"))
    held = liveness.check(store, many, probe, dt.datetime(2024, 1, 3), budget=4, buckets=2)
    assert held.filter("how = 'probed' and not live").count() == 4 and held.filter("how = 'unchecked' and live and content_hash = ''").count() == 6
    assert store.read("liveness").filter("source_ref like 'gone_'").count() == 4


def test_liveness_stream(spark, tmp_path):
    """What a micro-batch has probed is known to the next one, also of another run, until it expires."""
    store, probe, seen = Store(spark, str(tmp_path / "s")), prober(), []
    now = [dt.datetime(2024, 1, 1)]
    keep = lambda df, n: seen.append({r["source_ref"]: r["how"] for r in df.collect()})
    put = lambda *refs: spark.createDataFrame([(r,) for r in refs], "source_ref string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: liveness.check_stream(spark.readStream.schema("source_ref string").parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), probe, lambda: now[0], keep, buckets=2).awaitTermination(120)
    put("a", "gone"), run()
    put("a", "b"), run()
    now[0] += dt.timedelta(hours=25)
    put("a"), run()
    assert seen == [{"a": "probed", "gone": "probed"}, {"a": "cached", "b": "probed"}, {"a": "probed"}]


def test_sections_are_checked(spark):
    from loamstone.operators import detect

    text = "# T\nIntro to `FooBar` and `Gone`.\n## Empty\n\n## Use\nCall makeThing twice.\n"
    texts = spark.createDataFrame([("r.md", text), ("none.md", None)], "path string, text string")
    symbols = spark.createDataFrame([("FooBar", "type", "a.go"), ("FooBar", "func", "b.go"), ("other", "func", "c.go")], "symbol_name string, kind string, file_path string")
    prompts = detect.section_prompts(texts, symbols)
    told = {r["heading"]: (r["n_known"], r["prompt"]) for r in prompts.collect()}
    assert set(told) == {"Overview", "Use"} and told["Overview"][0] == 1 and told["Overview"][1].endswith("Symbols:\n- FooBar (func) in a.go and 1 more") and told["Use"][0] == 0

    def model():
        def complete(system, prompt):
            if "makeThing" in prompt:
                raise RuntimeError("no model")
            return '```json\n{"verdict": "STALE", "reason": "old"}\n```'

        return complete

    assert rows(detect.checked_sections(prompts, model()), "heading", "verdict", "reason") == [("Overview", "stale", "old"), ("Use", "unclear", None)]


def test_drift_takes_liveness(spark):
    facts = spark.createDataFrame([(k, k if k < 7 else 99, "stale" if k == 6 else "active", "h") for k in range(1, 8)], "id long, subject_id long, status string, staleness_hash string")
    evidence = spark.createDataFrame([(k, "blame" if k == 5 else "pr_comment", f"u{k}", "h") for k in range(1, 8)], "fact_id long, source_type string, source_ref string, content_hash string")
    symbols = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    checked = spark.createDataFrame([("u1", True, "h"), ("u2", True, "other"), ("u3", False, ""), ("u4", None, None), ("u5", False, ""), ("u6", False, "")], "source_ref string, live boolean, content_hash string")
    told = {r["id"]: r["new_status"] for r in liveness.live_drift_status(facts, evidence, symbols, checked).collect()}
    assert told == {1: "active", 2: "stale", 3: "stale", 4: "active", 5: "active", 6: "stale", 7: "quarantined"}


def test_enrichment_plan(spark):
    symbols = spark.createDataFrame([(k, "r", f"p{k}", f"S{k}", "func", "public") for k in range(1, 9)], "id long, repo string, import_path string, symbol_name string, kind string, visibility string")
    imports = [(0, "imports", f"p{k}", "structural", None) for k in range(1, 9) for _ in range(k)]
    claims = spark.createDataFrame([*imports, (8, "purpose", "x", "semantic", "v@h8"), (7, "purpose", "x", "semantic", "v@old")], "subject_id long, predicate string, object_text string, claim_tier string, extractor_version string")
    hashes = spark.createDataFrame([(8, "h8"), (7, "h7")], "subject_id long, content_hash string")
    attempts = spark.createDataFrame([(6, k, False) for k in range(3)] + [(5, 0, False), (5, 1, True)], "subject_id long, ord long, ok boolean")
    planned = enrich.plan(symbols, claims, hashes, attempts, "v", cap=6, budget=10)
    assert {r["id"]: (r["place"], r["state"], r["n_calls"]) for r in planned.collect()} == {
        8: (1, "cached", 0), 7: (2, "enrich", 4), 5: (3, "enrich", 4), 4: (4, "enrich", 2), 3: (5, "over_budget", 0), 2: (6, "over_budget", 0), 6: (None, "given_up", 0),
    }
    assert {r["state"]: (r["n_symbols"], r["n_calls"]) for r in enrich.summary(planned).collect()}["enrich"] == (3, 10)
    forced = enrich.plan(symbols, claims, hashes, attempts, "v", force=True)
    assert forced.filter("state = 'enrich' and n_calls = 4").count() == 7


# ---- limiters in event time ----------------------------------------------------------------------------------------

CALLS = "call_id long, session string, path string, ts timestamp"


@pytest.fixture
def calls(spark, tmp_path):
    """Calls in any order within the lateness, in several files, and a last one long after all others."""
    rng = random.Random(4)
    at = dt.datetime(2024, 1, 1)
    listed = [(k, f"s{rng.randrange(3)}", f"p{rng.randrange(2)}", at + dt.timedelta(seconds=20 * k + rng.randrange(600))) for k in range(400)]
    table = spark.createDataFrame(listed, CALLS)
    for n in range(4):
        spark.createDataFrame(rng.sample(listed[100 * n : 100 * n + 100], 100), CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9999, "end", "end", at + dt.timedelta(days=30))], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    return table, stream


def test_bucket_stream_equals_table(spark, calls, tmp_path):
    table, stream = calls
    out = jobs.ordered_bucket_stream(stream, 1 / 60, 3.0)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    expected = rows(jobs.token_bucket(table, 1 / 60, 3.0), "key", "call_id", "admitted")
    assert rows(spark.read.parquet(str(tmp_path / "out")).filter("call_id <> 9999"), "key", "call_id", "admitted") == expected
    assert 0 < sum(r[2] for r in expected) < len(expected)


def test_two_level_stream_equals_table(spark, calls, tmp_path):
    table, stream = calls
    jobs.two_level_stream(stream, str(tmp_path / "levels"), (1 / 60, 1 / 300), (3.0, 2.0))
    batch = jobs.two_level(table, (1 / 60, 1 / 300), (3.0, 2.0))
    first, second = (spark.read.schema(jobs._PASSED).parquet(str(tmp_path / "levels" / n)) for n in ("first", "second"))
    assert rows(first.filter("call_id <> 9999 and admitted"), "call_id") == rows(batch.filter("by_session"), "call_id")
    told = {r["call_id"]: r["admitted"] for r in batch.filter("by_session").collect()}
    # what the second level has not passed yet waits for its own watermark
    seen = {r["call_id"]: r["admitted"] for r in second.collect()}
    assert len(seen) > 50 and all(told[k] == v for k, v in seen.items())


# ---- lines -----------------------------------------------------------------------------------------------------


def test_lines_stay_with_their_text(spark):
    texts = spark.createDataFrame([("p", "x")], "path string, text string")
    for read in (lines.markers, lines.hunks, lines.context_claims, lines.blame_lines, lines.invariants):
        assert "Exchange" not in read(texts)._jdf.queryExecution().executedPlan().toString()
        assert read(texts.withColumn("text", F.lit(None).cast("string"))).count() == 0


# ---- documents, entries, checks ------------------------------------------------------------------------------------


def test_saved_documents(spark, tmp_path):
    from loamstone.operators.documents import Documents

    kept = Documents(Store(spark, str(tmp_path / "d")), "document_id string, answer string, status string", max_revisions=2, buckets=2)
    make = lambda *listed: spark.createDataFrame(list(listed), "document_id string, answer string, status string")
    for n in range(4):
        assert kept.save(make(("a", f"v{n}", "fresh"), *([("b", "only", "fresh")] if n == 0 else [])), "s", n)
    assert not kept.save(make(("a", "v0", "fresh")), "s", 3)
    assert rows(kept.documents(), "document_id", "answer") == [("a", "v3"), ("b", "only")]
    assert rows(kept.revisions(), "document_id", "answer", "revision_num") == [("a", "v1", 2), ("a", "v2", 3)]
    kept.update_status(spark.createDataFrame([("a", "stale")], "document_id string, status string"))
    with pytest.raises(LookupError):
        kept.update_status(spark.createDataFrame([("a", "x"), ("z", "x")], "document_id string, status string"))
    assert rows(kept.documents(), "document_id", "status") == [("a", "stale"), ("b", "fresh")]
    for bad in (make((None, "x", "fresh")), make(("", "x", "fresh")), make(("c", "x", "f"), ("c", "y", "f"))):
        with pytest.raises(ValueError):
            kept.save(bad)
    kept.delete(spark.createDataFrame([("a",)], "document_id string"))
    assert rows(kept.documents(), "document_id") == [("b",)] and kept.revisions().count() == 0


def test_entries_of_prose(spark):
    texts = [("cited", "- [a](/r/-/blob/f.go?L9-3)\n- [zero](/r/-/blob/f.go?L0)\nsee github.com/x/y"), ("prose", "in github.com/a/b and gitlab.com/c/d.e, github.com/a/b; not example.com/a/b"), ("none", "nothing"), ("null", None)]
    found = lines.manifest_entries(spark.createDataFrame(texts, "path string, text string"))
    assert rows(found, "path", "repo", "first", "last", "fuzzy") == [("cited", "r", 9, 9, False), ("prose", "github.com/a/b", None, None, True), ("prose", "gitlab.com/c/d.e", None, None, True)]


def test_order_of_times(spark):
    docs = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 5)), (2, dt.datetime(2024, 1, 2, 9)), (3, dt.datetime(2024, 1, 3)), (4, None), (5, dt.datetime(2024, 1, 2, 9))], "doc_id long, last_refreshed timestamp")
    assert [r["doc_id"] for r in reads.documents_in_order(docs).orderBy("place").collect()] == [3, 2, 5, 1, 4]
    files = spark.createDataFrame([("r", f"f{k}", k == 4, 10, dt.datetime(2024, 1, 1, k)) for k in range(5)], "repo string, relative_path string, deleted boolean, size_bytes int, last_indexed timestamp")
    assert rows(stats.eviction(files, F.lit(25)), "relative_path") == [("f0",), ("f1",), ("f4",)]


def test_nearest_body_both_ways(spark, monkeypatch):
    from loamstone.operators import merge

    rng = random.Random(2)
    facts = spark.createDataFrame([(k, " ".join(rng.choices("abcdefghij", k=6))) for k in range(120)], "id long, body string")
    inside = rows(merge.nearest_body(facts, recent=30))
    monkeypatch.setattr(merge, "BROADCAST_TOKENS", -1)
    assert rows(merge.nearest_body(facts, recent=30)) == inside and len(inside) > 100


def test_checks_of_single_rows(spark):
    from loamstone.functions import text as T
    from loamstone.operators import generated, merge

    facts = spark.createDataFrame([(1, "active", 0.5, "t")], "id long, status string, confidence double, last_verified string")
    verdicts = spark.createDataFrame([(1, "accept"), (2, "reject")], "id long, verdict string")
    assert merge.apply_verdicts(facts, verdicts, F.lit("now")).first()["last_verified"] == "now"
    with pytest.raises(LookupError):
        merge.apply_verdicts(facts, verdicts, F.lit("now"), strict=True)
    key = "extractor string, source_file string"
    old, new, ran = (spark.createDataFrame(x, key) for x in ([("go", "a"), ("go", "b"), ("py", "c")], [("go", "a")], [("go", "a"), ("go", "b"), ("go", "z")]))
    assert rows(merge.empty_extractions(old, new, ran)) == [("go", "b")]
    names = spark.createDataFrame([("https://host/o/repo.git",), ("git@host:o/r",), ("/home/me/work/",), ("work.git",)], "p string")
    assert [r[0] for r in names.select(T.repo_name(F.col("p"))).collect()] == ["repo", "r", "work", "work"]
    # a large package is several prompts in several tasks, and every symbol is asked about once
    symbols = spark.range(1000).select("id", F.lit("big").alias("import_path"), F.concat(F.lit("S"), "id").alias("symbol_name"))
    made = generated.generate(symbols, generated.stand_in)
    assert made.count() == 4000 and made.select("subject_id").distinct().count() == 1000
    assert re.search(r"hashpartitioning\([^)]*part#", made._jdf.queryExecution().toString())


def test_served_facts(spark):
    base = {"id": 1, "body": "b", "source_quote": "q", "kind": "quirk", "confidence": 0.5, "corroboration": 2, "status": "active", "extractor": "x", "extractor_version": "", "model": "m", "last_verified": "t"}
    make = lambda **other: joins.with_evidence(spark.createDataFrame([tuple((base | other).values())], "id long, body string, source_quote string, kind string, confidence double, corroboration long, status string, extractor string, extractor_version string, model string, last_verified string"), evidence)
    evidence = spark.createDataFrame([(1, 1, "blame", "c1", "h")], "fact_id long, ord long, source_type string, source_ref string, content_hash string")
    row = joins.served(make(extractor_version="3")).first()
    assert (row["extractor"], row["degraded"], row["evidence"][0]["source_ref"]) == ("x@3", True, "c1")
    assert joins.served(make(corroboration=3)).first()["degraded"] is False
    for field in ("source_quote", "status", "extractor", "last_verified"):
        with pytest.raises(Exception, match=f"fact 1 missing required field: {field}"):
            joins.served(make(**{field: ""})).collect()
    with pytest.raises(Exception, match="no evidence rows"):
        joins.served(make(id=1).filter("id = 1").withColumn("evidence", F.filter("evidence", lambda e: F.lit(False)))).collect()
