"""Stored tables: commits, incremental extraction, the full-text index, mining."""

import json

import pytest
from pyspark.sql import functions as F

from loamstone.operators import fulltext as fts
from loamstone.operators import ranks, search
from loamstone.sources import tables
from loamstone.sources.store import Conflict, Store
from loamstone.streaming import incremental, mining


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- commits -------------------------------------------------------------------------------------------------------


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_two_publishers(spark, tmp_path):
    """Both start from one version: the second is told, and what the first wrote stays."""
    first, second = (tables.Catalogue(spark, str(tmp_path / "c")) for _ in range(2))
    table = spark.createDataFrame([("r", 1)], "repo string, v int")
    first.publish("t", table)
    second.read("t")
    first.publish("t", table.withColumn("v", F.lit(2)))
    with pytest.raises(Conflict):
        second.publish("t", table.withColumn("v", F.lit(3)))
    assert [r["v"] for r in first.read("t").collect()] == [2]
    second.read("t")
    second.publish("t", table.withColumn("v", F.lit(4)))
    assert [r["v"] for r in first.read("t").collect()] == [4]
    assert first.expire("t") == 2 and [r["v"] for r in first.read("t").collect()] == [4]


def test_commit_of_several_tables(spark, store):
    change = store.begin()
    change.create("a", spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v")), ["k"], 8)
    change.declare("b", "k long", ["k"], 8)
    with pytest.raises(FileNotFoundError):
        store.read("a")
    change.commit()
    one, other = store.begin(), store.begin()
    key = spark.createDataFrame([(7,)], "k long")
    touched = one.rewrite("a", key, lambda rows: rows.withColumn("v", F.when(F.col("k") == 7, 1).otherwise(F.col("v"))))
    assert len(touched) == 1
    one.append("b", key)
    other.rewrite("a", key, lambda rows: rows.filter("k <> 7"))
    assert rows(store.read("b"), "k") == [] and store.read("a").filter("v = 1").count() == 0
    one.commit("s", 3)
    with pytest.raises(Conflict):
        other.commit()
    assert rows(store.read("a").filter("v = 1"), "k") == [(7,)] and store.read("a").count() == 100 and rows(store.read("b"), "k") == [(7,)]
    assert store.begin().done("s", 3) and not store.begin().done("s", 4) and not store.begin().done("t", 0)
    # the other buckets' files are the ones of the first commit
    bucket = store.read("a", touched).inputFiles()
    others = store.read("a", [b for b in range(8) if b not in touched]).inputFiles()
    assert all(one.id in f for f in bucket) and others and not any(one.id in f for f in others)
    assert store.expire() > 0 and store.read("a").count() == 100


# ---- incremental extraction ----------------------------------------------------------------------------------------

EVENTS = "repo string, path string, status string, text string, ord long"


def events(spark, *changes):
    return spark.createDataFrame(list(changes), EVENTS)


def test_batch_rewrites_its_buckets(spark, store):
    base = [("r", f"p{k}/a.py", "A", f"import p{(k + 1) % 40}\ndef f{k}(): pass\n", k) for k in range(40)]
    assert incremental.apply_batch(store, events(spark, *base), "s", 0, buckets=16)
    before = {name: set(store.read(name).inputFiles()) for name in ("files", "claims", "importers")}
    change = events(spark, ("r", "p3/a.py", "M", "def g3(): pass\n", 100))
    assert incremental.apply_batch(store, change, "s", 1, buckets=16)
    after = {name: set(store.read(name).inputFiles()) for name in before}
    folders = lambda files: {f.rsplit("/", 1)[0] for f in files}
    assert {name: len(folders(after[name] - before[name])) for name in ("files", "claims")} == {"files": 1, "claims": 1}
    run = store.read("runs").filter("batch = 1").first()
    # p2 imports the folder of the changed file; its own text and extractor are as they were
    assert (run["n_changed"], run["n_dependants"], run["n_extracted"], run["n_cached"]) == (1, 1, 1, 1)
    assert rows(store.read("claims").filter("path = 'p3/a.py'"), "predicate", "symbol_name") == [("defines", "g3")]
    assert rows(store.read("importers").filter("path = 'p3/a.py'"), "imported") == []
    # the same batch again, and one without news
    version = store.version()
    assert not incremental.apply_batch(store, change, "s", 1, buckets=16) and store.version() == version
    assert incremental.apply_batch(store, change, "s", 2, buckets=16)
    assert store.read("runs").filter("batch = 2").first()["n_extracted"] == 0


def test_dependants_are_read_again_by_a_newer_extractor(spark, store):
    base = events(spark, ("r", "lib/a.py", "A", "def f(): pass\n", 1), ("r", "app.py", "A", "import lib\n", 1), ("q", "app.py", "A", "import lib\n", 1), ("r", "far.py", "A", "import os\n", 1))
    incremental.apply_batch(store, base, "s", 0, version="1", buckets=4)
    incremental.apply_batch(store, events(spark, ("r", "lib/a.py", "M", "def g(): pass\n", 2)), "s", 1, version="2", buckets=4)
    assert rows(store.read("files"), "repo", "path", "extractor_version") == [("q", "app.py", "1"), ("r", "app.py", "2"), ("r", "far.py", "1"), ("r", "lib/a.py", "2")]


def test_deleted_generated_and_returning_files(spark, store):
    incremental.apply_batch(store, events(spark, ("r", "a.py", "A", "def f(): pass\n", 1), ("r", "x.pb.go", "A", "package x\nfunc F() {}\n", 1)), "s", 0, buckets=2)
    assert rows(store.read("claims"), "path", "symbol_name") == [("a.py", "f")]
    incremental.apply_batch(store, events(spark, ("r", "a.py", "D", None, 2), ("r", "never.py", "D", None, 2)), "s", 1, buckets=2)
    assert store.read("claims").count() == 0 and rows(store.read("files"), "path", "deleted") == [("a.py", True)]
    incremental.apply_batch(store, events(spark, ("r", "a.py", "A", "def f(): pass\n", 3)), "s", 2, buckets=2)
    assert rows(store.read("claims"), "symbol_name") == [("f",)] and rows(store.read("files"), "deleted") == [(False,)]


def test_overtaken_writer_starts_again(spark, store, monkeypatch):
    incremental.apply_batch(store, events(spark, ("r", "a.py", "A", "def f(): pass\n", 1)), "s", 0, buckets=2)
    plain, calls = incremental._apply, []

    def overtaken(change, changes, stream, batch, version):
        if not calls:
            calls.append(batch)
            other = store.begin()
            other.append("importers", spark.createDataFrame([("q", "os", "z.py")], incremental.IMPORTERS))
            other.commit("other", 0)
        plain(change, changes, stream, batch, version)

    monkeypatch.setattr(incremental, "_apply", overtaken)
    assert incremental.apply_batch(store, events(spark, ("r", "b.py", "A", "def g(): pass\n", 1)), "s", 1, buckets=2)
    assert rows(store.read("claims"), "symbol_name") == [("f",), ("g",)] and rows(store.read("importers"), "path") == [("z.py",)]


def test_incremental_stream(spark, store, tmp_path):
    """The first load of a repository, then a stream of changes; resumed, it takes only what is new."""
    files = spark.createDataFrame([("r", "a.py", "def f(): pass"), ("r", "b.py", "def g(): pass")], "repo string, path string, text string")
    incremental.full_load(files).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.maintain(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), buckets=2).awaitTermination(120)
    run(), run()
    assert rows(store.read("claims"), "path", "symbol_name") == [("a.py", "f"), ("b.py", "g")] and store.read("runs").count() == 1
    events(spark, ("r", "a.py", "M", "def f2(): pass", 2), ("r", "b.py", "D", None, 2), ("r", "a.py", "M", "def old(): pass", 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(store.read("claims"), "path", "symbol_name") == [("a.py", "f2")]


# ---- full-text index -----------------------------------------------------------------------------------------------

FACTS = "id long, body string, source_quote string, kind string, status string, subject_id long"


def facts(spark):
    listed = [
        (1, "The cache must be warm before the first call", "keep it warm", "quirk"), (2, "Warm cache, cold cache: cache", "", "todo"), (3, "Café noir before dawn", None, "quirk"),
        (4, "call the cache first", "the first cache call", "todo"), (5, "nothing to see", "cached values", "quirk"), (6, None, None, "todo"), (9000, "the first call", "a first", "quirk"), (-5, "cache of old", "", "quirk"),
    ]
    return spark.createDataFrame([(*r[:4], "stale" if r[0] == 5 else "active", r[0] * 10) for r in listed], FACTS)


@pytest.fixture
def index(spark, store):
    index = fts.Index(store)
    index.rebuild(facts(spark), 8)
    return index


def found(df):
    return [r["id"] for r in df.collect()]


def test_same_scores_as_the_scan(spark, index):
    table = facts(spark)
    w, any_of = fts.word, fts.any_of
    asked = [
        (w("cache"), {"terms": ["cache"]}), (fts.all_of(w("the"), w("CALL")), {"terms": ["the", "call"]}), (fts.all_of(w("the"), fts.prefix("war")), {"terms": ["the"], "prefixes": ("war",)}),
        (fts.phrase("first call"), {"terms": [], "phrases": ("first call",)}), (fts.but(any_of(w("cache"), w("cafe"), w("absent")), w("first")), {"terms": [], "any_of": ("cache", "cafe", "absent"), "none_of": ("first",)}),
        (w("nowhere"), {"terms": ["nowhere"]}),
    ]
    for query, arguments in asked:
        assert [tuple(r) for r in index.search(query, table).collect()] == [tuple(r) for r in search.search(table, **arguments).select("id", "kind", "score").collect()]
    repos = table.select("subject_id", F.concat(F.lit("r"), "id").alias("repo"))
    assert [tuple(r) for r in index.search(w("cache"), table, kind="todo", repos=repos).collect()] == [tuple(r) for r in search.search(table, ["cache"], kind="todo", repos=repos).select("id", "kind", "score", "repo").collect()]


def test_columns_phrases_and_near(spark, index):
    table, w = facts(spark), fts.word
    search_ = lambda q, **s: sorted(found(index.search(q, table, **s)))
    assert search_(w("first", "source_quote")) == [4, 9000]
    assert search_(w("warm cache")) == [2]  # a phrase, not across columns
    assert search_(fts.prefix("cach")) == [-5, 1, 2, 4]
    assert search_(fts.prefix("cach"), status="stale") == [5]
    assert search_(fts.near(w("cache"), w("call"), within=1)) == [4]
    assert search_(fts.near(w("cache"), w("call"), within=6)) == [1, 4]
    assert search_(fts.near(w("warm"), w("the first"), w("cache"), within=4)) == [1]
    assert search_(fts.near(w("keep"), w("call"), within=50)) == []  # in two columns
    with pytest.raises(ValueError):
        w("...")
    with pytest.raises(ValueError):
        fts.near(w("a"))


def test_search_lists_only_the_asked_buckets(index):
    postings = index.postings(fts.all_of(fts.word("noir"), fts.prefix("nois")))
    folders = {f.split("/bucket=")[1].split("/")[0] for f in postings.inputFiles()}
    assert len(folders) == 1 < len({f.split("/bucket=")[1].split("/")[0] for f in index.store.read("postings").inputFiles()})
    assert {r["term"] for r in postings.collect()} == {"noir"}


def test_blocks_that_cannot_win_are_not_scored(spark, store):
    """One block holds the short facts with many hits; the bounds of all others are below what it reaches."""
    listed = [(k * fts.BLOCK_IDS, "rare " + "filler " * 60, "", "todo", "active", 0) for k in range(1, 40)] + [(k, "rare rare rare", "", "todo", "active", 0) for k in range(12)]
    table = spark.createDataFrame(listed, FACTS)
    index = fts.Index(store)
    index.rebuild(table, 2)
    query = fts.word("rare")
    n, average = index._totals()
    blocks = index.blocks(query, index._weights(query, n), average)
    best = index.search(query, table, limit=5)
    assert found(best) == [0, 1, 2, 3, 4]
    least = best.collect()[-1]["score"]
    assert blocks.filter(F.round("bound", 6) >= least).count() == 1 < blocks.count()
    assert len(found(index.search(query, table, limit=30))) == 30


def test_sync_equals_rebuild(spark, tmp_path):
    now = facts(spark)
    then = now.filter("id <> 4").withColumn("body", F.when(F.col("id") == 2, "old cache words").otherwise(F.col("body")))
    moved = fts.Index(Store(spark, str(tmp_path / "moved")))
    moved.rebuild(then, 4)
    kept = set(moved.store.read("postings").inputFiles())
    assert moved.sync(then.filter("id = 2"), now.filter("id in (2, 4)"), "facts", 0)
    assert not moved.sync(then.filter("id = 2"), now.filter("id in (2, 4)"), "facts", 0)
    assert kept < set(moved.store.read("postings").inputFiles())
    fresh = fts.Index(Store(spark, str(tmp_path / "fresh")))
    fresh.rebuild(now, 4)
    for query in (fts.word("cache"), fts.word("old"), fts.any_of(fts.word("first"), fts.word("warm")), fts.phrase("cold cache"), fts.near(fts.word("the"), fts.word("call"), within=2)):
        assert [tuple(r) for r in moved.search(query, now).collect()] == [tuple(r) for r in fresh.search(query, now).collect()]
    # a fact that goes leaves nothing behind
    moved.sync(now.filter("id = 1"), now.filter("false"))
    assert 1 not in found(moved.search(fts.word("the"), now)) and moved._totals()[0] == 7


def test_only_texts_are_shuffled_into_postings(spark, store):
    """The texts of a block meet once; terms and places stay where they were cut, and what is written is not shuffled again."""
    table = facts(spark)
    made = fts._postings(table, fts.COLUMNS, 1)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    expected = {}
    for r in table.collect():
        words = [(w, k * fts._COLUMN + i) for k, text in enumerate((r["body"], r["source_quote"])) for i, w in enumerate(fts._words(text) if text else ())]
        for w, place in words:
            expected.setdefault((w, r["id"] // fts.BLOCK_IDS), {}).setdefault((r["id"], len(words)), []).append(place)
    rows = {(r["term"], r["block"]): dict(zip(zip(r["ids"], r["lengths"]), r["places"])) for r in made.collect()}
    assert rows == expected
    change = store.begin()
    change.create("kept", spark.range(0, 1000, 1, 3), ["id"], 1, gather=False)
    change.commit()
    assert len(store.read("kept").inputFiles()) == 3 and store.read("kept").count() == 1000


# ---- ranks and mining ----------------------------------------------------------------------------------------------


def test_running_total_and_ranks(spark):
    table = spark.range(500).select("id", (F.col("id") % 7).alias("n"))
    order = ranks.spread(F.col("id"))
    listed = sorted(((r["o"], r["id"], r["n"]) for r in table.withColumn("o", order).collect()))
    total, expected = 0, {}
    for _, i, n in listed:
        total += n
        expected[i] = total
    assert {r["id"]: r["total"] for r in ranks.running_total(table, "n", order).collect()} == expected
    places = sorted(listed, key=lambda x: (-x[2], x[0]))
    assert {r["id"]: r["rank"] for r in ranks.ranked_by(table, "n", order).collect()} == {x[1]: k + 1 for k, x in enumerate(places)}


COMMENTS = "repo string, path string, change long, body string, hunk string, url string, author string, created_at string"


def comments(spark, *listed):
    return spark.createDataFrame([("r", p, c, b, "", u, "ann", f"2024-01-0{1 + c % 9}") for p, c, b, u in listed], COMMENTS)


def speaker():
    """A model to which the comment itself says what to reply; made here so that it travels to the workers by value."""

    def says(system, user):
        body = user.split("Comment:\n", 1)[1].rsplit("\n\nDiff:", 1)[0]
        kind, _, rest = body.partition("|")
        if kind == "boom":
            raise RuntimeError("no model")
        return rest if kind == "raw" else json.dumps({"kind": kind, "body": rest, "confidence": 2 if "sure" in rest else 0.5})

    return says


says = speaker()


def test_replies():
    assert mining.read_reply('```json\n{"kind": "quirk", "body": "b", "confidence": 0.4}\n```') == ("quirk", "b", 0.4, None)
    assert mining.read_reply('{"kind": "null"}') == (None, None, None, None) == mining.read_reply('{"kind": ""}')
    assert mining.read_reply('{"kind": "praise"}')[3] == "invalid kind: praise"
    assert mining.read_reply("[1]")[3].startswith("parse reply") and mining.read_reply("no")[3].startswith("parse reply")


def test_mining_merges_by_scrubbed_body(spark, store):
    first = comments(spark, ("a.go", 1, "quirk|Never sure.", "u1"), ("a.go", 1, "quirk|never sure", "u2"), ("a.go", 2, "null|x", "u3"), ("b.go", 2, "rationale|mail a.b@example.com", "u4"), ("c.go", 3, "quirk| ", "u5"), ("c.go", 3, "quirk|has no link", None))
    assert mining.mine(store, first, "s", 0, says, "t0", model="m", buckets=4)
    got = {(r["path"], r["kind"]): r for r in store.read("facts").collect()}
    assert set(got) == {("a.go", "quirk"), ("b.go", "rationale")}
    assert (got["a.go", "quirk"]["corroboration"], got["a.go", "quirk"]["confidence"], got["a.go", "quirk"]["body"]) == (2, 0.95, "Never sure.")
    assert got["b.go", "rationale"]["body"] == "mail [REDACTED_EMAIL]" and got["b.go", "rationale"]["source_quote"].endswith("a.b@example.com")
    told = {r["path"]: r for r in store.read("outcomes").collect()}
    assert (told["c.go"]["outcome"], told["c.go"]["n_facts"], told["c.go"]["n_failed"], told["c.go"]["categories"]) == ("mined", 0, 2, ["check_constraint_violation", "not_null_constraint"])
    # a known change is not asked about again, a new reference corroborates, a known one does not
    calls = store.read("replies").count()
    assert mining.mine(store, comments(spark, ("a.go", 2, "quirk|never sure", "u9"), ("a.go", 4, "quirk|@joe never sure", "u6"), ("a.go", 4, "quirk|never sure!", "u1")), "s", 1, says, "t1", buckets=4)
    assert store.read("replies").count() == calls + 2
    fact = store.read("facts").filter("path = 'a.go'").first()
    assert (fact["corroboration"], fact["created_at"], fact["last_verified"]) == (3, "t0", "t1")
    assert rows(store.read("seen").filter("path = 'a.go'"), "change") == [(1,), (2,), (4,)]


def test_outcomes_of_files(spark, store):
    batch = comments(spark, ("ok.go", 5, "quirk|fine", "u1"), ("bad.go", 5, "quirk|lost", "u2"), ("bad.go", 5, "praise|nice", "u3"), ("raw.go", 5, "raw|{", "u4"), ("boom.go", 5, "boom|", "u5"))
    mining.mine(store, batch, "s", 0, says, "t0", buckets=2)
    outcome = lambda n: {r["path"]: r["outcome"] for r in store.read("outcomes").filter(f"batch = {n}").collect()}
    assert outcome(0) == {"ok.go": "mined", "bad.go": "extraction_failed", "raw.go": "extraction_failed", "boom.go": "extraction_failed"}
    assert rows(store.read("facts"), "path") == [("ok.go",)] and rows(store.read("seen"), "path") == [("ok.go",)]
    # an older window marks the file; the next batch reads all of it anew
    mining.mine(store, comments(spark, ("ok.go", 3, "quirk|older", "u6")), "s", 1, says, "t1", buckets=2)
    assert outcome(1) == {"ok.go": "cursor_regression"} and rows(store.read("cursors"), "path", "miner_version") == [("ok.go", mining.NEEDS_REMINE)]
    mining.mine(store, comments(spark, ("ok.go", 3, "quirk|older", "u6"), ("ok.go", 4, "quirk|fine", "u1")), "s", 2, says, "t2", buckets=2)
    assert outcome(2) == {"ok.go": "mined"} and rows(store.read("cursors"), "miner_version") == [(mining.VERSION,)]
    assert rows(store.read("facts"), "body", "corroboration") == [("fine", 1), ("older", 1)] and rows(store.read("seen"), "change") == [(3,), (4,)]


def test_budget(spark, store):
    listed = [(f"f{k}.go", 1, "quirk|x", f"u{k}{n}") for k in range(6) for n in range(3)]
    mining.mine(store, comments(spark, *listed), "s", 0, says, "t0", budget=10, buckets=2)
    assert store.read("replies").count() == 9 and store.read("outcomes").filter("outcome = 'budget_exceeded'").count() == 3
    day = mining.attempts_per_day(store.read("outcomes"), F.lit("d")).first()
    assert (day["n_attempts"], day["n_mined"], day["n_over_budget"], day["n_failed"], day["n_facts"]) == (6, 3, 3, 0, 9)


def test_killed_between_tables(spark, store, monkeypatch):
    """Whatever is written before the commit is not seen, and the batch runs again as if nothing had happened."""
    batch = comments(spark, ("a.go", 1, "quirk|sure", "u1"))
    plain = mining._move_cursors

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(mining, "_move_cursors", killed)
    with pytest.raises(KeyboardInterrupt):
        mining.mine(store, batch, "s", 0, says, "t0", buckets=2)
    assert all(store.read(t).count() == 0 for t in mining.TABLES)
    monkeypatch.setattr(mining, "_move_cursors", plain)
    assert mining.mine(store, batch, "s", 0, says, "t0", buckets=2) and not mining.mine(store, batch, "s", 0, says, "t0", buckets=2)
    assert rows(store.read("facts"), "corroboration") == [(1,)] and store.read("evidence").count() == 1 and store.read("replies").count() == 1


def test_mining_stream(spark, store, tmp_path):
    comments(spark, ("a.go", 1, "quirk|sure", "u1")).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: mining.mine_stream(spark.readStream.schema(COMMENTS).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), says, lambda: "t", buckets=2).awaitTermination(120)
    run(), run()
    comments(spark, ("a.go", 2, "quirk|sure", "u2")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(store.read("facts"), "corroboration") == [(2,)]
