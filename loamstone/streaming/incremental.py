"""Claims kept in step with a stream of file changes, one commit per micro-batch, with the files that depend on a changed one.

Tables of the store, in buckets of their keys:

* ``files`` (repo, path): the last known state of each file, deleted ones included;
* ``claims`` (repo, path): what is extracted from them;
* ``importers`` (repo, imported): which file imports which name, the way back from a changed file to its dependants;
* ``runs`` (stream, batch): what each batch did.

A batch reads and rewrites the buckets of its own files and of their dependants. All tables change in one commit that also
names the batch, so a batch that comes again, after a crash or a replay, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamstone.functions import text as T
from loamstone.sources.code import CLAIMS, extract
from loamstone.sources.store import BUCKETS, Store
from loamstone.sources.tables import Conflict

FILES = "repo string, path string, content_hash string, extractor_version string, deleted boolean, text string"
IMPORTERS = "repo string, imported string, path string"
RUNS = "stream string, batch long, n_changed long, n_dependants long, n_extracted long, n_cached long, n_skipped long, n_deleted long, n_claims long"
#: What is extracted changes with it, so that files of an older version are read again when a batch reaches them.
VERSION = "2"
RETRIES = 3


def import_names(path: Column) -> Column:
    """The names by which other files may import a file: its folder, its path without ending, and that with dots."""
    bare = F.regexp_replace(path, r"\.[A-Za-z]+\z", "")
    return F.array_distinct(F.filter(F.array(T.folder_of(path), bare, F.replace(bare, F.lit("/"), F.lit("."))), lambda n: n != ""))


def last_states(changes: DataFrame) -> DataFrame:
    """Of each file of (repo, path, status, text, ord) the last state."""
    last = changes.groupBy("repo", "path").agg(F.max(F.struct("ord", "status", "text")).alias("l"))
    return last.select("repo", "path", (F.col("l.status") == "D").alias("deleted"), F.col("l.text").alias("text"))


def _start(store: Store, buckets: int) -> None:
    change = store.begin()
    if change.has("files"):
        return
    change.declare("files", FILES, ["repo", "path"], buckets)
    change.declare("claims", "repo string, " + CLAIMS, ["repo", "path"], buckets)
    change.declare("importers", IMPORTERS, ["repo", "imported"], buckets)
    change.declare("runs", RUNS, ["stream", "batch"], 1)
    try:
        change.commit()
    except Conflict:  # another writer has started the store
        pass


def apply_batch(store: Store, changes: DataFrame, stream: str, batch: int, version: str = VERSION, buckets: int = BUCKETS) -> bool:
    """Take one batch in; false if it was taken in before. A writer that another one overtakes starts again from the newer version."""
    _start(store, buckets)
    for left in reversed(range(RETRIES)):
        change = store.begin()
        if change.done(stream, batch):
            return False
        try:
            _apply(change, changes, stream, batch, version)
            return True
        except Conflict:
            if not left:
                raise
    return False


def _apply(change, changes: DataFrame, stream: str, batch: int, version: str) -> None:
    key = ["repo", "path"]
    held_back: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        held_back.append(df.persist())
        return df

    last = kept(last_states(changes).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("skipped", T.generated_file(F.col("path")) & ~F.col("deleted")))
    try:
        live = last.filter("not skipped")
        # files that import a changed one, without the changed ones
        names = live.select("repo", F.explode(import_names(F.col("path"))).alias("imported")).distinct()
        importers = change.read("importers", change.touched("importers", names)).join(names, ["repo", "imported"], "left_semi")
        dependants = kept(importers.select(*key).distinct().join(last, key, "left_anti"))
        held = change.read("files", change.touched("files", live.select(*key).unionByName(dependants)))
        known = held.select(*key, F.col("content_hash").alias("old_hash"), F.col("extractor_version").alias("old_version"), F.col("deleted").alias("was_deleted"))
        # a file is read again where its text or the extractor's version is new
        changed = live.filter("not deleted").join(known, key, "left")
        stale = ~(F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.col("old_version").eqNullSafe(F.lit(version)) & F.coalesce(~F.col("was_deleted"), F.lit(False)))
        again = held.filter(~F.col("deleted") & ~F.col("extractor_version").eqNullSafe(F.lit(version))).join(dependants, key, "left_semi").select(*key, "text", "content_hash")
        todo = kept(changed.filter(stale).select(*key, "text", "content_hash").unionByName(again))
        gone = live.filter("deleted").select(*key)
        moved = kept(todo.select(*key).unionByName(gone))

        fresh = kept(extract(todo.select(*key, "text")))
        old_claims = change.read("claims", change.touched("claims", moved)).join(moved, key, "left_semi")
        imported = lambda claims: claims.filter("predicate = 'imports'").select("repo", F.col("object_text").alias("imported"), "path").distinct()
        links = kept(imported(old_claims).unionByName(imported(fresh)).select("repo", "imported").distinct())
        change.rewrite("importers", links, lambda rows: rows.join(moved, key, "left_anti").unionByName(imported(fresh)))
        change.rewrite("claims", moved, lambda rows: rows.join(moved, key, "left_anti").unionByName(fresh.select(rows.columns)))

        def states(rows: DataFrame) -> DataFrame:
            read = todo.select(*key, "content_hash", F.lit(version).alias("extractor_version"), F.lit(False).alias("deleted"), "text")
            marked = rows.join(gone, key, "left_semi").withColumn("deleted", F.lit(True)).withColumn("text", F.lit(None).cast("string"))
            return rows.join(moved, key, "left_anti").unionByName(read).unionByName(marked)

        change.rewrite("files", moved, states)
        n_live, n_gone, n_skipped = last.agg(F.count_if(F.expr("not deleted and not skipped")), F.count_if(F.expr("deleted")), F.count_if(F.expr("skipped"))).first()
        n_dependants, n_todo, n_claims = dependants.count(), todo.count(), fresh.count()
        row = (stream, batch, n_live, n_dependants, n_todo, n_live + n_dependants - n_todo, n_skipped, n_gone, n_claims)
        change.append("runs", changes.sparkSession.createDataFrame([row], RUNS))
        change.commit(stream, batch)
    finally:
        for df in held_back:
            df.unpersist()


def maintain(stream: DataFrame, store: Store, checkpoint: str, name: str = "files", version: str = VERSION, buckets: int = BUCKETS) -> StreamingQuery:
    """Run ``apply_batch`` on every micro-batch of (repo, path, status, text, ord) until the input is used up."""

    def step(batch: DataFrame, number: int) -> None:
        apply_batch(store, batch, name, number, version, buckets)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def full_load(files: DataFrame, ord_: int = 0) -> DataFrame:
    """Every (repo, path, text) file as an addition: the changes of a repository that is read for the first time."""
    return files.select("repo", "path", F.lit("A").alias("status"), "text", F.lit(ord_).cast("long").alias("ord"))
