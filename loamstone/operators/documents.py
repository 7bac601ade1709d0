"""Kept documents with their revisions: saving, status, deletion, each one commit over both tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.sources.store import BUCKETS, Store

MAX_REVISIONS = 5
KEY = ["document_id"]


class Documents:
    """Tables ``documents`` (document_id, ...) and ``revisions`` (the same columns, revision_num) of a store, in buckets of the id."""

    def __init__(self, store: Store, schema: str, max_revisions: int = MAX_REVISIONS, buckets: int = BUCKETS):
        self.store, self.max_revisions = store, max_revisions
        change = store.begin()
        if not change.has("documents"):
            change.declare("documents", schema, KEY, buckets)
            change.declare("revisions", f"{schema}, revision_num long", KEY, buckets)
            change.commit()

    def save(self, docs: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Store documents, one row for each id; what was there becomes a revision, of which the last ones are kept.

        A document without id is an error. With a stream's name and batch number, a batch that comes again changes nothing."""
        change = self.store.begin()
        if stream is not None and change.done(stream, batch):
            return False
        if docs.filter("coalesce(cast(document_id as string), '') = ''").limit(1).count():
            raise ValueError("a document needs an id")
        if (twice := docs.groupBy(*KEY).count().filter("count > 1").first()) is not None:
            raise ValueError(f"document {twice['document_id']} is saved twice at once")
        keys = docs.select(*KEY)
        before = change.read("documents", change.touched("documents", keys)).join(keys, KEY, "left_semi")
        change.rewrite("revisions", keys, lambda rows: self._captured(rows, before))
        change.rewrite("documents", keys, lambda rows: rows.join(keys, KEY, "left_anti").unionByName(docs.select(rows.columns)))
        change.commit(stream, batch)
        return True

    def _captured(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        last = rows.groupBy(*KEY).agg(F.max("revision_num").alias("_last"))
        numbered = before.join(last, KEY, "left").withColumn("revision_num", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
        newest = Window.partitionBy(*KEY).orderBy(F.desc("revision_num"))  # a document has few revisions
        return rows.unionByName(numbered.select(rows.columns)).withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= self.max_revisions).drop("_age")

    def update_status(self, statuses: DataFrame) -> None:
        """Set the status of documents (document_id, status); one that is not there is an error, and then nothing changes."""
        change = self.store.begin()
        wanted = statuses.select(*KEY, F.col("status").alias("_status"))
        held = change.read("documents", change.touched("documents", wanted))
        if (lost := wanted.join(held, KEY, "left_anti").first()) is not None:
            raise LookupError(f"no document {lost['document_id']}")
        change.rewrite("documents", wanted, lambda rows: rows.join(wanted, KEY, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status").select(rows.columns))
        change.commit()

    def delete(self, gone: DataFrame) -> None:
        """Delete documents and their revisions."""
        change = self.store.begin()
        for table in ("documents", "revisions"):
            change.rewrite(table, gone.select(*KEY), lambda rows: rows.join(gone.select(*KEY), KEY, "left_anti"))
        change.commit()

    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def revisions(self) -> DataFrame:
        return self.store.read("revisions")
