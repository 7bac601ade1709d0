"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's window is a set of placed words that a document must contain whole, so by the prefix principle with full containment
one necessary word suffices: its rarest. Words are ordered by how often they occur in the documents (all of them are counted),
the rarest word of each window is looked up in the documents, and each hit fixes where the window would have to start. The
length bound (the window must end inside the document) and the positional bound (it must start inside) are applied, and the
window's words are then compared one by one.

Few windows are broadcast. Many are joined by shuffled rows of one word each, without texts; only the passages in which a window
may start, cut from each text with an overlap, meet their candidates for the comparison, so what is shuffled grows with the
words of the documents and with the places that pass both bounds, not with the square of a document's length.

Defined cases: a null or empty text has no words and is hit by nothing; an item without words has no window; repeated rows get
equal results, one each; equal items all count; an empty benchmark leaves every document clean; extra columns pass through
``apply``; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words of a window.
WINDOW = 10
#: Windows that may be broadcast (about 200 bytes each); beyond, the join is shuffled by word.
BROADCAST_WINDOWS = 200_000
#: Starts of windows in a passage, the unit in which texts are compared beyond that bound.
PASSAGE_WORDS = 1_000
#: Contaminated texts that may be broadcast (16 bytes each); beyond, documents are shuffled.
BROADCAST_TEXTS = 1_000_000

#: Characters that are no part of a word: ASCII without digits and small letters.
_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, _BREAKS), lambda w: w != "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window): every run of ``size`` words of an item; an item of fewer words, but not none, is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(size)))).alias("window"))


def _hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Per row of ``docs``: key, hash, n_words and hit spans (start, end, item_id); a row without spans is kept once."""
    windows = windows_of(benchmark, size).distinct()
    n_windows = windows.count()
    small = n_windows <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    worded = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"), words_of(F.col("text")).alias("w"))
    known = windows.select(F.explode("window").alias("word")).distinct()
    words = worded.select(F.explode("w").alias("word"))
    if small:
        counts = words.join(hint(known), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:  # counted before they are dealt out by word
        counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(known, "word", "left_semi")
    # the rarest word of each window and its place in it; a word that no document has can't be hit, nor its window
    placed = windows.select("item_id", "window", F.posexplode("window").alias("at", "word")).join(hint(counts), "word", "left")
    rarest = placed.groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("at"))).alias("r")).filter("r.n > 0")
    # windows of equal words are compared once; items are attached after
    necessary = rarest.groupBy("window").agg(F.first("r").alias("r"), F.array_sort(F.collect_set("item_id")).alias("items"))
    table = necessary.select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "window", "items")
    if not small:
        return _shuffled_hits(worded, table, size)
    # one more row, of a word that no text can hold, gives every document its own row
    own = docs.sparkSession.sql("select ' ' as word, 0 as at").select("word", "at", F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast(table.schema["items"].dataType).alias("items"))
    each = worded.select("doc_id", "h", "w", F.posexplode(F.concat("w", F.array(F.lit(" ")))).alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.size("window") <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
    joined = each.join(F.broadcast(table.unionByName(own)), "word").filter(F.col("window").isNull() | (inside & same))
    return joined.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), F.when(F.col("window").isNotNull(), start).alias("start"), (start + F.size("window")).alias("end"), "items")


def _shuffled_hits(worded: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """The rows of ``_hits`` for windows that are too many to be broadcast."""
    n_words = F.size("w").cast("long").alias("n_words")
    items = table.schema["items"].dataType
    own = worded.select("doc_id", "h", n_words, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast(items).alias("items"))
    each = worded.select("doc_id", "h", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    found = each.join(table, "word").filter((start >= 0) & (start + F.size("window") <= F.col("size")))
    found = found.select("doc_id", "h", F.floor(start / PASSAGE_WORDS).cast("int").alias("passage"), start.alias("start"), "window", "items")
    cut = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PASSAGE_WORDS).cast("int"))
    passages = worded.filter(F.size("w") > 0).select("doc_id", "h", n_words, F.explode(F.transform(cut, lambda c: F.struct(c.alias("passage"), F.slice("w", c * PASSAGE_WORDS + 1, F.lit(PASSAGE_WORDS + size - 1)).alias("part")))).alias("p"))
    passages = passages.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n_words", F.col("p.passage").alias("_passage"), F.col("p.part").alias("part"))
    on = found["doc_id"].eqNullSafe(passages["_id"]) & (found["h"] == passages["_h"]) & (found["passage"] == passages["_passage"])
    same = F.slice("part", F.col("start") - F.col("passage") * PASSAGE_WORDS + 1, F.size("window")) == F.col("window")
    hits = found.join(passages, on).filter(same)
    return own.unionByName(hits.select("doc_id", "h", "n_words", "start", (F.col("start") + F.size("window")).alias("end"), "items"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = _hits(docs, benchmark, size)
    rows = spans.filter("start is null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    hits = spans.filter("start is not null").select("doc_id", "h", "start", "end", "items")
    # repeated rows report each span several times; a span counts once
    once = hits.groupBy("doc_id", "h", "start", "end").agg(F.max("items").alias("items"))
    before = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = once.withColumn("upto", F.max("end").over(before)).withColumn("fresh", F.greatest(F.col("end") - F.greatest("start", F.coalesce("upto", F.col("start"))), F.lit(0)))
    per = covered.groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    on = rows["doc_id"].eqNullSafe(per["doc_id"]) & rows["h"].eqNullSafe(per["h"])
    joined = rows.join(per, on, "left").select(rows["doc_id"], "n_words", "copies", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.col("found").cast("array<string>"), F.array().cast("array<string>")).alias("found"))
    out = joined.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("found"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def apply(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item; a text is dropped wherever it stands."""
    spans = _hits(docs, benchmark, size)
    bad = stored(spans.filter("start is not null").select(F.col("doc_id").alias("_bad_id"), F.col("h").alias("_bad_text")).distinct(), "contaminated")
    few = bad.count() <= BROADCAST_TEXTS
    on = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_bad_text"])
    return docs.join(F.broadcast(bad) if few else bad, on, "left_anti")
