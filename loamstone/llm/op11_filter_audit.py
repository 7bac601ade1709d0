"""Filter interaction audit: which filter of a chain removes what, for every order of the chain.

A relational word pipeline. Words are exploded and aggregated by (document, word), then by document, for totals and
distincts. The flags that need no words come from a second branch, aggregated to one row per document, and both meet in an
outer join. With the copies (the smallest id of each text) and the labels, each document has one of 32 combinations of
failed filters; one aggregation per part counts them in 32 conditional columns (and 32 more for each label). All orders
follow from those columns: a filter removes the combinations that hold it and none of the filters before it.

Documents are dealt by (id, hash of text) once, so both aggregations of the word branch stay in place, and a text's words
never leave its task. Equal rows are counted, not repeated, so a repeated id is no hot group. The smallest id of a text is found
among salted parts of its copies and joined by (text, part), so that the copies of one text are spread over tasks.

Defined cases: a null text is empty; a null id is never larger than another, so its row is no copy, and has no label; repeated
rows count each; rows of one id with different texts are rated each by its own text; of several label rows of one id the
greater value holds; a null lang is the part of the empty string; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COMBINATIONS = 1 << len(FILTERS)
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"
#: Parts that the copies of one text are dealt to.
SALTS = 256


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, and a key without nulls: the id and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return named.select("*", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"))


def word_counts(docs: DataFrame) -> DataFrame:
    """Per document key: its words and different words.

    An empty string, which is no word, stands for the document itself: it counts the document's rows, and keeps documents without words."""
    cut = F.split("text", "[\\x20\\x09-\\x0D]+", -1)
    words = _keyed(docs).select("k1", "k2", "text").repartition("k1", "k2").select("k1", "k2", F.explode(F.concat(F.array(F.lit("")), F.filter(cut, lambda w: w != ""))).alias("word"))
    per_word = words.groupBy("k1", "k2", "word").agg(F.count(F.lit(1)).alias("times"))
    is_word = F.col("word") != ""
    rows = F.sum(F.when(~is_word, F.col("times")))
    return per_word.groupBy("k1", "k2").agg((F.coalesce(F.sum(F.when(is_word, F.col("times"))), F.lit(0)) / rows).cast("long").alias("n_words"), F.count(F.when(is_word, 1)).alias("n_distinct"))


def flags(docs: DataFrame) -> DataFrame:
    """Per document key and part: its rows, the flags that need no words, and a digest of the text."""
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    row = _keyed(docs).select("doc_id", "part", "k1", "k2", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), (100 * upper > MAX_UPPER_PERCENT * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    return row.groupBy("doc_id", "part", "k1", "k2", "digest", "c", "d").agg(F.count(F.lit(1)).alias("rows"))


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document key and part: how many rows, which of the 32 combinations, and the labels."""
    marked = flags(docs)
    marked = marked.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int"))
    first = marked.groupBy("digest", "salt").agg(F.min("doc_id").alias("least")).select("digest", "salt", F.min("least").over(Window.partitionBy("digest")).alias("first_id"))
    judged = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = marked.join(word_counts(docs), ["k1", "k2"], "full_outer").join(first, ["digest", "salt"], "left").join(judged, F.col("doc_id") == F.col("label_id"), "left")
    fails = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"), F.col("c"), F.col("d"), F.col("first_id") < F.col("doc_id")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return one.select("part", "rows", mask.alias("mask"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, with 32 conditional counts of all documents, of good ones and of toxic ones."""
    rows = combinations(docs, labels)
    some = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    each = [F.coalesce(F.sum(F.when((F.col("mask") == m) & c, F.col("rows"))), F.lit(0)).alias(f"{k}_{m}") for k, c in some.items() for m in range(COMBINATIONS)]
    return rows.groupBy("part").agg(*each)


def _sum(kind: str, wanted) -> Column:
    """The sum of the counts of combinations m for which ``wanted(m)``, a column, holds."""
    return F.aggregate(F.arrays_zip(F.sequence(F.lit(0), F.lit(COMBINATIONS - 1)).alias("m"), F.array(*[F.col(f"{kind}_{m}") for m in range(COMBINATIONS)]).alias("n")), F.lit(0).cast("long"), lambda s, x: s + F.when(wanted(x["m"]), x["n"]).otherwise(F.lit(0).cast("long")))


def _steps() -> list[tuple[str, int, int, int]]:
    """Every order and step: its filter as a bit, and the filters before it."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append((order, step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step."""
    literal = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in _steps()])
    at = counted(docs, labels).withColumn("at", F.explode(literal))
    bit, before = F.col("at.bit"), F.col("at.before")
    holds = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: holds(m) & (m.bitwiseAND(before) == 0)
    # in a share 1/k of all orders a filter is the first of the k that a combination fails
    orders = F.lit(len(_steps()) // len(FILTERS)).cast("long")
    shapley = sum((F.when(F.lit(m).bitwiseAND(bit) != 0, F.col(f"all_{m}") * (orders / m.bit_count()).cast("long")).otherwise(F.lit(0).cast("long")) for m in range(1, COMBINATIONS)), F.lit(0).cast("long"))
    return at.select(
        "part",
        "at.filter_order",
        "at.step",
        _sum("all", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        _sum("all", here).alias("removed"),
        _sum("all", lambda m: holds(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _sum("all", lambda m: m == bit).alias("unique_fails"),
        _sum("good", here).alias("good_lost"),
        _sum("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
