"""A stored positional full-text index over facts, and BM25 search that reads the asked terms only.

The index is four tables of a ``Store``:

* ``postings``: per term and block of ``BLOCK_IDS`` ids one row with the ids, their lengths and the places of the term, and the
  greatest count and least length of the block, from which no score of the block can be higher than a bound;
* ``terms`` (term, df) and ``totals`` (n_docs, n_terms), whose rows add up;
* ``gone`` (id, before): postings of an id that are older than a commit count no more.

Terms lie in buckets by their first letters, so that words and prefixes read single buckets. ``sync`` adds postings of changed facts
as new rows and takes back the old ones' counts; ``rebuild`` starts anew. Queries are built from ``word``, ``prefix``, ``phrase``,
``near``, ``all_of``, ``any_of`` and ``but``, each of which may be limited to a column.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.operators.search import _ACCENTED, _PLAIN, B, K1, plain_word
from loamstone.sources.store import BUCKETS, Store

COLUMNS = ("body", "source_quote")
#: Ids of a block, letters that choose a term's bucket, and blocks that are scored first to learn what the others must reach.
BLOCK_IDS, LEAD, PROBE = 4096, 2, 4
#: Blocks, on average, whose texts one task cuts; its postings make a file in each bucket.
TASK_BLOCKS = 1
#: A place is the column's number times this plus the word's number, so that no phrase spans two columns.
_COLUMN = 1 << 40
_POSTINGS = "lead string, term string, block long, n int, top_tf int, least_length int, ids array<long>, lengths array<int>, places array<array<long>>, born long"


# ---- queries -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """Words in a row, the last one perhaps a prefix, perhaps in one column only. The unit that BM25 counts."""

    words: tuple[str, ...]
    is_prefix: bool = False
    column: str | None = None

    @property
    def exact(self) -> tuple[str, ...]:
        return self.words[:-1] if self.is_prefix else self.words

    @property
    def simple(self) -> bool:
        return len(self.words) == 1 and not self.is_prefix and self.column is None


@dataclass(frozen=True)
class Node:
    """``kind`` is all, any, but or near; ``within`` is the distance of near."""

    kind: str
    parts: tuple
    within: int = 0


Query = Leaf | Node


def _words(text: str) -> tuple[str, ...]:
    found = tuple(w for w in re.split(r"[\W_]+", plain_word(text)) if w)
    if not found:
        raise ValueError(f"no word in {text!r}")
    return found


def word(text: str, column: str | None = None) -> Leaf:
    """A word; several words in one string are a phrase."""
    return Leaf(_words(text), False, column)


phrase = word


def prefix(text: str, column: str | None = None) -> Leaf:
    """A word, or a phrase, whose last word starts like this."""
    return Leaf(_words(text), True, column)


def near(*phrases: Leaf, within: int = 10) -> Node:
    """All phrases in one column, with at most ``within`` words between the end of any of them and the begin of the last."""
    if len(phrases) < 2:
        raise ValueError("near takes two phrases or more")
    return Node("near", phrases, within)


def all_of(*queries: Query) -> Query:
    return queries[0] if len(queries) == 1 else Node("all", queries)


def any_of(*queries: Query) -> Query:
    return queries[0] if len(queries) == 1 else Node("any", queries)


def but(query: Query, *none_of: Query) -> Node:
    return Node("but", (query, any_of(*none_of)))


def leaves(query: Query) -> list[Leaf]:
    """The different leaves, in order."""
    found = [query] if isinstance(query, Leaf) else [x for part in query.parts for x in leaves(part)]
    return list(dict.fromkeys(found))


# ---- index ---------------------------------------------------------------------------------------------------------


def _cut(columns: tuple[str, ...]) -> Column:
    """The terms of a fact's columns with their places."""

    def placed(k: int, c: str) -> Column:
        text = F.translate(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), _ACCENTED, _PLAIN)
        words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
        return F.transform(words, lambda t, i: F.struct(t.alias("term"), (F.lit(k * _COLUMN).cast("long") + i).alias("place")))

    return F.concat(*[placed(k, c) for k, c in enumerate(columns)])


def _term_places(facts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, block, length, term, places) of all terms of the facts' columns. Each fact is cut inside its row: nothing is shuffled."""
    n = F.size("all")
    last_of_term = lambda i: ~F.get("all", i)["term"].eqNullSafe(F.get("all", i + 1)["term"])
    ends = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), last_of_term)).otherwise(F.array().cast("array<int>"))
    rows = facts.select("id", "block", F.sort_array(_cut(columns)).alias("all")).withColumn("ends", ends)

    def one(end: Column, k: Column) -> Column:
        places = F.transform(F.sequence(F.coalesce(F.get("ends", k - 1) + 1, F.lit(0)), end), lambda i: F.get("all", i)["place"])
        return F.struct(F.get("all", end)["term"].alias("term"), places.alias("places"))

    return rows.select("id", "block", n.alias("length"), F.explode(F.transform("ends", one)).alias("one")).select("id", "block", "length", "one.*")


def _lead(term: Column) -> Column:
    return F.substring(term, 1, LEAD)


def _postings(facts: DataFrame, columns: tuple[str, ...], born: int) -> DataFrame:
    """Rows of ``postings``. The texts of a block meet in one task before they are cut, so no term or place is shuffled."""
    tasks = max(facts.sparkSession.sparkContext.defaultParallelism, facts.select("id").count() // (TASK_BLOCKS * BLOCK_IDS))
    dealt = facts.select("id", *columns, F.floor(F.col("id") / BLOCK_IDS).alias("block")).repartition(tasks, "block")
    grouped = _term_places(dealt, columns).groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "length", "places"))).alias("all"))
    return grouped.select(
        _lead(F.col("term")).alias("lead"), "term", "block", F.size("all").alias("n"),
        F.array_max(F.transform("all", lambda x: F.size(x["places"]))).alias("top_tf"), F.array_min(F.col("all.length")).alias("least_length"),
        F.col("all.id").alias("ids"), F.col("all.length").alias("lengths"), F.col("all.places").alias("places"), F.lit(born).cast("long").alias("born"),
    )


def _counts(facts: DataFrame, columns: tuple[str, ...], sign: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``terms`` and of ``totals`` that facts add or take back."""
    cut = facts.select("id", _cut(columns).alias("all"))
    each = cut.select(F.explode(F.array_distinct("all.term")).alias("term"))
    terms = each.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df")).select(_lead(F.col("term")).alias("lead"), "term", "df")
    # facts without any term count too
    lengths = cut.groupBy("id").agg(F.sum(F.size("all")).alias("length"))
    totals = lengths.agg((F.count(F.lit(1)) * sign).alias("n_docs"), (F.coalesce(F.sum("length"), F.lit(0)) * sign).alias("n_terms")).select(F.lit(0).alias("part"), "n_docs", "n_terms")
    return terms, totals


class Index:
    """The index of a store's folder. Columns and names of tables are fixed when it is built."""

    def __init__(self, store: Store, columns: tuple[str, ...] = COLUMNS):
        self.store, self.columns = store, columns

    def rebuild(self, facts: DataFrame, buckets: int = BUCKETS) -> None:
        """Index these facts and nothing else, in one commit."""
        change = self.store.begin()
        change.create("postings", _postings(facts, self.columns, change.base + 1), ["lead"], buckets, gather=False)
        # the counts follow from the postings, so texts are cut into terms once
        written = change.read("postings")
        change.create("terms", written.groupBy("lead", "term").agg(F.sum("n").alias("df")), ["lead"], buckets)
        n_terms = written.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda t, p: t + F.size(p))), F.lit(0))).first()[0]
        row = (0, facts.select("id").distinct().count(), n_terms)
        change.create("totals", facts.sparkSession.createDataFrame([row], "part int, n_docs long, n_terms long"), ["part"], 1)
        change.declare("gone", "id long, before long", ["id"], buckets)
        change.commit()

    def sync(self, old: DataFrame, new: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Take back facts as they were indexed (``old``) and add them as they are (``new``); what did not change is not read.

        With a stream's name and batch number, a batch that comes again changes nothing."""
        change = self.store.begin()
        if stream is not None and change.done(stream, batch):
            return False
        for facts, sign in ((old, -1), (new, 1)):
            terms, totals = _counts(facts, self.columns, sign)
            change.append("terms", terms)
            change.append("totals", totals)
        change.append("gone", old.unionByName(new, allowMissingColumns=True).select("id", F.lit(change.base + 1).alias("before")).distinct())
        change.append("postings", _postings(new, self.columns, change.base + 1), gather=False)
        change.commit(stream, batch)
        return True

    def postings(self, query: Query) -> DataFrame:
        """The rows of the terms that a query asks for; only their buckets are listed."""
        return self._of_terms("postings", leaves(query))

    def _of_terms(self, table: str, wanted: list[Leaf]) -> DataFrame:
        exact = sorted({w for leaf in wanted for w in leaf.exact})
        starts = sorted({leaf.words[-1] for leaf in wanted if leaf.is_prefix})
        buckets = None
        if all(len(s) >= LEAD for s in starts):
            leads = self.store.spark.createDataFrame([(w[:LEAD],) for w in exact + starts], "lead string")
            buckets = sorted(r[0] for r in leads.select(self.store.bucket(table, F.col("lead"))).distinct().collect())
        asked = [F.col("term").isin(*exact)] if exact else []
        return self.store.read(table, buckets).filter(reduce(lambda a, b: a | b, asked + [F.col("term").startswith(s) for s in starts]))

    def _occurrences(self, postings: DataFrame) -> DataFrame:
        """(id, length, term, places) of what still counts."""
        zipped = F.arrays_zip("ids", "lengths", "places")
        rows = postings.select("term", "born", F.explode(zipped).alias("x")).select("term", "born", F.col("x.ids").alias("id"), F.col("x.lengths").alias("length"), F.col("x.places").alias("places"))
        gone = self.store.read("gone").groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(gone, "id", "left").filter("before is null or born >= before").drop("before", "born")

    def _totals(self) -> tuple[int, float]:
        n, terms = self.store.read("totals").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        return n or 0, (terms or 0) / max(n or 0, 1)

    def search(self, query: Query, facts: DataFrame, limit: int = 10, status: str = "active", kind: str | None = None, repos: DataFrame | None = None) -> DataFrame:
        """(id, kind, score) of the best facts by BM25, and repo where ``repos`` (subject_id, repo) is given. Statistics are of all indexed facts; filters apply after.

        ``facts`` gives id, kind, status and subject_id; its texts are not read."""
        wanted = [F.col("status") == status] + ([F.col("kind") == kind] if kind else [])
        allowed = facts.select("id", "kind", "status", *(["subject_id"] if repos is not None else [])).filter(reduce(lambda a, b: a & b, wanted))
        n_docs, average = self._totals()
        if all(leaf.simple for leaf in leaves(query)):
            weights = self._weights(query, n_docs)
            scored = self._best_blocks(query, weights, average, allowed, limit)
        else:
            rows = _by_fact(self._occurrences(self.postings(query)), query, self.columns)
            weights = _leaf_weights(rows, query, n_docs)
            scored = _scored(rows, query, weights, average)
        found = scored.join(allowed, "id")
        if repos is not None:
            found = found.join(repos.select("subject_id", "repo"), "subject_id", "left")
        return found.select("id", "kind", F.round("score", 6).alias("score"), *(["repo"] if repos is not None else [])).orderBy(F.desc("score"), "id").limit(limit)

    def _weights(self, query: Query, n_docs: int) -> list[float]:
        """The weights of words, from the table of counts; a row for each word comes to the driver."""
        wanted = leaves(query)
        df = {r[0]: r[1] for r in self._of_terms("terms", wanted).groupBy("term").agg(F.sum("df")).collect()}
        return [_idf(n_docs, df.get(leaf.words[0], 0)) for leaf in wanted]

    def blocks(self, query: Query, weights: list[float], average: float) -> DataFrame:
        """(block, bound): blocks that hold the words which a query of words needs, and a score that no fact of the block exceeds.

        Only the small columns of the postings are read."""
        wanted = leaves(query)
        heads = self.postings(query).groupBy("block").agg(
            *[F.max(F.when(F.col("term") == leaf.words[0], F.col("top_tf"))).alias(f"tf{k}") for k, leaf in enumerate(wanted)],
            *[F.min(F.when(F.col("term") == leaf.words[0], F.col("least_length"))).alias(f"dl{k}") for k, leaf in enumerate(wanted)],
        )
        there = {leaf: F.col(f"tf{k}").isNotNull() for k, leaf in enumerate(wanted)}
        most = [F.coalesce(_part(weights[k], F.col(f"tf{k}"), F.col(f"dl{k}"), average), F.lit(0.0)) for k in range(len(wanted))]
        return heads.filter(_possible(query, there)).select("block", reduce(lambda a, b: a + b, most).alias("bound"))

    def _best_blocks(self, query: Query, weights: list[float], average: float, allowed: DataFrame, limit: int) -> DataFrame:
        """Scores of the blocks that can hold one of the best: those with the highest bounds are scored first, and tell what the others must reach."""
        blocks = self.blocks(query, weights, average)
        postings = self.postings(query)

        def scored(some: DataFrame) -> DataFrame:
            return _scored(_by_fact(self._occurrences(some), query, self.columns), query, weights, average)

        first = [r[0] for r in blocks.orderBy(F.desc("bound"), "block").limit(PROBE).collect()]
        if not first:
            return scored(postings.filter(F.lit(False)))
        best = scored(postings.filter(F.col("block").isin(*first))).join(allowed, "id", "left_semi").select(F.round("score", 6).alias("score"))
        held = [r[0] for r in best.orderBy(F.desc("score")).limit(limit).collect()]
        least = held[-1] if len(held) == limit else -math.inf
        return scored(postings.join(blocks.filter(F.round("bound", 6) >= least).select("block"), "block", "left_semi"))


# ---- scores --------------------------------------------------------------------------------------------------------


def _idf(n_docs: int, df: int) -> float:
    weight = math.log((n_docs - df + 0.5) / (df + 0.5))
    return weight if weight > 0 else 1e-6


def _part(weight: float | Column, tf: Column, length: Column, average: float) -> Column:
    return F.lit(weight) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _possible(query: Query, there: dict[Leaf, Column]) -> Column:
    """Whether a block may hold a match; what must not stand in a fact may stand in its block."""
    if isinstance(query, Leaf):
        return there[query]
    if query.kind == "but":
        return _possible(query.parts[0], there)
    parts = [_possible(p, there) for p in query.parts]
    return reduce((lambda a, b: a | b) if query.kind == "any" else (lambda a, b: a & b), parts)


def _by_fact(rows: DataFrame, query: Query, columns: tuple[str, ...]) -> DataFrame:
    """(id, length, s0, s1, ...): where each leaf begins in each fact that holds one of the asked words."""
    wanted = leaves(query)
    exact = sorted({w for leaf in wanted for w in leaf.exact})
    starts = sorted({leaf.words[-1] for leaf in wanted if leaf.is_prefix})
    term = F.col("term")
    some = [F.max(F.when(term == w, F.col("places"))).alias(f"w{k}") for k, w in enumerate(exact)]
    some += [F.array_sort(F.flatten(F.collect_list(F.when(term.startswith(s), F.col("places"))))).alias(f"p{k}") for k, s in enumerate(starts)]
    facts = rows.groupBy("id").agg(F.max("length").alias("length"), *some)
    empty = F.array().cast("array<long>")
    places = {(w, False): F.coalesce(f"w{k}", empty) for k, w in enumerate(exact)} | {(s, True): F.col(f"p{k}") for k, s in enumerate(starts)}

    def begins(leaf: Leaf) -> Column:
        each = [places[w, leaf.is_prefix and k == len(leaf.words) - 1] for k, w in enumerate(leaf.words)]
        found = each[0]
        for k, other in enumerate(each[1:], 1):
            found = F.array_intersect(found, _moved(other, k))
        if leaf.column is not None:
            low = columns.index(leaf.column) * _COLUMN
            found = F.filter(found, lambda p: (p >= low) & (p < low + _COLUMN))
        return found

    return facts.select("id", "length", *[begins(leaf).alias(f"s{k}") for k, leaf in enumerate(wanted)])


def _leaf_weights(rows: DataFrame, query: Query, n_docs: int) -> list[float]:
    """Weights of phrases, prefixes and words of a column, by the facts that hold them; one row comes to the driver."""
    n = len(leaves(query))
    df = rows.agg(*[F.count_if(F.size(f"s{k}") > 0) for k in range(n)]).first()
    return [_idf(n_docs, x) for x in df]


@dataclass
class _Told:
    """Whether a part of a query matches, and how often each of its leaves stands there if it does."""

    match: Column
    counts: dict[int, Column] = field(default_factory=dict)


def _tell(query: Query, number: dict[Leaf, int]) -> _Told:
    if isinstance(query, Leaf):
        n = F.size(f"s{number[query]}")
        return _Told(n > 0, {number[query]: n})
    if query.kind == "near":
        return _tell_near(query, number)
    told = [_tell(p, number) for p in query.parts]
    if query.kind == "but":
        return _Told(told[0].match & ~told[1].match, told[0].counts)
    match = reduce((lambda a, b: a | b) if query.kind == "any" else (lambda a, b: a & b), [t.match for t in told])
    counts: dict[int, Column] = {}
    for t in told:
        for k, n in t.counts.items():
            n = F.when(t.match, n).otherwise(0)
            counts[k] = F.greatest(counts[k], n) if k in counts else n
    return _Told(match, counts)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _within(lasts: Column, begins: Column, reach: int) -> Column:
    """The last begins that a begin precedes by at most ``reach``."""
    return F.filter(lasts, lambda m: F.exists(begins, lambda x: (x <= m) & (x >= m - reach)))


def _reaching(begins: Column, lasts: Column, reach: int) -> Column:
    return F.filter(begins, lambda x: F.exists(lasts, lambda m: (x <= m) & (x >= m - reach)))


def _tell_near(query: Node, number: dict[Leaf, int]) -> _Told:
    """A group has a last begin m, and each phrase begins in [m - its words - within, m]. Begins that are in no group do not count."""
    begins = [F.col(f"s{number[p]}") for p in query.parts]
    reach = [len(p.words) + query.within for p in query.parts]
    lasts = reduce(F.array_union, begins)
    for s, r in zip(begins, reach):
        lasts = _within(lasts, s, r)
    counts: dict[int, Column] = {}
    for p, s, r in zip(query.parts, begins, reach):
        n = F.size(_reaching(s, lasts, r))
        k = number[p]
        counts[k] = F.greatest(counts[k], n) if k in counts else n
    return _Told(F.size(lasts) > 0, counts)


def _scored(rows: DataFrame, query: Query, weights: list[float], average: float) -> DataFrame:
    """(id, score) of the facts that match."""
    number = {leaf: k for k, leaf in enumerate(leaves(query))}
    told = _tell(query, number)
    counted = rows.filter(told.match).select("id", "length", *[n.alias(f"n{k}") for k, n in sorted(told.counts.items())])
    parts = [F.when(F.col(f"n{k}") > 0, _part(weights[k], F.col(f"n{k}"), F.col("length"), average)).otherwise(F.lit(0.0)) for k in sorted(told.counts)]
    return counted.select("id", reduce(lambda a, b: a + b, parts).alias("score"))
