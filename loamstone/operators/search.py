"""Full-text search over facts: an inverted index as a DataFrame, and BM25 ranking of words, prefixes and phrases."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Plain letters for accented ones, in order.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def index(facts: DataFrame, columns: tuple[str, ...] = ("body", "source_quote")) -> DataFrame:
    """(id, dl, term, tf): how often each term stands in a fact's columns together, and how many terms they have."""
    terms = facts.select("id", _terms(columns).alias("terms"))
    return terms.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def _terms(columns: tuple[str, ...] = ("body", "source_quote")) -> Column:
    text = F.translate(F.lower(F.concat_ws(" ", *columns)), _ACCENTED, _PLAIN)
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def plain_word(word: str) -> str:
    return word.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def _phrase_count(terms: Column, phrase: str) -> Column:
    """How often the words of a phrase stand in a row; terms are letters and digits only, so they can be joined by spaces."""
    words = " ".join(w for w in re.split(r"[\W_]+", plain_word(phrase)) if w)
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(f"(?= {words} )"))


def search(
    facts: DataFrame,
    terms: list[str],
    limit: int = 10,
    status: str = "active",
    kind: str | None = None,
    prefixes: tuple[str, ...] = (),
    phrases: tuple[str, ...] = (),
    any_of: tuple[str, ...] = (),
    none_of: tuple[str, ...] = (),
    repos: DataFrame | None = None,
) -> DataFrame:
    """The best facts that hold all terms, a word with each prefix, all phrases, one of ``any_of`` if given, and none of ``none_of``, by BM25.

    Statistics are of all facts; filters apply after. Each fact is counted for the asked terms inside its row, so that nothing is shuffled but
    one row of totals. ``repos`` (subject_id, repo) adds the repository of each fact's subject.
    """
    wanted = {plain_word(t): (lambda a, t=t: F.size(F.filter(a, lambda x: x == plain_word(t)))) for t in terms}
    wanted |= {plain_word(p) + "*": (lambda a, p=p: F.size(F.filter(a, lambda x: x.startswith(plain_word(p)) & ~x.isin(*[plain_word(t) for t in terms] or [""])))) for p in prefixes}
    wanted |= {f'"{plain_word(p)}"': (lambda a, p=p: _phrase_count(a, p)) for p in phrases}
    optional = {plain_word(t): (lambda a, t=t: F.size(F.filter(a, lambda x: x == plain_word(t)))) for t in any_of}
    if not wanted and not optional:
        raise ValueError("empty query")
    labels = sorted(wanted | optional)
    subject = F.col("subject_id") if repos is not None else F.lit(None)

    def counted(a: Column) -> Column:
        banned = F.arrays_overlap(a, F.array(*[F.lit(plain_word(t)) for t in none_of])) if none_of else F.lit(False)
        return F.struct(F.size(a).alias("dl"), F.coalesce(banned, F.lit(False)).alias("banned"), *[(wanted | optional)[n](a).alias(f"t{k}") for k, n in enumerate(labels)])

    # the terms of a fact are cut out once, and no filter is pushed below that
    rows = facts.select("id", "kind", "status", subject.alias("subject_id"), F.inline(F.transform(F.array(_terms()), counted)))
    tf = [F.col(f"t{k}") for k in range(len(labels))]
    totals = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"), *[F.sum((c > 0).cast("long")).alias(f"df{k}") for k, c in enumerate(tf)])
    held = reduce(lambda a, b: a & b, [tf[labels.index(n)] > 0 for n in wanted], F.lit(True))
    if optional:
        held = held & reduce(lambda a, b: a | b, [tf[labels.index(n)] > 0 for n in optional])
    hits = rows.filter(held & ~F.col("banned") & (F.col("status") == status))
    if kind:
        hits = hits.filter(F.col("kind") == kind)
    one = hits.join(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for k, c in enumerate(tf):
        idf = F.log((F.col("n_docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        part = F.when(idf <= 0, 1e-6).otherwise(idf) * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        score = score + F.when(c > 0, part).otherwise(F.lit(0.0))
    found = one.select("id", "kind", "subject_id", F.round(score, 6).alias("score"))
    if repos is not None:
        found = found.join(repos.select("subject_id", "repo"), "subject_id", "left")
    return found.orderBy(F.desc("score"), "id").limit(limit).drop("subject_id")
