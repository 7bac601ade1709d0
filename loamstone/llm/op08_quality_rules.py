"""Quality rules as a short-circuit cascade.

Each rule has a measured cost (seconds per byte on a sample) and selectivity (share of the sample that it rejects).
Rules run in descending order of rejections per cost, and a rule looks only at texts that no earlier rule rejected.
The order decides how much work is done, never the verdict: a text is kept if and only if every rule passes.

Defined cases: a null or empty text has no words, so ``too_few_words`` rejects it; repeated rows get equal results;
an empty table gives an empty result; extra columns are passed by ``apply`` and ignored by ``score``; a null id stays null.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

#: Different rows of the sample on which cost and selectivity are estimated; only their hashes are sorted, so no task gathers texts for it.
SAMPLE_ROWS = 400
#: Thresholds of the rules beyond the two base rules. Clean prose stays far below each of them.
MAX_SYMBOLS_PER_100_WORDS = 20
MAX_DUP_LINE_PERCENT = 60
MIN_MEAN_WORD_CHARS, MAX_MEAN_WORD_CHARS = 1.5, 25.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Measures:
    """Counts of a run of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self._words: tn.Words | None = None
        self._lines: tuple[np.ndarray, np.ndarray] | None = None

    def take(self, alive: np.ndarray) -> Measures:
        """The same texts without those that are not alive."""
        if alive.all():
            return self
        sizes = np.diff(self.off)
        keep = np.repeat(alive, sizes)
        return Measures(self.buf[keep], np.r_[0, np.cumsum(sizes[alive])])

    @property
    def words(self) -> tn.Words:
        if self._words is None:
            self._words = tn.Words(self.buf, self.off)
        return self._words

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][self.off])

    def n_words(self) -> np.ndarray:
        return self.words.count.astype(np.int64)

    def word_chars(self) -> np.ndarray:
        return self._sum(self.words.word & ((self.buf & 0xC0) != 0x80))

    def n_symbols(self) -> np.ndarray:
        return self._sum(_SYMBOL[self.buf])

    def n_lines(self) -> np.ndarray:
        return self.lines[0]

    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        if self._lines is None:
            self._lines = self._count_lines()
        return self._lines

    def _count_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: lines with a word, and those of them that are equal to an earlier line."""
        ends = np.flatnonzero(self.buf == 10)
        full = self.off[:-1] < self.off[1:]
        start = np.union1d(self.off[:-1][full], ends + 1)
        start = start[start < len(self.buf)]
        stop = np.r_[start[1:], len(self.buf)]
        stop = stop - (self.buf[stop - 1] == 10)  # without the line's own end
        has = np.r_[0, np.cumsum(self.words.word, dtype=np.int64)]
        worded = has[stop] > has[start]
        start, stop = start[worded], stop[worded]
        text = np.searchsorted(self.off, start, side="right") - 1
        n = len(self.off) - 1
        total = np.bincount(text, minlength=n)
        if not len(start):
            return total, total
        h = tn.span_hashes(self.buf, start, stop)
        order = np.lexsort((h, text))
        again = np.r_[False, (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])]
        return total, np.bincount(text[order], weights=again, minlength=n).astype(np.int64)

    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        n_texts = len(w.count)
        if not len(w.start):
            return np.zeros(n_texts, np.int64)
        own = w.owners()
        place = np.arange(len(own))
        valid = place + 2 < w.first[own + 1]
        h, text = tn.window_hashes(w.hashes(False), 3)[valid], own[valid]
        order = np.lexsort((h, text))
        same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.r_[same, False] | np.r_[False, same] if len(order) else np.zeros(0, bool)
        at = place[valid][order][twice]
        covered = np.zeros(len(own), dtype=bool)
        for k in range(3):
            covered[at + k] = True
        return np.bincount(own, weights=covered, minlength=n_texts).astype(np.int64)


class Cascade:
    """A run of texts of which rules reject some. A measure is computed once per text, for the texts alive when a rule first asks for it."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self._whole = self._left = Measures(buf, off)
        self._n = len(off) - 1
        self.alive = np.arange(self._n)
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # the texts it is known of, and values

    def __call__(self, name: str) -> np.ndarray:
        """A measure of the texts alive."""
        if name not in self._known:
            values = np.zeros(self._n, dtype=np.int64)
            values[self.alive] = getattr(self._left, name)()
            self._known[name] = self.alive, values
        return self._known[name][1][self.alive]

    def reject(self, out: np.ndarray) -> None:
        self.alive, self._left = self.alive[~out], self._left.take(~out)

    def whole(self, names: list[str]) -> list[np.ndarray]:
        """Measures of all texts; what the cascade knows is not computed again."""
        others: dict[int, tuple[np.ndarray, Measures]] = {}  # texts alive at one time are among those alive before, so their number tells which
        out = []
        for name in names:
            at, values = self._known.get(name, (np.arange(0), np.zeros(self._n, dtype=np.int64)))
            if len(at) < self._n:
                if len(at) not in others:
                    rest = np.ones(self._n, dtype=bool)
                    rest[at] = False
                    others[len(at)] = rest, self._whole.take(rest)
                rest, measures = others[len(at)]
                values[rest] = getattr(measures, name)()
            out.append(values)
        return out


def _too_few_words(m: Cascade) -> np.ndarray:
    return m("n_words") < 50


def _repetitive(m: Cascade) -> np.ndarray:
    return 100 * m("n_repeat_words") > 50 * m("n_words")


def _symbols(m: Cascade) -> np.ndarray:
    return 100 * m("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * m("n_words")


def _dup_lines(m: Cascade) -> np.ndarray:
    return 100 * m("n_dup_lines") > MAX_DUP_LINE_PERCENT * m("n_lines")


def _word_length(m: Cascade) -> np.ndarray:
    chars, words = m("word_chars"), m("n_words")
    return (chars < MIN_MEAN_WORD_CHARS * words) | (chars > MAX_MEAN_WORD_CHARS * words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Cascade], np.ndarray]
    base: bool = False


RULES = (Rule("too_few_words", _too_few_words, True), Rule("repetitive", _repetitive, True), Rule("symbols", _symbols), Rule("dup_lines", _dup_lines), Rule("word_length", _word_length))


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds_per_mb: float
    rejected: float

    @property
    def per_cost(self) -> float:
        return self.rejected / max(self.seconds_per_mb, 1e-9)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on the ``sample_rows`` rows of smallest hash, repeats once, best rule first."""
    keyed = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    highest = keyed.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    rows = keyed.filter(F.col("h") <= F.lit(highest)).dropDuplicates(["h"]).select("text").toArrow()
    buf, off = tn.text_bytes(rows.column("text"))
    found = []
    for rule in rules:
        began, rejected = time.perf_counter(), 0
        for a, b in tn.slices(off):
            rejected += int(rule.rejects(Cascade(buf[off[a] : off[b]], off[a : b + 1] - off[a])).sum())
        found.append(Estimate(rule.name, (time.perf_counter() - began) / max(len(buf) / 1e6, 1e-3), rejected / max(len(off) - 1, 1)))
    return sorted(found, key=lambda e: (-e.per_cost, e.name))


def _judge(m: Cascade, order: list[Rule]) -> np.ndarray:
    """Index of the rule that rejects each text, or -1; each rule sees the texts still alive."""
    by = np.full(len(m.alive), -1)
    for k, rule in enumerate(order):
        if not len(m.alive):
            break
        out = rule.rejects(m)
        by[m.alive[out]] = k
        m.reject(out)
    return by


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(order: list[Rule], detail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tn.text_bytes(batch.column(batch.num_columns - 1))
            for a, b in tn.slices(off):
                m = Cascade(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                by = _judge(m, order)
                part = batch.slice(a, b - a)
                if not detail:
                    part = part.filter(pa.array(by < 0))
                    if part.num_rows:
                        yield part
                    continue
                found = m.whole(_NAMES)
                failed = (found[0] < 50) | (100 * found[4] > 50 * found[0])
                names = [order[k].name if k >= 0 else None for k in by]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (*found, failed, by < 0)), pa.array(names, pa.string())], ["doc_id", *_NAMES, "base_failed", "kept", "rejected_by"])

    return run


def _ordered(docs: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[e.name] for e in estimate(docs, rules)]


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: all measures, the verdict, and the first rule of the cascade that rejected it."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return narrow.mapInArrow(_measured(_ordered(docs, rules), True), schema)


def apply(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that every rule keeps, columns unchanged; measures of rejected texts are not computed."""
    columns = docs.columns
    moved = docs.select(*[F.col(f"`{c}`") for c in columns if c != "text"], "text")
    return moved.mapInArrow(_measured(_ordered(docs, rules), False), moved.schema).select(*[F.col(f"`{c}`") for c in columns])
