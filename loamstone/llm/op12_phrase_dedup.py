"""Substring deduplication by repeated-phrase automata.

A window is ``SIZE`` consecutive words. Every word that a window covers is removed if the window's words also stand at an
earlier place (smaller id, or the same document further left). Three steps over documents dealt into shards:

1. **Recurring phrases.** In each window the ``PHRASE``-word phrase of the smallest hash is its *anchor*, a function of the
   window's words alone. Anchors are counted over all shards; windows whose anchor stands in one place only are unique.
2. **Automata.** Consecutive windows of one recurring anchor form a *region*, whose words go to the automaton shard that the
   anchor's hash names. There, windows that recur are confirmed and compiled into an Aho-Corasick automaton over word
   numbers; all regions of the shard stream through it, which locates every occurrence. An occurrence that is not the earliest
   of its phrase is reported. A match compares words, not hashes.
3. **Removal.** The reported runs go back to their documents.

What keeps shards small: equal regions of a document shard are sent once, the later ones are reported at once; an anchor with
more than ``HOT`` places sends single windows, dealt by their own hash, so neither a passage that all documents share nor
boilerplate that begins many different passages gathers in one place. The documents are shuffled once, and that exchange is
read by all three steps.

Defined cases: a null text is empty; a text of fewer words than a window loses nothing; a null id comes before all others;
rows of one id with different texts are different documents, in the order of their texts' ``xxhash64``; rows that are equal
in id and text are one document, and each gets its result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn

#: Words of a window and of an anchor phrase.
SIZE, PHRASE = 20, 8
#: Bytes of text in a shard of documents, and automaton shards for each of them.
SHARD_BYTES, AUTOMATA_PER_SHARD = 4 << 20, 2
#: An anchor with more places sends its windows one by one.
HOT = 5_000

U = np.uint64
_NULL_ID = -(1 << 63)


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of ``width`` consecutive values, starting at each; shorter at the end."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.r_[best(out[:-step], out[step:]), out[-step:]] if len(out) > step else out
        reach += step
    return out


class Windows:
    """All windows of a run of texts: the word each starts at, its anchor, and the places of anchors."""

    def __init__(self, words: tn.Words, size: int, phrase: int):
        n = len(words.start)
        own = words.owners()
        self.hashes = words.hashes(False)
        phrases = tn.window_hashes(self.hashes, phrase)
        whole = np.arange(n) + size <= words.first[own + 1]
        least = np.where(whole, _slide(phrases, size - phrase + 1, np.minimum), U(0))
        self.start = np.flatnonzero(whole)
        self.anchor = least[self.start]
        self.own = own
        # a phrase is an anchor if some window over it has no smaller one
        most = _slide(least[::-1], size - phrase + 1, np.maximum)[::-1]
        self.anchor_places = phrases[(most == phrases) & (most > 0)]


def _batch(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _runs(table: pa.Table) -> Iterator[tuple[int, int, tn.Words]]:
    raw, offsets = tn.text_bytes(_batch(table, "text"))
    for a, b in tn.slices(offsets):
        yield a, b, tn.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count_anchors(size: int, phrase: int):
    def run(table: pa.Table) -> pa.Table:
        found = [Windows(words, size, phrase).anchor_places for _, _, words in _runs(table)]
        anchors, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"shard": pa.array(np.full(len(anchors), table["shard"][0].as_py()), pa.int32()), "anchor": pa.array(anchors.view(np.int64)), "places": pa.array(n.astype(np.int64))})

    return run


def _single_spaced(words: tn.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with one space between two words of a text, and where each word starts and ends in them."""
    after = np.r_[False, words.word[:-1]] & ~words.word
    keep = words.word | after
    data = words.buf[keep]
    data[after[keep]] = 0x20
    place = np.cumsum(keep)
    return data, place[words.start] - 1, place[words.end - 1]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``data``, which may overlap."""
    size = end - start
    off = np.r_[0, np.cumsum(size)]
    body = data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(body)])


def _later(code: np.ndarray, d: np.ndarray, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (d, h, start) with a code: one earliest place of each code, and the places that are later than the earliest."""
    order = np.lexsort((start, h, d, code))
    c, d, h, start = code[order], d[order], h[order], start[order]
    new = np.r_[True, c[1:] != c[:-1]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d != d[head]) | (h != h[head]) | (start != start[head])
    return order[new], order[later]


_REGION = "bucket int, d long, h long, start int, windows int, words string"


def _regions(size: int, phrase: int, buckets: int):
    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        want = _batch(wanted, "anchor").to_numpy(zero_copy_only=False).view(U)
        order = np.argsort(want)
        want, hot = want[order], _batch(wanted, "hot").to_numpy(zero_copy_only=False)[order]
        doc, doc_hash = (_batch(table, c).to_numpy(zero_copy_only=False) for c in ("d", "h"))
        kept: list[tuple] = []
        for a, _, words in _runs(table) if len(want) else ():
            all_ = Windows(words, size, phrase)
            at = np.minimum(np.searchsorted(want, all_.anchor), len(want) - 1)
            hit = want[at] == all_.anchor
            start, anchor, single = all_.start[hit], all_.anchor[hit], hot[at[hit]]
            if not len(start):
                continue
            first = np.r_[True, (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | single[1:] | (all_.own[start[1:]] != all_.own[start[:-1]])]
            head = np.flatnonzero(first)
            last = np.r_[head[1:], len(start)] - 1
            begin, end = start[head], start[last]
            key = np.where(single[head], tn.window_hashes(all_.hashes, size)[begin], anchor[head])
            data, word_start, word_end = _single_spaced(words)
            own = all_.own[begin]
            kept.append((key, doc[a + own], doc_hash[a + own], begin - words.first[own], end - begin + 1, _strings(data, word_start[begin], word_end[end + size - 1])))
        if not kept:
            return pa.table({"bucket": pa.array([], pa.int32()), "d": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "start": pa.array([], pa.int32()), "windows": pa.array([], pa.int32()), "words": pa.array([], pa.string())})
        key, d, h, start, n = (np.concatenate([k[i] for k in kept]) for i in range(5))
        texts = pa.chunked_array([k[5] for k in kept])
        code = texts.combine_chunks().dictionary_encode() if len(kept) > 1 else kept[0][5].dictionary_encode()
        one, later = _later(code.indices.to_numpy(zero_copy_only=False), d, h, start)
        # equal regions are sent once; the later ones are spread by their own place
        bucket = np.r_[tn.mix(key[one]), tn.mix(h[later].view(U) ^ tn.mix(d[later].view(U) + start[later].astype(U)))] % U(buckets)
        rows = np.r_[one, later]
        sent = pa.concat_arrays([code.dictionary.take(code.indices.take(pa.array(one))).cast(pa.string()), pa.nulls(len(later), pa.string())])
        return pa.table({"bucket": pa.array(bucket.astype(np.int32)), "d": pa.array(d[rows]), "h": pa.array(h[rows]), "start": pa.array(start[rows].astype(np.int32)), "windows": pa.array(n[rows].astype(np.int32)), "words": sent})

    return run


def compile_phrases(numbers: np.ndarray, starts: np.ndarray, size: int) -> ahocorasick.Automaton:
    """An automaton over word numbers that reports which of the phrases, each of ``size`` words from a start on, ends at a place."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    listed = numbers.tolist()
    for k, s in enumerate(starts.tolist()):
        automaton.add_word(tuple(listed[s : s + size]), k)
    automaton.make_automaton()
    return automaton


def _locate(size: int):
    def run(table: pa.Table) -> pa.Table:
        texts = _batch(table, "words")
        told = texts.is_null().to_numpy(zero_copy_only=False)
        d, h, start, windows = (_batch(table, c).to_numpy(zero_copy_only=False) for c in ("d", "h", "start", "windows"))
        found = [(d[told], h[told], start[told].astype(np.int64), windows[told].astype(np.int64))]
        rows = np.flatnonzero(~told)
        if len(rows):
            found.append(_occurrences(texts.take(pa.array(rows)), d[rows], h[rows], start[rows].astype(np.int64), size))
        d, h, start, windows = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pa.table({"d": pa.array(d), "h": pa.array(h), "start": pa.array(start.astype(np.int32)), "windows": pa.array(windows.astype(np.int32))})

    return run


def _occurrences(texts: pa.Array, d: np.ndarray, h: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that also stand at an earlier place among the regions given."""
    lists = pc.split_pattern(texts, " ")
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    first = np.r_[0, np.cumsum(n + 1)]  # a zero after each region, which no phrase holds
    numbers = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.cumsum(n), 0)
    region = np.repeat(np.arange(len(n)), n + 1)
    at = np.flatnonzero(np.arange(len(numbers)) + size < first[region + 1])
    one, two = (tn.window_hashes(tn.mix(numbers.astype(U) * U(odd)), size)[at] for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    head = np.flatnonzero(new)
    phrases = at[order[head[np.diff(np.r_[head, len(order)]) > 1]]]
    if not len(phrases):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    automaton = compile_phrases(numbers, phrases, size)
    matches = np.fromiter((x for match in automaton.iter(tuple(numbers.tolist())) for x in match), dtype=np.int64).reshape(-1, 2)
    begin, phrase = matches[:, 0] - size + 1, matches[:, 1]
    own = region[begin]
    _, later = _later(phrase, d[own], h[own], start[own] + begin - first[own])
    begin = np.sort(begin[later])
    own = region[begin]
    starts = np.flatnonzero(np.r_[True, (begin[1:] != begin[:-1] + 1) | (own[1:] != own[:-1])]) if len(begin) else np.zeros(0, np.int64)
    run = np.diff(np.r_[starts, len(begin)])
    own, begin = own[starts], begin[starts]
    return d[own], h[own], start[own] + begin - first[own], run


def _remove(size: int):
    def run(table: pa.Table, runs: pa.Table) -> pa.Table:
        doc, doc_hash = (_batch(table, c).to_numpy(zero_copy_only=False) for c in ("d", "h"))
        rows_of: dict[tuple[int, int], list[int]] = {}
        for row, key in enumerate(zip(doc.tolist(), doc_hash.tolist())):
            rows_of.setdefault(key, []).append(row)
        d, h, start, windows = (_batch(runs, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "h", "start", "windows"))
        hits = [(row, k) for k, key in enumerate(zip(d.tolist(), h.tolist())) for row in rows_of[key]]
        row, k = np.array(hits, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(row, kind="stable")
        row, k = row[order], k[order]
        n_words, n_removed, texts = [], [], []
        for a, b, words in _runs(table):
            lo, hi = np.searchsorted(row, (a, b))
            covers = np.zeros(len(words.start) + 1, np.int64)
            begin = words.first[row[lo:hi] - a] + start[k[lo:hi]]
            np.add.at(covers, begin, 1)
            np.add.at(covers, begin + windows[k[lo:hi]] + size - 1, -1)
            keep = np.cumsum(covers[:-1]) == 0
            total = np.r_[0, np.cumsum(keep)][words.first]
            left = np.diff(total)
            word_size = (words.end - words.start)[keep] + 1
            off = np.r_[0, np.cumsum(word_size)]
            data = np.r_[words.buf, np.uint8(0x20)][np.repeat(words.start[keep] - off[:-1], word_size) + np.arange(off[-1])]
            data[off[1:] - 1] = 0x20
            body = data.tobytes()
            n_words.append(words.count.astype(np.int64))
            n_removed.append(words.count - left)
            texts += [body[off[x] : max(off[y] - 1, off[x])] for x, y in zip(total[:-1].tolist(), total[1:].tolist())]
        digests = [hashlib.sha256(t).hexdigest() for t in texts]
        return pa.table({"doc_id": _batch(table, "doc_id"), "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(texts, pa.binary())})

    return run


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("d", "h"), F.lit(shards)).cast("int").alias("shard")


def _sharded(docs: DataFrame, shards: int) -> DataFrame:
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).cast("long")).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = named.select("*", F.xxhash64("text").alias("h"))
    return keyed.select(_shard(shards), "doc_id", "d", "h", "text").repartition(shards, "shard")


def _later_runs(sharded: DataFrame, shards: int, size: int, phrase: int, hot: int) -> DataFrame:
    anchors = sharded.groupBy("shard").applyInArrow(_count_anchors(size, phrase), "shard int, anchor long, places long")
    total = F.sum("places").over(Window.partitionBy("anchor"))
    wanted = anchors.withColumn("total", total).filter("total > 1").select("shard", "anchor", (F.col("total") > hot).alias("hot"))
    regions = sharded.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_regions(size, phrase, shards * AUTOMATA_PER_SHARD), _REGION)
    return regions.groupBy("bucket").applyInArrow(_locate(size), "d long, h long, start int, windows int")


def deduplicate(docs: DataFrame, size: int = SIZE, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and ``kept``, the words that stay, joined by one space."""
    if not 0 < phrase <= size:
        raise ValueError("a phrase has at least one word and at most a window's")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sharded = _sharded(docs, shards)
    runs = _later_runs(sharded, shards, size, phrase, hot).select("*", _shard(shards))
    key = docs.schema["doc_id"].dataType.simpleString()
    out = sharded.groupBy("shard").cogroup(runs.groupBy("shard")).applyInArrow(_remove(size), f"doc_id {key}, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def later_passages(docs: DataFrame, size: int = SIZE, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, start, n_words): maximal stretches of words that windows found at an earlier place cover, counted in words."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sharded = _sharded(docs, shards)
    runs = _later_runs(sharded, shards, size, phrase, hot).distinct()
    by_doc = Window.partitionBy("d", "h").orderBy("start")
    end = F.col("start") + F.col("windows") + size - 1
    reach = F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(reach >= F.col("start"), 0).otherwise(1)).over(by_doc)
    merged = runs.select("*", end.alias("end"), stretch.alias("stretch")).groupBy("d", "h", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id"), F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))


def report(docs: DataFrame, **settings) -> DataFrame:
    return deduplicate(docs, **settings).drop("kept")
