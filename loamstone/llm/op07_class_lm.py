"""Language-model scores by a Brown class-based bigram model.

Words belong to classes by exchange clustering, in two steps. The ``HEAD`` most frequent words start from a frequency split, and each is
moved to the class that raises the likelihood of the class bigrams most, until sweeps change little. Every other word that
training holds ``MIN_COUNT`` times or more, however many there are, is then exchanged in parallel sweeps: the classes before and after
all its training occurrences give it the class of the greatest gain, with the class bigram counts held fixed within a sweep (the
gain is taken to first order, as one such word changes little in them). Words seen less often, and all words never seen, are
one more class of rare words, in which an unseen word weighs as much as the words seen once; the end token is a class of its own.

A text's log probability is the sum over its tokens of log10 P(class | class before) + log10 P(word | class), with the class
transition interpolated with the class frequency, and additive smoothing of the emission over the class's words.

Tokens are kept as numbers: every slice of documents becomes one row with its own dictionary. Dictionary entries, not tokens,
are dealt by hash to count each word over all training documents; each brings the classes of its neighbours, two bytes an
occurrence up to ``DENSE`` of them and counts by class beyond, and a count and a class go back to the slice. So what moves grows
with the corpus, a frequent word costs a bounded entry per slice, and no task or driver holds the vocabulary. The driver fits the classes of the head from at most the square of ``HEAD + 1``
numbers; a sweep brings it the square of ``CLASSES`` numbers twice. The head is chosen by the counts of each slice's own ``TOPS``
most frequent words; all its words are counted over everything like any other.

Defined cases: a null or empty text is its end token alone; repeated rows count as documents; a null doc_id is not held out; an empty table
gives an empty result; extra columns are ignored. Without any training token, N is 0 and V is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import discard, stored

#: Words that the driver exchanges one by one, and the words of a slice among which they are looked for.
HEAD, TOPS = 768, 1536
#: Classes of words, the last of which is the end token's; rare words are one class more.
CLASSES = 48
END_CLASS, RARE, ALL_CLASSES = CLASSES - 1, CLASSES, CLASSES + 1
#: Training occurrences from which a word is exchanged.
MIN_COUNT = 5
#: Sweeps over the head, and over all other words.
SWEEPS, TAIL_SWEEPS = 6, 3
#: Additive smoothing of word counts, the weight of class frequencies in a transition, and of a class bigram in a sweep.
ADD, BACK, FLOOR = 0.1, 50.0, 0.5
#: Every tenth text by crc32 of the id is held out.
FOLDS = 10
#: Bytes of text per slice.
SLICE = 4_000_000
#: Dictionary entries per bucket of the counting step, and words whose profiles are spread out at a time.
BUCKET_ENTRIES, PROFILES = 1_000_000, 20_000
#: A word that occurs more often in a slice is sent with counts of its neighbours' classes instead of the neighbours.
DENSE = 192
#: Marks of words and neighbours without a class yet.
OPEN = 255

#: The end token's hash.
END = np.uint64(0xE0D0E0D0E0D0E0FF)


@dataclass(frozen=True)
class Head:
    """The words with a class of their own finding, by hash, and their classes."""

    words: np.ndarray
    of: np.ndarray

    def classes(self, words: np.ndarray) -> np.ndarray:
        """Class of each word; ``OPEN`` for the others, and the end token's."""
        out = np.full(len(words), OPEN, dtype=np.uint8)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.of[at], out).astype(np.uint8)
        out[words == END] = END_CLASS
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice: its documents, their token sequences, and a dictionary with training counts."""
    names = ["slice", "doc_ids", "held", "sizes", "tokens", "words", "counts"]
    for batch in batches:
        buf, off = tn.text_bytes(batch.column(1))
        for a, b in tn.slices(off, SLICE):
            part = batch.slice(a, b - a)
            w = tn.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            ids = np.insert(w.hashes(True), w.first[1:], END)
            sizes = (w.count + 1).astype(np.uint32)
            words, tokens = np.unique(ids, return_inverse=True)
            held = np.array([c is not None and c % FOLDS == 0 for c in tn.crc32_of_ids(part.column(0).to_pylist())], dtype=bool)
            counts = np.bincount(tokens, weights=np.repeat(~held, sizes), minlength=len(words)).astype(np.uint32)
            kind = np.uint16 if len(words) < 65536 else np.uint32
            blobs = [held.tobytes(), sizes.tobytes(), tokens.astype(kind).tobytes(), words.tobytes(), counts.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *[pa.array([x], pa.binary()) for x in blobs]], names)


def _array(scalar: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), dtype=kind)


def _tokens(scalar: pa.Scalar, n_words: int) -> np.ndarray:
    return _array(scalar, np.uint16 if n_words < 65536 else np.uint32)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words of each slice."""
    for batch in batches:
        for k in range(batch.num_rows):
            words, counts = _array(batch.column(0)[k], np.uint64), _array(batch.column(1)[k], np.uint32)
            counts = np.where(words == END, 0, counts)
            top = np.lexsort((words, -counts.astype(np.int64)))[:TOPS]
            top = top[counts[top] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(words[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], ["word", "n"])


def _pairs(words_sent):
    """Bigram counts of head words and the end token over the training documents of a task; a document starts after an end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(words_sent.value, np.arange(len(words_sent.value)))
        n = len(head.words) + 1
        counts = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                words = _array(batch.column(3)[k], np.uint64)
                at = np.minimum(np.searchsorted(head.words, words), max(n - 2, 0))
                item = np.where(head.words[at] == words, at, -1) if n > 1 else np.full(len(words), -1)
                item[words == END] = n - 1
                seq = item[_tokens(batch.column(2)[k], len(words))]
                trained = np.repeat(~_array(batch.column(0)[k], bool), _array(batch.column(1)[k], np.uint32))
                before = np.r_[n - 1, seq[:-1]]  # the token before a document's first is the end of another
                both = trained & (seq >= 0) & (before >= 0)
                counts += np.bincount((before * n + seq)[both], minlength=n * n)
        pairs = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(counts[pairs])], ["pair", "n"])

    return run


def _deal(buckets: int, head_sent, dense: int):
    """A slice's dictionary by bucket: words, training counts, and the classes around each training occurrence of open words.

    Of a word with more than ``dense`` occurrences go the counts of the classes before and after it, so that no word sends more than those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = head_sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                name, held, sizes, tokens, words, counts = (batch.column(c)[k] for c in range(6))
                words, counts = _array(words, np.uint64), _array(counts, np.uint32)
                tokens = _tokens(tokens, len(words))
                of = head.classes(words)
                seq = of[tokens]
                # every document ends with the end token, so only words have a token after them to look at
                left, right = np.r_[np.uint8(END_CLASS), seq[:-1]], np.r_[seq[1:], np.uint8(END_CLASS)]
                told = np.flatnonzero(np.repeat(~_array(held, bool), _array(sizes, np.uint32)) & (seq == OPEN))
                told = told[np.argsort(tokens[told], kind="stable")]
                left, right = left[told], right[told]
                often = np.flatnonzero((of == OPEN) & (counts > dense))
                packed = (counts > dense)[tokens[told]]
                own = np.searchsorted(often, tokens[told][packed])
                summed = np.concatenate([_class_counts(own, x[packed], len(often)) for x in (left, right)], axis=1).astype(np.uint32)
                left, right = left[~packed], right[~packed]
                begins = np.r_[0, np.cumsum(np.where((of == OPEN) & (counts <= dense), counts, 0), dtype=np.int64)]
                # a dictionary is sorted, so ranges of the hash are runs of it
                bucket = np.minimum((words >> np.uint64(32)) // np.uint64(max(1, (1 << 32) // buckets)), np.uint64(buckets - 1))
                present, begin = np.unique(bucket, return_index=True)
                spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(words)]))
                blobs = [[x[lo:hi].tobytes() for lo, hi in spans] for x in (words, counts)] + [[x[begins[lo] : begins[hi]].tobytes() for lo, hi in spans] for x in (left, right)]
                blobs.append([summed[slice(*np.searchsorted(often, span))].tobytes() for span in spans])
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(spans)), pa.array(present.astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], ["slice", "bucket", "words", "counts", "left", "right", "dense"])

    return run


_DEALT = "slice string, bucket int, words binary, counts binary, left binary, right binary, dense binary"
_COUNTED = "bucket int, slices array<string>, sizes binary, place binary, totals binary, fixed binary, times binary, left binary, right binary, often binary, dense binary"
#: What ``_profiles`` reads.
_AROUND = ("times", "left", "right", "often", "dense")


def _class_counts(own: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """How often each class stands near each of ``n`` words; neighbours without a class do not count."""
    known = near != OPEN
    return np.bincount(own[known] * CLASSES + near[known], minlength=n * CLASSES).reshape(n, CLASSES)


def _count(head_sent, dense: int):
    def count(table: pa.Table) -> pa.Table:
        """Total training counts of a bucket's words, the classes of those that are not exchanged, and the neighbours of the others.

        ``place`` says which word each entry of each slice is; ``times`` has, of every word to be exchanged, the occurrences that came with
        their neighbours, and ``often`` names those words that came with counts, too, whose sums are ``dense``.
        """
        head: Head = head_sent.value
        words = [_array(x, np.uint64) for x in table.column("words")]
        flat, counts = np.concatenate(words), np.concatenate([_array(x, np.uint32) for x in table.column("counts")])
        seen, place = np.unique(flat, return_inverse=True)
        totals = np.bincount(place, weights=counts, minlength=len(seen)).astype(np.int64)
        fixed = head.classes(seen)
        is_open = fixed == OPEN
        fixed[is_open & (totals < MIN_COUNT)] = RARE
        single = np.where(is_open[place] & (counts <= dense), counts, 0)
        owner = np.repeat(place, single)
        order = np.argsort(owner, kind="stable")
        order = order[fixed[owner[order]] == OPEN]
        left, right = (np.concatenate([_array(x, np.uint8) for x in table.column(c)])[order] for c in ("left", "right"))
        exchanged = np.cumsum(fixed == OPEN) - 1
        packed = place[is_open[place] & (counts > dense)]
        kept = fixed[packed] == OPEN
        often, which = np.unique(exchanged[packed[kept]], return_inverse=True)
        sums = np.zeros((len(often), 2 * CLASSES), dtype=np.int64)
        np.add.at(sums, which, np.concatenate([_array(x, np.uint32) for x in table.column("dense")]).reshape(-1, 2 * CLASSES)[kept].astype(np.int64))
        row = {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "slices": pa.array([table.column("slice").to_pylist()], pa.list_(pa.string())),
            "sizes": np.array([len(w) for w in words], dtype=np.int64),
            "place": place.astype(np.uint32),
            "totals": totals,
            "fixed": fixed,
            "times": np.bincount(place, weights=single, minlength=len(seen)).astype(np.int64)[fixed == OPEN],
            "left": left,
            "right": right,
            "often": often.astype(np.uint32),
            "dense": sums,
        }
        return pa.table({c: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else v for c, v in row.items()})

    return count


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item; ``pairs`` is the matrix of item bigram counts. The last item keeps a class of its own."""
    n = len(pairs)
    freq = pairs.sum(axis=1) + pairs.sum(axis=0)
    of = np.zeros(n, dtype=np.int64)
    of[np.argsort(-freq, kind="stable")] = np.arange(n) % (classes - 1)
    of[n - 1] = classes - 1
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    left, right = pairs @ member, pairs.T @ member  # item to class, class to item
    grid = member.T @ left  # class to class
    order = np.argsort(-freq, kind="stable")
    order = order[(order != n - 1) & (freq[order] > 0)]
    for _ in range(sweeps):
        moved = 0
        for i in order:
            own, self_ = of[i], pairs[i, i]
            out, into = left[i].copy(), right[i].copy()  # to and from classes, with itself in its own class
            out[own] -= self_
            into[own] -= self_
            base = grid.copy()
            base[own] -= out
            base[:, own] -= into
            base[own, own] -= self_
            rows, cols = base.sum(axis=1), base.sum(axis=0)
            # gain of joining class c: changes in row c, column c, their crossing, and the marginals
            gain = _entropy(base + out[None, :]).sum(axis=1) - _entropy(base).sum(axis=1) + _entropy(base + into[:, None]).sum(axis=0) - _entropy(base).sum(axis=0)
            d = np.diag(base)
            gain += _entropy(d + out + into + self_) + _entropy(d) - _entropy(d + out) - _entropy(d + into)
            gain -= _entropy(rows + out.sum() + self_ + into) - _entropy(rows) + _entropy(cols + into.sum() + self_ + out) - _entropy(cols)
            # rows and columns of other classes gain what points at or from the item, wherever it goes: equal for all but c itself
            gain += _entropy(rows + into) - _entropy(rows) + _entropy(cols + out) - _entropy(cols)
            gain[classes - 1] = -np.inf
            best = int(np.argmax(gain))
            if best != own and gain[best] > gain[own] + 1e-9:
                moved += 1
                left[:, own] -= pairs[:, i]
                left[:, best] += pairs[:, i]
                right[:, own] -= pairs[i]
                right[:, best] += pairs[i]
                of[i] = best
            base[of[i]] += out
            base[:, of[i]] += into
            base[of[i], of[i]] += self_
            grid = base
        if moved <= len(order) // 100:
            break
    return of


def grid_of(pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Class bigram counts of the head."""
    member = np.zeros((len(pairs), CLASSES))
    member[np.arange(len(pairs)), of] = 1
    return member.T @ pairs @ member


def joined_classes(out: np.ndarray, into: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of the greatest gain for words with these counts of classes after and before; without any, the class of rare words."""
    smooth = grid + FLOOR
    follows, precedes = np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(smooth / smooth.sum(axis=0, keepdims=True))
    gain = out @ follows.T + into @ precedes
    gain[:, END_CLASS] = -np.inf
    return np.where(out.sum(axis=1) + into.sum(axis=1) > 0, np.argmax(gain, axis=1), RARE).astype(np.uint8)


def _profiles(row: dict[str, pa.Scalar]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of the classes after and before each word to be exchanged, some words at a time."""
    times, left, right = _array(row["times"], np.int64), _array(row["left"], np.uint8), _array(row["right"], np.uint8)
    often, dense = _array(row["often"], np.uint32).astype(np.int64), _array(row["dense"], np.int64).reshape(-1, 2 * CLASSES)
    ends = np.r_[0, np.cumsum(times)]
    for a in range(0, len(times), PROFILES):
        n = times[a : a + PROFILES]
        own = np.repeat(np.arange(len(n)), n)
        here = slice(*np.searchsorted(often, (a, a + len(n))))
        sides = []
        for around, counted in ((right, dense[:, CLASSES:]), (left, dense[:, :CLASSES])):
            side = _class_counts(own, around[ends[a] : ends[a + len(n)]], len(n))
            side[often[here] - a] += counted[here]
            sides.append(side.astype(np.float64))
        yield sides[0], sides[1]


def _classes(row: dict[str, pa.Scalar], grid: np.ndarray) -> np.ndarray:
    """The class of every word of a bucket."""
    of = _array(row["fixed"], np.uint8).copy()
    found = [joined_classes(out, into, grid) for out, into in _profiles(row)]
    of[of == OPEN] = np.concatenate(found) if found else np.empty(0, np.uint8)
    return of


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k] for c in batch.schema.names}


def _sweep(grid_sent):
    """What the exchanged words of each bucket add to the class bigrams: rows of a cell's number and a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = grid_sent.value
        for row in _rows(batches):
            added = np.zeros((ALL_CLASSES, 2 * CLASSES))
            for out, into in _profiles(row):
                member = np.zeros((len(out), ALL_CLASSES))
                member[np.arange(len(out)), joined_classes(out, into, grid)] = 1
                added += np.c_[member.T @ out, member.T @ into]
            cells = np.flatnonzero(added)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(added.ravel()[cells].astype(np.int64))], ["cell", "n"])

    return run


def _facts(grid_sent):
    """Per class: its training tokens, its words seen in training, and those of them seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            of, totals = _classes(row, grid_sent.value), _array(row["totals"], np.int64)
            sums = [np.bincount(of, weights=x, minlength=ALL_CLASSES) for x in (totals, totals > 0, totals == 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * ALL_CLASSES, dtype=np.int32)), pa.array(np.concatenate(sums).astype(np.int64))], ["cell", "n"])

    return run


def _back(grid_sent):
    """Counts and classes of a bucket's words, for each slice that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            of, totals, place = _classes(row, grid_sent.value), _array(row["totals"], np.int64), _array(row["place"], np.uint32)
            totals = totals.astype(np.uint32) if totals.max(initial=0) < 1 << 32 else totals
            ends = np.cumsum(_array(row["sizes"], np.int64)).tolist()
            names, bucket = row["slices"].as_py(), row["bucket"].as_py()
            spans = list(zip([0, *ends], ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([bucket] * len(names), pa.int32()), pa.array([totals[place[a:b]].tobytes() for a, b in spans], pa.binary()), pa.array([of[place[a:b]].tobytes() for a, b in spans], pa.binary())],
                ["slice", "bucket", "totals", "classes"],
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's counts and classes, in the order of its dictionary."""
    for batch in batches:
        for k in range(batch.num_rows):
            parts = sorted(batch.column(4)[k].as_py(), key=lambda p: p["bucket"])
            of = np.concatenate([np.frombuffer(p["classes"], dtype=np.uint8) for p in parts])
            totals = np.concatenate([np.frombuffer(p["totals"], dtype=np.uint32 if len(p["totals"]) == 4 * len(p["classes"]) else np.int64).astype(np.int64) for p in parts])
            yield pa.RecordBatch.from_arrays([*[c.slice(k, 1) for c in batch.columns[:4]], pa.array([totals.tobytes()], pa.binary()), pa.array([of.tobytes()], pa.binary())], ["doc_ids", "held", "sizes", "tokens", "totals", "classes"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigram counts of the training documents of a task."""
    counts = np.zeros(ALL_CLASSES * ALL_CLASSES, dtype=np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            of = _array(batch.column(3)[k], np.uint8)
            seq = of[_tokens(batch.column(2)[k], len(of))].astype(np.int64)
            trained = np.repeat(~_array(batch.column(0)[k], bool), _array(batch.column(1)[k], np.uint32))
            counts += np.bincount((np.r_[END_CLASS, seq[:-1]] * ALL_CLASSES + seq)[trained], minlength=len(counts))
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["cell", "n"])


class Model:
    """log10 transitions between classes, and log10 of the emissions' denominators."""

    def __init__(self, grid: np.ndarray, tokens: np.ndarray, seen: np.ndarray, once: np.ndarray):
        """Class bigram counts; and per class its training tokens, different words, and words seen once."""
        self.n_tokens, self.n_words = int(tokens.sum()), int(seen.sum())
        share = (grid.sum(axis=0) + 1) / (grid.sum() + ALL_CLASSES)
        self.step = np.log10((grid + BACK * share[None, :]) / (grid.sum(axis=1, keepdims=True) + BACK))
        self.unseen = max(ADD, float(once.sum()))  # in the class of rare words
        mass = tokens + ADD * seen
        mass[RARE] += self.unseen
        self.denominator = np.log10(np.maximum(mass, ADD))

    def emissions(self, totals: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 P(word | class) for words with these training counts and classes."""
        return np.log10(np.where(totals > 0, totals + ADD, self.unseen)) - self.denominator[of]


def _score(model_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_sent.value
        base = np.log10(model.n_tokens + ADD * (model.n_words + 1))
        for batch in batches:
            for k in range(batch.num_rows):
                held, sizes, tokens, totals, of = (batch.column(c)[k] for c in range(1, 6))
                sizes, totals, of = _array(sizes, np.uint32).astype(np.int64), _array(totals, np.int64), _array(of, np.uint8)
                tokens = _tokens(tokens, len(of))
                seq = of[tokens]
                first = np.cumsum(sizes) - sizes
                class_part = model.step[np.r_[np.uint8(END_CLASS), seq[:-1]], seq] + model.emissions(totals, of)[tokens]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[k].values,
                        pa.array(_array(held, bool)),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((totals > 0)[tokens].astype(np.int64), first)),
                        pa.array(np.full(len(sizes), model.n_tokens)),
                        pa.array(np.add.reduceat(np.log10(totals + ADD)[tokens], first) - sizes * base),
                        pa.array(np.add.reduceat(class_part, first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _summed(df: DataFrame, size: int, column: str = "cell") -> np.ndarray:
    """Rows (cell, n) summed into an array of fixed size."""
    found = df.groupBy(column).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[found.column(column).to_numpy()] = found.column("n").to_numpy()
    return out


def score(docs: DataFrame, head_words: int = HEAD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    send = docs.sparkSession.sparkContext.broadcast
    key = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blobs = ", ".join(f"{c} binary" for c in ("held", "sizes", "tokens", "words", "counts"))
    slices = stored(narrow.mapInArrow(_slices, f"slice string, doc_ids array<{key}>, {blobs}"), "token-slices")

    # 1. the head, and its classes
    tops = slices.select("words", "counts").mapInArrow(_tops, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    words = np.sort(tops.column("word").to_numpy().astype(np.int64).view(np.uint64))
    n = len(words) + 1
    pairs = _summed(slices.select("held", "sizes", "tokens", "words").mapInArrow(_pairs(send(words)), "pair int, n long"), n * n, "pair").reshape(n, n).astype(np.float64)
    of = exchange(pairs)
    head = send(Head(words, of[:-1].astype(np.uint8)))
    own = grid_of(pairs, of)

    # 2. all words are counted by hash, with the classes around them
    entries = slices.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    buckets = 32
    while buckets * BUCKET_ENTRIES < entries and buckets < 1 << 30:
        buckets *= 2
    dealt = slices.select("slice", "held", "sizes", "tokens", "words", "counts").mapInArrow(_deal(buckets, head, DENSE), _DEALT)
    counted = stored(dealt.groupBy("bucket").applyInArrow(_count(head, DENSE), _COUNTED), "word-counts")

    # 3. sweeps over all words but the head: the classes follow from the class bigrams of the sweep before
    grid = own
    for _ in range(TAIL_SWEEPS - 1):
        added = _summed(counted.select(*_AROUND).mapInArrow(_sweep(send(grid)), "cell int, n long"), ALL_CLASSES * 2 * CLASSES).reshape(ALL_CLASSES, 2 * CLASSES)[:CLASSES]
        grid = own + added[:, :CLASSES] + added[:, CLASSES:].T
    last = send(grid)
    tokens, seen, once = _summed(counted.select("totals", "fixed", *_AROUND).mapInArrow(_facts(last), "cell int, n long"), 3 * ALL_CLASSES).reshape(3, ALL_CLASSES)

    # 4. counts and classes meet their slices; class bigrams, then scores
    back = counted.mapInArrow(_back(last), "slice string, bucket int, totals binary, classes binary").groupBy("slice").agg(F.collect_list(F.struct("bucket", "totals", "classes")).alias("parts"))
    joined = slices.select("slice", "doc_ids", "held", "sizes", "tokens").join(back, "slice").select("doc_ids", "held", "sizes", "tokens", "parts")
    known = stored(joined.mapInArrow(_merged, f"doc_ids array<{key}>, held binary, sizes binary, tokens binary, totals binary, classes binary"), "known-slices")
    discard(slices), discard(counted)
    steps = _summed(known.select("held", "sizes", "tokens", "classes").mapInArrow(_steps, "cell int, n long"), ALL_CLASSES * ALL_CLASSES).reshape(ALL_CLASSES, ALL_CLASSES)
    model = send(Model(steps.astype(np.float64), tokens.astype(np.float64), seen.astype(np.float64), once))
    out = stored(known.mapInArrow(_score(model), f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    discard(known)
    return out
