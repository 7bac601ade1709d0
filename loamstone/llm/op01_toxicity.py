"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel compares two pieces of text by their common subsequences of four symbols, where each step may skip at most one symbol at
the price of ``DECAY``: an insult keeps most of its subsequences when characters are inserted into it or dropped from it. Symbols are
letters without case and accents, with one symbol for every break between words. A piece is at most ``PIECE`` symbols of a
sentence, and its kernel is scaled by its length.

Landmarks are words of the training sentences: half of them the ones most tied to the label by likelihood ratio, the others the
most frequent words of clean texts. The kernel matrix of the landmarks, whitened by its inverse square root, maps any piece to a
vector of fixed length (Nystrom), on which a linear machine with squared hinge loss is trained. Labels are known for whole
texts only, so a toxic text counts by its most suspicious piece, chosen anew in every round, and clean texts by theirs; words
that many toxic and no clean training texts hold add pieces around them, so that short insults weigh as much as long ones.

The decision is linear in the kernel values, so landmark weights fold into one weight per subsequence. A text of any length is
scored by table look-ups and a sliding sum over every window of ``PIECE`` symbols, and its score is that of its worst window, made a
probability on training texts that the machine has not seen.

The model is fitted on at most ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled texts, whole ones, the ids of smallest hash; texts of the
held-out fold are never among them. They come to the driver as one byte a character. Defined cases: null and empty
texts score like the emptiest text; repeated rows get equal scores; labels that are null or whose document is missing are
ignored, repeated labels count once, and of several texts of a labelled id the one of smallest hash; without labelled texts of both classes every score is 0; an empty table gives an
empty result; extra columns are ignored; a null doc_id is not held out.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

#: Every fifth document by crc32 of the id is held out.
FOLDS = 5
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
LANDMARKS = 512
PIECE, DECAY = 14, 0.5
ROUNDS, EPOCHS, RIDGE = 8, 60, 3e-5
#: Decision value below which a clean piece is not kept for the next round.
EASY = -1.05
#: Clean texts per toxic one for which the probability is meant.
CLEAN_WEIGHT = 8.0
#: Pieces of a clean text that a round adds.
WORST = 2
#: A word of at least so many toxic texts and no clean one gives so many of its places as toxic pieces.
SURE_TEXTS, SURE_PLACES = 8, 12
_SKIPS = [(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2)]
_PRICE = np.array([DECAY ** (sum(s) - 3) for s in _SKIPS], dtype=np.float32)
_BITS, _SIZE = 5, 1 << 20
_BREAK, _MARK = 0, 29


def _symbol_table() -> np.ndarray:
    """Symbols of the characters up to 0x17F: 1-26 letters, 27 digits, 28 other letters, 0 breaks; punctuation is 29."""
    table = np.full(0x180, 28, dtype=np.uint8)
    for c in range(0x180):
        plain = unicodedata.normalize("NFKD", chr(c).lower())[:1]
        if plain.isascii() and plain.isalpha():
            table[c] = ord(plain) - 96
        elif chr(c).isdigit():
            table[c] = 27
        elif chr(c).isspace():
            table[c] = _BREAK
        elif not chr(c).isalpha():
            table[c] = _MARK
    table[[ord("ß")]] = 19
    return table


_SYMBOLS = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """The symbols of a text between two breaks; runs of breaks are one, and punctuation is left out."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.full(len(points) + 2, 28, dtype=np.uint8)
    out[0] = out[-1] = _BREAK
    out[1:-1] = _SYMBOLS[np.minimum(points, 0x17F)]
    out = out[out != _MARK]
    keep = np.r_[True, (out[1:] != _BREAK) | (out[:-1] != _BREAK)]
    return out[keep]


def features(s: np.ndarray, skips: tuple[int, int, int]) -> np.ndarray:
    """The subsequence of four symbols that starts at each place with these steps."""
    a, b, c = skips
    n = len(s) - a - b - c
    if n <= 0:
        return np.empty(0, np.int32)
    w = s.astype(np.int32)
    return ((w[:n] << _BITS | w[a : a + n]) << _BITS | w[a + b : a + b + n]) << _BITS | w[a + b + c : a + b + c + n]


def places(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum, at each place, of the weights of the subsequences that start there."""
    out = np.zeros(len(s), dtype=np.float32)
    for skips, price in zip(_SKIPS, _PRICE):
        f = features(s, skips)
        out[: len(f)] += price * table[f]
    return out


def window_sums(values: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Sum over every window of ``piece`` places; a shorter text has one window."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[piece:] - total[:-piece] if len(values) >= piece else total[-1:]


class Model:
    """Weights of subsequences, and the line that makes a window's sum a probability."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, slope: float, shift: float):
        self.at, self.weight, self.slope, self.shift = at, weight, slope, shift

    def table(self) -> np.ndarray:
        out = np.zeros(_SIZE, dtype=np.float32)
        out[self.at] = self.weight
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -500, 500)))


def _landmarks(texts: list[np.ndarray], toxic: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
    """Words, by likelihood ratio with the label and by frequency in clean texts, between two breaks; and the sure words."""
    held = {True: Counter(), False: Counter()}
    for s, t in zip(texts, toxic):
        held[bool(t)].update({w for w in s.tobytes().split(b"\0") if 3 <= len(w) <= PIECE})
    n1, n0 = int(toxic.sum()), int((~toxic).sum())

    def ratio(word: bytes) -> float:
        a, b = held[True][word] + 0.5, held[False][word] + 0.5
        return a * np.log(a / (n1 + 1) / (b / (n0 + 1)))

    tied = heapq.nsmallest(LANDMARKS // 2, held[True], key=lambda w: (-ratio(w), w))
    taken = set(tied)
    common = heapq.nsmallest(LANDMARKS - len(tied), (w for w in held[False] if w not in taken), key=lambda w: (-held[False][w], w))
    sure = sorted(w for w, n in held[True].items() if n >= SURE_TEXTS and not held[False][w])
    return [np.frombuffer(b"\0" + w + b"\0", dtype=np.uint8) for w in tied + common], sure


def _around(texts: list[np.ndarray], words: list[bytes], rng: np.random.Generator) -> list[np.ndarray]:
    """Pieces around some places of each word, the word at a random place of the piece."""
    left, out = {w: SURE_PLACES for w in words}, []
    for s in texts:
        at = 0
        for word in s.tobytes().split(b"\0"):
            if left.get(word, 0):
                left[word] -= 1
                start = max(0, at - 1 - int(rng.integers(0, max(1, PIECE - len(word) - 1))))
                out.append(s[start : start + PIECE + 6])
            at += len(word) + 1
    return out


def _weighted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [features(s, k) for k in _SKIPS]
    return np.concatenate(found), np.repeat(_PRICE, [len(f) for f in found])


def nystroem(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of the landmarks, their values for each landmark, and the whitening of their kernel matrix (landmarks by rank)."""
    weighted = [_weighted(m) for m in marks]
    at = np.unique(np.concatenate([f for f, _ in weighted]))
    phi = np.zeros((len(marks), len(at)), dtype=np.float32)
    for row, (f, w), m in zip(phi, weighted, marks):
        np.add.at(row, np.searchsorted(at, f), w / np.sqrt(len(m)))
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    sound = values > 1e-6 * values.max()
    return at, phi, (vectors[:, sound] / np.sqrt(values[sound])).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """As ``train_coded``, from texts."""
    return train_coded([symbols(t) for t in texts], toxic)


def train_coded(coded: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Fit the machine on most texts (as symbols) and the probability on the others."""
    toxic = np.asarray(toxic, dtype=bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), 0.0, -1e3)
    fit = np.arange(len(coded)) % 3 != 2
    marks, sure = _landmarks([s for s, f in zip(coded, fit) if f], toxic[fit])

    at, phi, whiten = nystroem(marks)
    project = np.zeros(_SIZE, dtype=np.int32)
    project[at] = np.arange(1, len(at) + 1)
    lift = np.vstack([np.zeros((1, whiten.shape[1]), np.float32), phi.T @ whiten])  # feature -> vector

    def vectors_of(pieces: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(pieces), whiten.shape[1]), dtype=np.float32)
        for row, piece in zip(out, pieces):
            f, w = _weighted(piece)
            known = project[f]
            hit = known > 0
            row += w[hit] @ lift[known[hit]]
        return out / np.float32(np.sqrt(PIECE))

    def fitted(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Squared hinge with ridge and costs, by Newton steps on the points inside the margin; the last weight is the offset."""
        for _ in range(EPOCHS):
            inside = np.flatnonzero(y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1)
            hessian, pull = RIDGE * np.eye(len(w)), np.zeros(len(w))
            for at_ in range(0, len(inside), 2048):
                part = inside[at_ : at_ + 2048]
                xi = np.c_[x[part], np.ones(len(part))].astype(np.float64)
                hessian += (xi * c[part][:, None]).T @ xi
                pull += xi.T @ (c[part] * y[part])
            new = np.linalg.solve(hessian, pull)
            done = np.allclose(new, w, atol=1e-6)
            w = new
            if done:
                break
        return w

    # first guess of the suspicious pieces: kernel with tied landmarks against kernel with common ones
    tied = min(LANDMARKS // 2, len(marks))
    sign = np.r_[np.full(tied, 1.0 / tied), np.full(len(marks) - tied, -1.0 / max(1, len(marks) - tied))]
    fold = (phi.T @ sign).astype(np.float32)
    rng = np.random.default_rng(7)
    own = np.flatnonzero(fit)
    w = np.zeros(whiten.shape[1] + 1)
    certain = vectors_of(_around([coded[i] for i in own if toxic[i]], sure, rng))
    clean = np.empty((0, whiten.shape[1]), np.float32)
    for _ in range(ROUNDS):
        table = np.zeros(_SIZE, dtype=np.float32)
        table[at] = fold
        guilty: list[np.ndarray] = []
        fair: list[np.ndarray] = []
        for i in own:
            sums = window_sums(places(coded[i], table))
            if toxic[i]:
                starts = [int(np.argmax(sums))]
            else:
                starts = [int(np.argmax(sums)), *rng.integers(0, len(sums), WORST - 1).tolist()]
            (guilty if toxic[i] else fair).extend(coded[i][a : a + PIECE + 6] for a in starts)
        clean = np.r_[clean, vectors_of(fair)]
        x = np.r_[vectors_of(guilty), certain, clean]
        y = np.r_[np.ones(len(guilty) + len(certain)), -np.ones(len(clean))]
        cost = np.r_[np.full(len(guilty), 0.25 / max(len(guilty), 1)), np.full(len(certain), 0.25 / max(len(certain), 1)), np.full(len(clean), 0.5 / len(clean))]
        w = fitted(x, y, cost, w)
        clean = clean[clean @ w[:-1].astype(np.float32) + w[-1] > EASY]  # the others come again if they ever matter
        fold = (phi.T @ (whiten @ w[:-1]) / np.sqrt(PIECE)).astype(np.float32)
    model = Model(at, fold, 1.0, 0.0)
    table = model.table()

    # a logistic line on the texts kept apart
    rest = np.flatnonzero(~fit)
    worst = np.array([window_sums(places(coded[i], table)).max() for i in rest])
    y = toxic[rest].astype(float)
    if 0 < y.sum() < len(y):
        low, high = worst[y == 0].max(), np.quantile(worst[y == 1], 0.02)
        model.slope, model.shift = _line(worst, y, np.where(y > 0, 1.0, CLEAN_WEIGHT * y.sum() / (len(y) - y.sum())))
        # where the classes are apart, the line stands between them, nearer to the toxic ones
        if high > low:
            middle = low + 0.5 * (high - low)
            model.slope = max(model.slope, 8.0 / (high - low))
            model.shift = -model.slope * middle
    return model


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one value, by Newton steps."""
    spread = x.std() or 1.0
    z = np.c_[(x - x.mean()) / spread, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * x.mean() / spread)


def _folded(ids: list) -> list[bool]:
    return [c is not None and c % FOLDS == 0 for c in tn.crc32_of_ids(ids)]


def _scores(model_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_sent.value
        table = model.table()
        for batch in batches:
            worst = np.array([window_sums(places(symbols(t or ""), table)).max() for t in batch.column(1).to_pylist()])
            p = model.probability(worst)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_folded(batch.column(0).to_pylist())), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the labelled documents outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value, most in ((0, TRAIN_CLEAN), (1, TRAIN_TOXIC)):
        side = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = side if chosen is None else chosen.unionByName(side)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # TRAIN_TOXIC + TRAIN_CLEAN ids at most
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))
    rows = one.mapInArrow(_coded, "doc_id string, coded binary, toxic int").toArrow().sort_by("doc_id")
    return train_coded([np.frombuffer(c.as_buffer(), dtype=np.uint8) for c in rows.column("coded")], np.array(rows.column("toxic").to_pylist()) == 1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = [symbols(t or "").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(coded, pa.binary()), batch.column(2).cast(pa.int32())], ["doc_id", "coded", "toxic"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scores(sent), f"doc_id {key}, held_out boolean, score double, predicted int")
