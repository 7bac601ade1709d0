"""Fill-in-middle transformation by a table-driven automaton over bytes.

One table of states and byte classes does three things in one scan of a run of texts: it tells code points from UTF-8
continuation bytes, lines from each other, and finds sentinels inside a text. The scan's result is a count of every
(state, class) transition per text, from which follow the numbers of units and code points and whether a sentinel occurs.
A second pass over the transitions that begin a unit locates the two cuts.

The scan is parallel within a buffer: the buffer is cut into lanes, every lane is run from every state at once, and the
lanes are then chained by their start states, so a very long text costs no more per byte than many short ones.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays ``plain``; a null id draws as the
empty string; equal ids draw alike, so repeated rows get equal results; an empty table gives an empty result; extra columns
are passed by ``transform`` (a clashing name keeps the operator's own) and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 texts, how many are transformed, and of 100 of those, how many with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Bytes that are scanned at a time, and lanes of a scan.
BLOCK_BYTES, LANES = 1 << 20, 4096
#: State at the begin of a unit, and inside one with no part of a sentinel read.
BEGIN, INSIDE = 0, 1


@dataclass(frozen=True)
class Table:
    """The automaton: class of each byte, next state by (state, class), and what a transition begins or ends.

    Classes from ``n_classes`` on are those of a text's first byte, which leaves any state as ``BEGIN`` does."""

    byte_class: np.ndarray
    following: np.ndarray
    begins_unit: np.ndarray
    begins_char: np.ndarray
    ends_sentinel: np.ndarray

    @property
    def n_states(self) -> int:
        return self.following.shape[0]

    @property
    def n_classes(self) -> int:
        return self.following.shape[1] // 2


def build(sentinels: tuple[str, ...] = SENTINELS) -> Table:
    """The table for lines as units and the sentinels given, which hold no line end."""
    marks = [s.encode() for s in sentinels]
    if any(b"\n" in m or not m for m in marks):
        raise ValueError("a sentinel is not empty and holds no line end")
    prefixes = sorted({m[:k] for m in marks for k in range(1, len(m))}, key=lambda p: (len(p), p))
    state_of = {b"": INSIDE} | {p: 2 + k for k, p in enumerate(prefixes)}

    def step(read: bytes, byte: int) -> tuple[int, bool]:
        now = read + bytes([byte])
        if any(now.endswith(m) for m in marks):
            return INSIDE, True
        while now not in state_of:
            now = now[1:]
        return state_of[now], False

    following = np.zeros((2 + len(prefixes), 256), np.uint8)
    ends = np.zeros(following.shape, bool)
    for read, state in state_of.items():
        for byte in range(256):
            following[state, byte], ends[state, byte] = (BEGIN, False) if byte == 10 else step(read, byte)
    following[BEGIN], ends[BEGIN] = following[INSIDE], ends[INSIDE]
    char = np.array([byte & 0xC0 != 0x80 for byte in range(256)])
    columns, byte_class = np.unique(np.vstack([following, ends, char[None]]).T, axis=0, return_inverse=True)
    n, k = len(following), len(columns)
    following, ends, char = columns[:, :n].T, columns[:, n : 2 * n].T.astype(bool), columns[:, 2 * n].astype(bool)
    following = np.hstack([following, np.tile(following[BEGIN], (n, 1))]).astype(np.uint8)
    ends = np.hstack([ends, np.tile(ends[BEGIN], (n, 1))])
    begins = np.zeros(following.shape, bool)
    begins[BEGIN] = begins[:, k:] = True
    return Table(byte_class.reshape(-1).astype(np.uint8), following, begins, np.tile(np.r_[char, char], (n, 1)), ends)


def _run(table: Table, classes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each byte of a block, and the state after it."""
    n, width = len(classes), table.following.shape[1]
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    padded = np.zeros(lanes * steps, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T).astype(np.intp)
    flat = (table.following.astype(np.intp) * width).ravel()  # states as offsets into the table
    now = np.repeat(np.arange(table.n_states, dtype=np.intp) * width, lanes).reshape(table.n_states, lanes)
    seen = np.empty((steps, table.n_states, lanes), np.uint16)
    for t in range(steps):
        seen[t] = now
        now = flat[now + grid[t]]
    after = now // width
    start = np.empty(lanes, np.intp)
    for lane, row in enumerate(after.T.tolist()):
        start[lane] = state
        state = row[state]
    before = (seen[:, start, np.arange(lanes)].T.ravel()[:n] // width).astype(np.uint8)
    return before, int(table.following[before[-1], classes[-1]])


def scan(table: Table, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The transition of each byte, as state * columns + class."""
    classes = table.byte_class[buf]
    classes[off[:-1][off[:-1] < off[1:]]] += table.n_classes
    out, state, width = np.empty(len(buf), np.int64), BEGIN, table.following.shape[1]
    for at in range(0, len(buf), BLOCK_BYTES):
        part = classes[at : at + BLOCK_BYTES]
        before, state = _run(table, part, state)
        out[at : at + len(part)] = before.astype(np.int64) * width + part
    return out


class Units:
    """Counts and unit begins of a run of texts."""

    def __init__(self, table: Table, buf: np.ndarray, off: np.ndarray):
        moves = scan(table, buf, off)
        n, kinds = len(off) - 1, table.following.size
        counts = np.bincount(np.repeat(np.arange(n), np.diff(off)) * kinds + moves, minlength=n * kinds).reshape(n, kinds)
        self.off = off
        self.units = counts @ table.begins_unit.ravel()
        self.chars = counts @ table.begins_char.ravel()
        self.sentinels = counts @ table.ends_sentinel.ravel()
        # second pass: where units begin, and code points before each byte
        self._begin = np.flatnonzero(table.begins_unit.ravel()[moves])
        self._first = np.r_[0, np.cumsum(self.units)]
        self._chars = np.r_[0, np.cumsum(table.begins_char.ravel()[moves], dtype=np.int64)]

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Per text, the byte after its first ``units`` units."""
        inside = units < self.units
        at = self.off[1:].copy()
        at[inside] = self._begin[(self._first[:-1] + units)[inside]]
        return at

    def chars_between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._chars[end] - self._chars[start]


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers of each id: the first digits of the sha256 of ``seed:id``."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").astype(np.int64).reshape(len(ids), 4)


def _transform(sentinels: tuple[str, ...], seed: int, rate: int, suffix_first: int):
    prefix_mark, suffix_mark, middle_mark = (s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = build(sentinels)
        for batch in batches:
            raw, offsets = tn.text_bytes(batch.column(1))
            for a, b in tn.slices(offsets):
                buf, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                units = Units(table, buf, off)
                h = draws(batch.column(0)[a:b].to_pylist(), seed)
                one, two = h[:, 0] % (units.units + 1), h[:, 1] % (units.units + 1)
                first, second = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
                plain = (units.units == 0) | (units.sentinels > 0) | (h[:, 2] % 100 >= rate)
                spm = h[:, 3] % 100 < suffix_first
                data, out = buf.tobytes(), []
                for p, s, x, y, start, end in zip(plain.tolist(), spm.tolist(), first.tolist(), second.tolist(), off[:-1].tolist(), off[1:].tolist()):
                    if p:
                        out.append(data[start:end])
                    elif s:
                        out.append(b"".join((suffix_mark, data[y:end], prefix_mark, data[start:x], middle_mark, data[x:y])))
                    else:
                        out.append(b"".join((prefix_mark, data[start:x], suffix_mark, data[y:end], middle_mark, data[x:y])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                extra = [batch.column(k)[a:b] for k in range(2, batch.num_columns)]
                columns = [
                    batch.column(0)[a:b],
                    pa.array(units.units.astype(np.int64)),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(units.chars_between(off[:-1], first), mask=plain),
                    pa.array(units.chars_between(first, second), mask=plain),
                    pa.array(out, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns + extra, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "_output"] + batch.schema.names[2:])

    return run


_OWN = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, sentinels: tuple[str, ...] = SENTINELS, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Each document's ``n`` units, ``form`` (plain, psm or spm), code points of prefix and middle, and ``output``, the text to train on."""
    if len(set(sentinels)) != 3 or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("three different sentinels are needed, none inside another")
    extra = [f for f in docs.schema.fields if f.name.lower() not in (*_OWN, "text", "_output")]
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, _output binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    named = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{f.name}`") for f in extra])
    out = named.mapInArrow(_transform(tuple(sentinels), seed, rate, suffix_first), schema)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("_output").cast("string").alias("output"), *[F.col(f"`{f.name}`") for f in extra])


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    parts = F.split(output, "|".join("\\Q" + s + "\\E" for s in sentinels), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, **settings) -> DataFrame:
    """Digests of each document's output and of the text rebuilt from it."""
    out = transform(docs.select("doc_id", "text"), **settings)
    back = restored(F.col("output"), F.col("form"), settings.get("sentinels", SENTINELS))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
