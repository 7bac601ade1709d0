"""Vectorised text kernels: words and hashes of all texts of an Arrow batch at once, on their UTF-8 bytes.

A word's hash takes up its bytes eight at a time, each step mixed by shifts and products (a polynomial of bytes would send
whole families of regular strings to one value); long spans and sequences are hashed by BLAKE2. Equal byte strings have
equal hashes, and different ones collide with the chance of 64-bit hashing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are processed at a time; a longer single text is processed alone.
SLICE_BYTES = 500_000

#: Arrow's own allocators keep what they free; a worker lives through many stages and shares its executor's memory.
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1024

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: The low bytes of an eight-byte value.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each, at least one text in each."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()  # what a batch took goes back to the machine, not to the next stage's worker


class Words:
    """The words of a run of texts: byte spans ``start`` and ``end``, and ``first[d]`` to ``first[d + 1]`` for text d."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, separators: np.ndarray = WHITE):
        self.buf, self.off = buf, off
        word = ~separators[buf]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        full = off[:-1] < off[1:]
        heads, tails = off[:-1][full], off[1:][full] - 1
        start[heads] = word[heads]
        end[tails] = word[tails]
        self.word = word
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def hashes(self, fold: bool) -> np.ndarray:
        """Of every word; ``fold`` takes A-Z as a-z."""
        return span_hashes(self.buf, self.start, self.end, fold)

    def owners(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Of the bytes of each span: eight bytes at a time are taken up and mixed; ``fold`` takes A-Z as a-z."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = _FOLDED[buf] if fold else buf
    eights = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    h = mix(size.astype(U) * U(_ODD) + (eights[start] & _LOW[np.minimum(size, 8)]))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = _digest(padded[start[i] : end[i]].tobytes(), 0)
    active = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    at, left = start[active], size[active]
    while len(active):
        at, left = at + 8, left - 8
        h[active] = mix(h[active] * U(0xD6E8FEB86659FD93) + (eights[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        if not more.all():
            active, at, left = active[more], at[more], left[more]
    return h


def _digest(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Of ``size`` consecutive values, starting at each; the last ``size - 1`` places repeat the final value and mean nothing."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(len(words), dtype=U)
    h = np.zeros(n, dtype=U)
    for k in range(size):
        h = h * U(0x5851F42D4C957F2D) + words[k : k + n]
        h ^= h >> U(29)
    return np.r_[mix(h), np.zeros(size - 1, dtype=U)]


def sequence_hash(words: np.ndarray, seed: int) -> int:
    """Of a whole sequence, order and length included."""
    return _digest(np.ascontiguousarray(words).tobytes(), seed)


def crc32_of_ids(ids: list) -> list[int | None]:
    """Unsigned crc32 of each id as decimal text; null stays null."""
    import zlib

    return [None if x is None else zlib.crc32(str(x).encode()) for x in ids]
