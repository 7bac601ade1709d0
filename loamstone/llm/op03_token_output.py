"""Token ids in patched frame-of-reference blocks.

The ids of a run of documents make one *segment*, cut into blocks of ``BLOCK`` ids. A block stores its minimum, a bit
width taken as a high percentile of its offsets' widths, the offsets' low bits packed at that width, and an exception list
(place, high bits) for offsets that are wider. A segment's header indexes where each block starts, so any block can be read
alone. Segments are rows of a Parquet table in the shared folder; within a partition they follow the key's order, and
partitions follow each other.

Segment layout, little-endian: ``u32 magic, u32 n_ids, u32 n_blocks``, the index ``u32 * (n_blocks + 1)`` of byte places
after the index, then per block ``u32 minimum, u8 width, u8 exceptions``, the packed offsets, ``u8`` exception places,
``u32`` exception high bits.

Defined cases: a null text is empty, and an empty text is its end id alone; repeated rows are written once for each row;
documents with equal keys follow in the order of their texts; a null key comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Arrow's own allocators keep what they free; a worker shares its executor's memory (as in ``textnum``).
pa.set_memory_pool(pa.system_memory_pool())

MAGIC = 0x31464F50
BLOCK = 128
#: Share of a block's offsets that fit the chosen width; the others are exceptions.
PERCENTILE = 0.9
#: A segment is closed when it holds so many ids; a longer document makes a longer segment.
SEGMENT_IDS = 500_000
#: Distinct words that a worker remembers; beyond, the half that was not seen for the longest time is forgotten.
#: A worker keeps them between tasks, as flat arrays of about 50 bytes a word, beside what other stages left in its executor.
REMEMBERED = 400_000


# ---- codec ---------------------------------------------------------------------------------------------------------


def _squeeze(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values, one after the other; 64 values fill ``width`` 64-bit words."""
    lanes = np.ascontiguousarray((values & np.uint32((1 << width) - 1)).reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), dtype="<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _stretch(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_squeeze`` for rows of bytes."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[word + 1] << np.uint64(64 - shift)
        lanes[k] = (v & mask).astype(np.uint32)
    return lanes.T.reshape(-1, BLOCK)


def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    ids = np.asarray(ids, dtype=np.uint32)
    n, n_blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.array([MAGIC, 0, 0, 0], dtype="<u4").tobytes()
    padded = np.r_[ids, np.full(n_blocks * BLOCK - n, ids[-1], dtype=np.uint32)].reshape(n_blocks, BLOCK)
    low = padded.min(axis=1)
    offset = padded - low[:, None]
    bits = np.frexp(offset)[1].astype(np.uint8) if offset.max() < 1 << 24 else np.frexp(offset.astype(np.float64))[1].astype(np.uint8)  # 0 for 0
    width = np.sort(bits, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1]
    over = bits > width[:, None]
    n_over = over.sum(axis=1).astype(np.uint8)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            line = _squeeze(offset[rows], int(w)).tobytes()
            size = BLOCK * int(w) // 8
            for k, r in enumerate(rows.tolist()):
                packed[r] = line[k * size : (k + 1) * size]
    heads = np.zeros(n_blocks, dtype=[("low", "<u4"), ("width", "u1"), ("over", "u1")])
    heads["low"], heads["width"], heads["over"] = low, width, n_over
    head = heads.tobytes()
    block_of, places = np.nonzero(over)
    high = (offset[over] >> width[block_of].astype(np.uint32)).astype("<u4").tobytes()
    places, at = places.astype(np.uint8).tobytes(), np.r_[0, np.cumsum(n_over, dtype=np.int64)]
    blocks = [head[6 * b : 6 * b + 6] + packed[b] + places[at[b] : at[b + 1]] + high[4 * at[b] : 4 * at[b + 1]] for b in range(n_blocks)]
    index = np.r_[0, np.cumsum([len(b) for b in blocks])].astype("<u4")
    return np.array([MAGIC, n, n_blocks], dtype="<u4").tobytes() + index.tobytes() + b"".join(blocks)


def unpack(segment: bytes) -> np.ndarray:
    """All ids of a segment."""
    magic, n, n_blocks = np.frombuffer(segment, dtype="<u4", count=3)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    if not n:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(segment, dtype=np.uint8)
    start = np.frombuffer(segment, dtype="<u4", count=int(n_blocks), offset=12).astype(np.int64) + 12 + 4 * (int(n_blocks) + 1)
    low = raw[start[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, n_over = raw[start + 4].astype(np.int64), raw[start + 5].astype(np.int64)
    out = np.zeros((int(n_blocks), BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out[rows] = _stretch(raw[start[rows][:, None] + 6 + np.arange(BLOCK * w // 8)], int(w))
    if n_over.sum():
        block_of = np.repeat(np.arange(len(n_over)), n_over)
        nth = np.arange(len(block_of)) - np.repeat(np.r_[0, np.cumsum(n_over)[:-1]], n_over)
        after = (start + 6 + BLOCK * width // 8)[block_of]
        places = raw[after + nth]
        high = raw[(after + n_over[block_of] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[block_of, places] |= high << width[block_of].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[: int(n)]


def unpack_block(segment: bytes, block: int) -> np.ndarray:
    """The ids of one block, by the index alone."""
    _, n, n_blocks = (int(x) for x in np.frombuffer(segment, dtype="<u4", count=3))
    index = np.frombuffer(segment, dtype="<u4", count=n_blocks + 1, offset=12).astype(np.int64)
    body = 12 + 4 * (n_blocks + 1)
    count = min(BLOCK, n - block * BLOCK)
    alone = np.array([MAGIC, BLOCK, 1, 0, index[block + 1] - index[block]], dtype="<u4").tobytes()
    return unpack(alone + segment[body + index[block] : body + index[block + 1]])[:count]


# ---- tokenizing ----------------------------------------------------------------------------------------------------


#: Settings of a tokenizer file under which a text's ids are those of its chunks between spaces (fixed values of the format).
BY_WORDS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words that the normalizer of such a tokenizer leaves as they are and that its pre-tokenizer keeps whole.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def by_words(settings: dict) -> bool:
    """Whether a tokenizer of these settings may encode texts by their chunks; any other encodes whole texts."""
    parts = (settings.get("normalizer") or {}).get("normalizers"), (settings.get("pre_tokenizer") or {}).get("pretokenizers")
    return parts == (BY_WORDS["normalizer"], BY_WORDS["pre_tokenizer"]) and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where printable, else one from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Words(dict):
    """Words and their ids as named flat arrays; a batch's words are looked up all at once."""

    def __init__(self):
        super().__init__(words=pa.array([], pa.string()), ids=np.empty(0, np.uint32), begin=np.zeros(1, np.int64), seen=np.empty(0, np.int32))
        self.batch = 0

    def places(self, words: pa.Array, ids_of: Callable[[str], bytes]) -> np.ndarray:
        """The place of each word; ``ids_of`` gives the ids of new ones as little-endian unsigned 32-bit integers."""
        self.batch += 1
        if len(self["words"]) > REMEMBERED:
            self._forget()
        n = len(self["words"])
        found = pc.index_in(words, value_set=self["words"])
        new = words.filter(pc.is_null(found)).dictionary_encode()
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = n + new.indices.to_numpy(zero_copy_only=False)
        each = [ids_of(w) for w in new.dictionary.to_pylist()]
        ends = self["begin"][-1] + np.cumsum(np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4)
        self["words"] = pa.concat_arrays([self["words"], new.dictionary])
        self["ids"] = np.concatenate([self["ids"], np.frombuffer(b"".join(each), dtype="<u4")])
        self["begin"] = np.concatenate([self["begin"], ends])
        self["seen"] = np.concatenate([self["seen"], np.empty(len(each), np.int32)])
        self["seen"][at] = self.batch
        return at

    def _forget(self) -> None:
        kept = np.sort(np.argsort(self["seen"], kind="stable")[-(REMEMBERED // 2) :])
        n = np.diff(self["begin"])[kept]
        begin = np.r_[0, np.cumsum(n)]
        self["ids"] = self["ids"][np.repeat(self["begin"][kept] - begin[:-1], n) + np.arange(begin[-1])]
        self["words"], self["begin"], self["seen"] = self["words"].take(pa.array(kept)), begin, self["seen"][kept]


#: Per tokenizer file what a worker remembers, a list of one.
_remembered: dict[str, list[_Words]] = {}


class Encoder:
    """Ids of whole texts, by the library.

    A tokenizer of the settings ``BY_WORDS`` folds case, drops white space and never joins or composes across it, so each chunk between
    spaces or line ends is encoded by itself. A full stop or comma after a letter is a piece of its own. Plain words go to
    the library's BPE model at once, all other chunks through the whole tokenizer. A worker remembers what it encoded for
    its next task. Any other tokenizer encodes each text whole; truncation and padding of the file are switched off.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._tokenizer.no_truncation(), self._tokenizer.no_padding()
        with open(tokenizer_file, encoding="utf-8") as file:
            self._by_words = by_words(json.load(file))
        self._model = self._tokenizer.model
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known = _remembered.setdefault(tokenizer_file, [_Words()])

    def _whole(self, chunk: str) -> bytes:
        ids = self._tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            ids = [t.id for t in self._model.tokenize(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_LETTERS))]
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._whole(chunk)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other with ``end_id`` after each, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        # added tokens are matched before folding
        if not self._by_words or any(pc.any(pc.match_substring(texts, a, ignore_case=True)).as_py() for a in self._added if len(texts)):
            end = struct.pack("<I", end_id)
            each = [self._whole(t) + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), dtype="<u4"), np.array([len(ids) // 4 for ids in each], dtype=np.int64)
        # a full stop or comma between a letter and a space is a piece of its own
        apart = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), "([A-Za-zß-öø-ÿ])([.,])( |$)", r"\1 \2\3")
        chunks = pc.split_pattern(apart, " ")
        sizes = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        # chunks beyond ASCII are composed before they are folded, which only the whole tokenizer does
        ascii_only = pc.equal(pc.binary_length(coded.dictionary), pc.utf8_length(coded.dictionary))
        (remembered,) = self._known
        known = remembered.places(pc.if_else(ascii_only, pc.ascii_lower(coded.dictionary), coded.dictionary), self._ids)
        flat, begin = remembered["ids"], remembered["begin"]
        place = known[coded.indices.to_numpy(zero_copy_only=False)]
        length = np.diff(begin)
        n = length[place]
        upto = np.r_[0, np.cumsum(n)]
        ends = np.cumsum(sizes)
        per_text = upto[ends] - upto[ends - sizes]
        body = flat[np.repeat(begin[:-1][place] - upto[:-1], n) + np.arange(upto[-1])]
        return np.insert(body, np.cumsum(per_text), np.uint32(end_id)), per_text + 1


def _write(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer_file), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        keys: list = []
        counts: list[int] = []
        state = {"start": 0, "number": 0}
        key_type = None

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [pa.array([part], pa.int32()), pa.array([state["number"]], pa.int32()), pa.array([state["start"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())]
            state["start"] += len(ids)
            state["number"] += 1
            held.clear(), keys.clear(), counts.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "number", "start_in_part", "n_ids", "doc_ids", "n_tokens", "payload"])

        for batch in batches:
            key_type = batch.column(0).type
            size = max(1, min(batch.num_rows, int(batch.num_rows * 4e6 / max(batch.nbytes, 1))))
            for at in range(0, batch.num_rows, size):
                few = batch.slice(at, size)
                ids, n = encoder.encode(few.column(1), end_id)
                held.append(ids), keys.extend(few.column(0).to_pylist()), counts.extend(n.tolist())
                if sum(map(len, held)) >= SEGMENT_IDS:
                    yield close()
            pa.default_memory_pool().release_unused()
        if held:
            yield close()
        pa.default_memory_pool().release_unused()

    return run


def write_segments(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None, order: list[Column] | None = None, partitions: int | None = None) -> str:
    """Encode ``docs`` and write segments in the order given (default: ascending doc_id) to ``path``; returns the path."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    order = order or [F.col("doc_id")]
    named = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = [F.col(f"_o{i}") for i in range(len(order))]
    n = partitions or max(docs.sparkSession.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = named.repartitionByRange(n, *by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, number int, start_in_part long, n_ids long, doc_ids array<{key}>, n_tokens array<long>, payload binary"
    ranged.mapInArrow(_write(tokenizer_file, end_id), schema).write.option("compression", "none").parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            base, keys, n = one.column(0)[0].as_py(), one.column(1).flatten(), one.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = unpack(one.column(3)[0].as_buffer()).astype("<u4")
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(base + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            del one, ids, raw
            pa.default_memory_pool().release_unused()


def written_order(docs: DataFrame) -> list[Column]:
    """The order of the rows in the files that ``docs`` was read from: part number, file name, row in the file.

    ``docs`` must be read from Parquet files directly."""
    name = F.col("_metadata.file_name")
    return [F.coalesce(F.regexp_extract(name, "part-([0-9]+)", 1).try_cast("long"), F.lit(-1)), name, F.col("_metadata.row_index")]


def read_digests(docs: DataFrame, path: str) -> DataFrame:
    """Read the segments at ``path`` and return per document where its ids start, how many they are, and their crc32.

    Only the number of ids per partition, one row each, is gathered to place the partitions one after the other.
    """
    spark = docs.sparkSession
    found = spark.read.parquet(path)
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in found.groupBy("part").agg(F.sum("n_ids")).collect()):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, _before long")
    placed = found.join(F.broadcast(offsets), "part").select((F.col("_before") + F.col("start_in_part")).alias("base"), "doc_ids", "n_tokens", "payload")
    key = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(_read, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = 2, order: list[Column] | None = None) -> DataFrame:
    return read_digests(docs, write_segments(docs, tokenizer_file, end_id, order=order))
