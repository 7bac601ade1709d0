"""Personal data, and the terms that give it away.

Base kinds (email, ip, card, phone) are found by pattern. Around them the information-theoretic part works on the corpus: a
value e found in df(e) of N documents has IC(e) = -log2(df(e) / N) bits; a term t of the same documents reveals PMI(e; t) =
log2(p(e | t) / p(e)) of these bits. p(e | t) is estimated over whole documents: the share of the documents with t that also hold e,
discounted by m / (m + ``SMOOTH``), where m is the number of different texts that hold both, so that few texts, or many copies of one,
prove little. A term is a disclosing term for e if the bits it leaves, IC(e) - PMI(e; t) = -log2 p(e | t), are at most ``LEFT_BITS`` and
at most the share ``LEFT_SHARE`` of IC(e). In every document that holds e, wherever the term stands, ``sanitised`` generalises it to its
class of word, or removes it where at most ``REMOVE_BITS`` are left. All counts are over all documents.

Values that stand in exactly the same texts are judged as one. A value of a single text can never reach the bound, as the discount alone leaves
-log2(1 / (1 + ``SMOOTH``)) bits, so its terms are not counted at all. Terms are listed once per text, not once per value, so what
moves grows with the texts that hold values.

A term is a run of letters and digits, any character beyond ASCII included, A-Z taken as a-z, outside all base spans; its number of
documents counts it anywhere. Defined cases: a null or empty text has no spans; repeated rows get equal results and count as
documents; an empty table gives an empty result; extra columns pass through ``sanitised``, whatever their names; a null doc_id stays
null; spans of one kind never overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import discard, free_name, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Weight against small numbers of texts.
SMOOTH = 1.0
#: Bits of a value, and share of its information, that a disclosing term may leave; and the bits at which it is removed.
LEFT_BITS, LEFT_SHARE, REMOVE_BITS = 0.75, 0.1, 0.35
#: Rows of a few numbers that may be broadcast (about 50 bytes each); beyond, the joins are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of text whose terms are counted at a time.
SLICE = 4_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can start only where a run of digits starts, so a run is never tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the letters before it, back to the end of the last match, if a domain follows: linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # short before they are read as numbers
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _value(text: str, span: tuple[int, int, str]) -> int:
    a, b, kind = span
    value = text[a:b]
    return _hash(kind + ":" + (value.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)))


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, entities array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base_spans", "entities"]
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            spans = base_spans(text) if text else []
            line, kinds = written(spans), [s[2] for s in spans]
            rows.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(line.encode()).hexdigest(), line, sorted({_value(text, s) for s in spans})))
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 7, types)]], ["doc_id", "h", *names])


def _terms(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The places of a text's terms outside all base spans, and their hashes."""
    buf, off = tn.text_bytes(pa.array([text]))
    hashes = tn.Words(buf, off, _BREAKS).hashes(True)
    places = [m.span() for m in _TERM.finditer(text)]
    starts, ends = np.array([a for a, _ in places], dtype=np.int64), np.array([b for _, b in places], dtype=np.int64)
    free = np.ones(len(places), dtype=bool)
    for a, b, _ in base_spans(text):
        free[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = False
    return [places[k] for k in np.flatnonzero(free)], hashes[free].view(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, t) for every different term of each text."""
    for batch in batches:
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.unique(_terms(text)[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), h, dtype=np.int64)), pa.array(found)], ["h", "t"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a slice hold each term."""
    for batch in batches:
        buf, off = tn.text_bytes(batch.column(0))
        for a, b in tn.slices(off, SLICE):
            w = tn.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a], _BREAKS)
            t, own = w.hashes(True).view(np.int64), w.owners()
            order = np.lexsort((t, own))
            t, own = t[order], own[order]
            once = np.r_[True, (t[1:] != t[:-1]) | (own[1:] != own[:-1])][: len(t)]
            terms, n = np.unique(t[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], ["t", "n"])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("remove", pa.bool_())]))
    for batch in batches:
        for h, text, told in zip(*(c.to_pylist() for c in batch.columns[:3])):
            remove = {t["t"]: t["remove"] for t in told}
            places, hashes = _terms(text)
            spans = [{"start": a, "stop": b, "remove": remove[t]} for (a, b), t in zip(places, hashes.tolist()) if t in remove]
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([spans], kind)], ["h", "terms"])


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for base, terms in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
            if terms:
                spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                base = written(sorted(spans + [(t["start"], t["stop"], "term") for t in terms], key=lambda s: (s[0], KINDS.index(s[2]))))
            lines.append(base)
        n_terms = [len(t or ()) for t in batch.column(7).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(lines, pa.string()), pa.array(n_terms, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])


def _hint(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def disclosures(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(h, t, remove): the disclosing terms of every different text that holds a value they disclose."""
    total = float(max(scanned.count(), 1))
    held = scanned.filter(F.size("entities") > 0).groupBy("h").agg(F.first("entities").alias("entities"), F.count(F.lit(1)).alias("rows"))
    mentions = stored(held.select("h", "rows", F.explode("entities").alias("e")), "mentions")
    # values of exactly the same texts are one group g; a group of too few texts can disclose nothing
    shares = F.col("texts") / (F.col("texts") + SMOOTH)
    same = [F.bit_xor(F.xxhash64("h", F.lit(k))) for k in (1, 2)]
    values = mentions.groupBy("e").agg(F.sum("rows").alias("df"), F.count(F.lit(1)).alias("texts"), F.xxhash64(*same).alias("g")).filter(-F.log2(shares) <= LEFT_BITS)
    values = stored(values, "values")
    grouped = stored(mentions.join(_hint(values.select("e", "g"), values.count() <= BROADCAST_ROWS), "e").select("h", "rows", "g").distinct(), "grouped")
    wanted = grouped.select("h").distinct()
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    listed = stored(texts.join(_hint(wanted, wanted.count() <= BROADCAST_ROWS), "h", "left_semi").dropDuplicates(["h"]).mapInArrow(_held, "h long, t long"), "listed")
    few_grouped = grouped.count() <= BROADCAST_ROWS
    pairs = listed.join(_hint(grouped, few_grouped), "h").groupBy("g", "t").agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("texts"))
    pairs = stored(pairs.filter(-F.log2(shares) <= LEFT_BITS), "pairs")
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    left = -F.log2(F.col("both") / F.col("n") * shares)
    bits = -F.log2(F.col("df") / F.lit(total))
    groups = values.groupBy("g").agg(F.max("df").alias("df"))  # values of one group have the same df
    told = pairs.join(groups, "g").join(counts, "t").withColumn("left", left).filter((F.col("left") <= LEFT_BITS) & (F.col("left") <= bits * LEFT_SHARE))
    told = stored(told.select("g", "t", (F.col("left") <= REMOVE_BITS).alias("remove")), "told")
    found = listed.join(_hint(grouped.select("h", "g"), few_grouped), "h").join(_hint(told, told.count() <= BROADCAST_ROWS), ["g", "t"])
    found = stored(found.groupBy("h", "t").agg(F.max("remove").alias("remove")), "disclosed")
    for used in (mentions, values, grouped, listed, pairs, told):
        discard(used)
    return found


def _term_spans(docs: DataFrame, scanned: DataFrame) -> tuple[DataFrame, bool]:
    """(h, terms): spans of disclosing terms, per different text that has any; and whether they are few enough to be broadcast."""
    found = disclosures(docs, scanned)
    told = found.groupBy("h").agg(F.collect_list(F.struct("t", "remove")).alias("told"))  # no more than the text's own terms
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    held = texts.join(_hint(told, found.count() <= BROADCAST_ROWS), "h").dropDuplicates(["h"]).select("h", "text", "told")
    terms = stored(held.mapInArrow(_locate, "h long, terms array<struct<start:long,stop:long,remove:boolean>>"), "terms")
    discard(found)
    return terms, (terms.agg(F.sum(F.size("terms") + 1)).first()[0] or 0) <= BROADCAST_ROWS


def _scanned(docs: DataFrame) -> DataFrame:
    key = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    return stored(narrow.mapInArrow(_scan, f"doc_id {key}, h long, {_FOUND}"), "scanned")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base kinds, all spans, and n_term, the number of disclosing terms."""
    scanned = _scanned(docs)
    terms, few = _term_spans(docs, scanned)
    joined = scanned.join(_hint(terms, few), "h", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base_spans", "terms")
    key = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_with_terms, f"doc_id {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def class_of(word: str) -> str:
    """What a disclosing term is generalised to."""
    return "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[word]"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, terms in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            spans = [(a, b, f"[{k}]") for a, b, k in base_spans(text or "")]
            spans += [(t["start"], t["stop"], "" if t["remove"] else class_of(text[t["start"] : t["stop"]])) for t in terms or ()]
            done, at = [], 0
            for a, b, by in sorted(spans):
                if a >= at:
                    done += [text[at:a], by]
                at = max(at, b)
            out.append(None if text is None else "".join(done) + text[at:])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], batch.schema.names[:-1])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind, and disclosing terms generalised or removed; columns unchanged."""
    scanned = _scanned(docs)
    terms, few = _term_spans(docs, scanned)
    discard(scanned)
    key, spans = free_name(docs, "h"), free_name(docs, "terms")
    named = terms.select(F.col("h").alias(key), F.col("terms").alias(spans))
    others = [c for c in docs.columns if c != "text"]
    joined = docs.join(_hint(named, few), F.xxhash64(docs["text"].cast("string")) == named[key], "left").select(*[docs[c] for c in others], docs["text"].cast("string").alias("text"), named[spans])
    return joined.mapInArrow(_clean, joined.drop(spans).schema).select(*docs.columns)
