"""Strings that break weak hashes, and characters whose composition depends on case."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loamstone.llm import op03_token_output as op03
from loamstone.llm import op04_disclosure as op04
from loamstone.llm import op06_jaccard_join as op06
from loamstone.llm import op07_class_lm as op07
from loamstone.llm import op08_quality_rules as op08
from loamstone.llm import textnum as tn

WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n: int, one: str, other: str) -> str:
    return "".join(one if bin(k).count("1") % 2 == 0 else other for k in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (64, 512, 1024, 2048, 4096)]


@pytest.mark.parametrize("one, other", PAIRS)
def test_regular_strings_differ(one, other):
    words = tn.Words(*tn.text_bytes(pa.array([one, other, one])))
    h = words.hashes(True)
    assert h[0] != h[1] and h[0] == h[2]
    ids = np.frombuffer(one.encode(), np.uint8).astype(np.uint64)
    swapped = np.frombuffer(other.encode(), np.uint8).astype(np.uint64)
    assert tn.sequence_hash(ids, 1) != tn.sequence_hash(swapped, 1)
    assert tn.sequence_hash(ids, 1) != tn.sequence_hash(ids, 2)


def test_hashes_follow_bytes_alone():
    """Wherever a span stands, whatever follows it, whichever length."""
    rng = random.Random(1)
    spans = ["".join(rng.choice("abcXYZé") for _ in range(n)) for n in [*range(1, 40), 200, 1023, 1024, 1025, 5000]]
    one = tn.Words(*tn.text_bytes(pa.array([" ".join(spans)])))
    other = tn.Words(*tn.text_bytes(pa.array(["z" * 3 + "\n" + s + "\t" for s in spans])))
    assert one.hashes(False).tolist() == other.hashes(False)[1::2].tolist()
    low = tn.Words(*tn.text_bytes(pa.array([" ".join(spans).translate({k: k + 32 for k in range(65, 91)})])))
    assert one.hashes(True).tolist() == low.hashes(False).tolist()
    assert len(set(one.hashes(False).tolist())) == len(spans)


def test_operators_tell_regular_strings_apart(spark):
    one, other = PAIRS[2]
    text = "\n".join([one, other, one])
    row = op08.score(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_dup_lines"]) == (3, 1)
    found = op06.classes(spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1}
    # ids 0 and 2 are learned from, 1 is held out (remainders 1, 4 and 3 of the crc)
    scored = op07.score(spark.createDataFrame([(0, one), (2, one), (9, "b")], "doc_id long, text string"))
    assert {r["n_known"] for r in scored.collect()} <= {1, 2}
    mails = spark.createDataFrame([(k, f"{one} writes from a.b@example.com") for k in range(4)] + [(9, f"{other} is not here")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in op04.find(mails).collect()}
    assert spans[9] == ""


def test_composition_before_folding():
    """A capital may have no composed form where its small letter has one."""
    tokenizer = Tokenizer.from_file(WORDS_FILE)
    marks = [chr(k) for k in range(0x300, 0x345)]
    letters = [c for c in map(chr, range(0x41, 0x5B))]
    texts = [f"{c}{m}" for c in letters for m in marks] + [f"x{c}{m}, {c}.{m} {m}{c}" for c in letters for m in marks[::5]]
    rng = random.Random(2)
    alphabet = [*"aTHJWYisS. ,'\n\t1", "̈", "̱", "̌", "̊", "ʼ", "İ", "ß", "Σ", "ς", "é", "ﬁ", "한", "ᄒ", "ᅡ", " ", " ", "Å", "Ǆ"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 24))) for _ in range(6000)]
    ids, n = op03.Encoder(WORDS_FILE).encode(pa.array(texts), 2)
    ends = np.cumsum(n)
    for text, a, b in zip(texts, (ends - n).tolist(), ends.tolist()):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2], ascii(text)
