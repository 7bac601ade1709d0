"""Repeated-phrase automata against a plain version."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.llm import op12_phrase_dedup as op12

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, size=20):
    """rows: (doc_id, text, hash of the text); equal (id, text) are one document."""
    order = sorted({(i is not None, i or 0, h, t or "") for i, t, h in rows})
    seen, covered = set(), {}
    for known, i, h, t in order:
        w = WORD.findall(t)
        gone = covered[known, i, h] = set()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                gone.update(range(k, k + size))
            seen.add(g)
    out = []
    for i, t, h in rows:
        w, gone = WORD.findall(t or ""), covered[i is not None, i or 0, h]
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts():
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage, short, brief = fresh(70), fresh(20), fresh(19)
    out = [fresh(50) + " " + passage + "\n" + fresh(30) for _ in range(12)]  # one passage at many places
    out += [fresh(9) + " " + short + "\t" + fresh(40) for _ in range(4)]  # exactly a window
    out += [fresh(9) + " " + brief + " " + fresh(40) for _ in range(4)]  # one word less
    out += ["a b c d e " * 5, "a b c d e " * 9, "x " * 300, ("x " * 25).strip(), "y " * 20, "y " * 21]  # windows that repeat inside a region
    half = fresh(60)
    out += [half, " ".join(half.split()[:35]), " ".join(half.split()[25:]), half + " " + half]
    start = fresh(10)  # boilerplate before different texts: one anchor, many regions
    out += [f"{start} {fresh(40)}" for _ in range(30)]
    out += ["é ü " * 15, "É ü " * 15, "", None, " \n", "\x0b".join(["vt"] * 45), "word" * 3000 + " " + fresh(60)]
    out += [out[0], out[3], out[3]]
    return out


@pytest.fixture(scope="module")
def case(spark, edge):
    listed = texts()
    ids = np.random.default_rng(6).permutation(len(listed)).tolist()
    rows = [(i, t) for i, t in zip(ids, listed)] + [(4, listed[1]), (4, listed[1]), (5, listed[2]), (None, listed[4]), (None, listed[5])]
    rows += [(r["doc_id"], r["text"]) for r in edge.collect()]
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, kept string, shard int").repartition(4)
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    return docs, [tuple(r) for r in hashed]


@pytest.mark.parametrize("size, phrase, shard_bytes, hot", [(20, 8, 4 << 20, 5000), (20, 8, 3000, 5000), (20, 8, 3000, 1), (20, 8, 900, 4), (20, 20, 2000, 3), (6, 1, 2500, 50)])
def test_against_plain_version(case, size, phrase, shard_bytes, hot):
    docs, rows = case
    found = op12.report(docs, size=size, phrase=phrase, shard_bytes=shard_bytes, hot=hot)
    assert Counter(map(tuple, found.collect())) == Counter(plain(rows, size))


def test_kept_texts_and_passages(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three {passage}"), (3, "four five")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in op12.deduplicate(docs).collect()} == {1: f"one {passage} two", 2: "three", 3: "four five"}
    assert [tuple(r) for r in op12.later_passages(docs).collect()] == [(2, 1, 60)]


def test_nothing(empty):
    assert op12.report(empty).count() == 0
    with pytest.raises(ValueError):
        op12.report(empty, size=5, phrase=6)


def test_one_exchange_of_texts(case):
    """All three steps read the same exchange of documents."""
    out = op12.report(case[0], shard_bytes=3000)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2
