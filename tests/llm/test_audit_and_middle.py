"""The filter audit and the fill-in-middle transformation against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamstone.llm import op11_filter_audit as op11
from loamstone.llm import op13_fill_in_middle as op13
from loamstone.llm import textnum as tn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[^\n]*\n|[^\n]+")
LABELS = "doc_id long, quality int, toxic int, text string"


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    rows = [(i, t or "", g or "") for i, t, g in rows]
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[t].append(i)
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    fails = []
    for i, t, g in rows:
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i for j in ids[t])
        fails.append((g, {k for k, v in f.items() if v}, i in good, i in toxic))
    out, share = [], Counter()
    for g in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == g]
        for order in map("".join, permutations("ABCDE")):
            for s in range(1, 6):
                x, before, upto = order[s - 1], set(order[: s - 1]), set(order[:s])
                here = [f for f in mine if x in f[1] and not f[1] & before]
                share[g, x] += len(here)
                out.append([g, order, s, sum(not f[1] & upto for f in mine), len(here), sum(x in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)])
    return [(*r, share[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit_of_edge_rows(spark, edge):
    labels = [(9004, 1, 0, "x"), (9004, 0, 1, "x"), (9005, 1, None, "x"), (9006, None, 1, None), (None, 1, 1, "x"), (1, 1, 1, "x")]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in edge.collect()]
    found = op11.audit(edge.repartition(3), spark.createDataFrame(labels, LABELS))
    assert Counter(map(tuple, found.collect())) == Counter(plain_audit(rows, labels))


def test_audit_of_nothing(spark, empty):
    assert op11.audit(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_audit_deals_texts_once(edge):
    """The word branch has one exchange, by document; words are never shuffled."""
    plan = op11.word_counts(edge)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def plain_middle(i, text, sentinels=("<P>", "<S>", "<M>"), seed=7, rate=100, first=50):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in sentinels) or h3 % 100 >= rate:
        return i, n, "plain", None, None, t
    one, two, three = sentinels
    if h4 % 100 < first:
        return i, n, "spm", len(p), len(m), two + s + one + p + three + m
    return i, n, "psm", len(p), len(m), one + p + two + s + three + m


AWKWARD = ["", None, "\n", "\n\n\n", "a", "a\nb\n", "a\nb\nc", "x <P> y", "<<S>", "<M", "a<P\nb>", "é\nü\n\r\n😀z\n", "<P<S\n<M\n", "\n".join(f"line {k} ñ" for k in range(9000)), "word " * 60_000 + "\nend"]


def test_middle(spark, edge):
    rows = [(i, t) for i, t in enumerate(AWKWARD * 3)] + [(r["doc_id"], r["text"]) for r in edge.collect()]
    docs = spark.createDataFrame([(i, t, "f", 1, "o") for i, t in rows], "doc_id long, text string, form string, n int, other string").repartition(3)
    expected = [plain_middle(*r) for r in rows]
    out = op13.transform(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "other"]
    assert Counter(map(tuple, out.drop("other").collect())) == Counter(expected)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, op13.report(docs).collect())) == Counter((*e[:5], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, rows))


def test_middle_with_other_settings(spark):
    marks = ("[[a", "[[b", "]]")
    rows = [(i, t) for i, t in enumerate(["k[[\nl[[\nm", "k[[al", "p\nq\nr]]", "p\n\nq[", "ends [\n[", "x\ny\nz"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = op13.transform(docs, sentinels=marks, seed=11, rate=60, suffix_first=20).withColumn("back", op13.restored(F.col("output"), F.col("form"), marks)).collect()
    assert sorted(tuple(r)[:6] for r in out) == sorted(plain_middle(i, t, marks, 11, 60, 20) for i, t in rows)
    assert {(r["doc_id"], r["back"]) for r in out} == set(rows)


def test_middle_of_nothing(empty):
    assert op13.report(empty).count() == 0
    with pytest.raises(ValueError):
        op13.build(("a\nb", "c", "d"))
    with pytest.raises(ValueError):
        op13.transform(empty, sentinels=("<P>", "<P>>", "x"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aP<S>M\né😀[", max_size=40), max_size=12), st.integers(1, 64))
def test_scan_of_blocks_and_lanes(texts, block):
    """Counts and unit begins are those of regular expressions, however the buffer is cut into blocks and lanes."""
    buf, off = tn.text_bytes(pa.array(texts, pa.string()))
    table = op13.build()
    before = op13.BLOCK_BYTES
    op13.BLOCK_BYTES = block
    try:
        units = op13.Units(table, buf, off)
    finally:
        op13.BLOCK_BYTES = before
    assert units.units.tolist() == [len(UNIT.findall(t)) for t in texts]
    assert units.chars.tolist() == [len(t) for t in texts]
    assert units.sentinels.tolist() == [len(re.findall("<[PSM]>", t)) for t in texts]
    half = units.units // 2
    assert (units.cut(half) - off[:-1]).tolist() == [len("".join(UNIT.findall(t)[: len(UNIT.findall(t)) // 2]).encode()) for t in texts]


def test_lanes_of_a_long_text():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ab<PSM>\né"), 200_000))
    buf, off = tn.text_bytes(pa.array([text, "", text[:1000]]))
    units = op13.Units(op13.build(), buf, off)
    assert units.units.tolist() == [len(UNIT.findall(t)) for t in (text, "", text[:1000])]
    assert units.sentinels.tolist() == [len(re.findall("<[PSM]>", t)) for t in (text, "", text[:1000])]
