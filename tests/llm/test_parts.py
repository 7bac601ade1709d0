"""Codecs, templates, the toxicity machine, and edge cases of the operators' own interfaces."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import common, op01_toxicity, op02_pfair_mixing, op03_token_output, op04_disclosure, op05_jump_shards, op06_jaccard_join, op07_class_lm, op08_quality_rules, op09_decontaminate, op10_chat_format

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_segments_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    segment = op03_token_output.pack(ids)
    assert (op03_token_output.unpack(segment) == ids).all()
    for block in range(-(-len(ids) // op03_token_output.BLOCK)):
        assert (op03_token_output.unpack_block(segment, block) == ids[block * 128 : block * 128 + 128]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|turn|>", "<|end|>", "</s>", "[INST]", "␛", "[", "<", "a", "\n", "s>"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control(text):
    template = op10_chat_format.Template()
    coded = op10_chat_format.escaped(text, template.pattern())
    assert op10_chat_format.unescaped(coded) == text
    assert not any(c in coded for c in template.control)


def test_chat(spark):
    rows = [(1, 0, "system", "be <|end|> kind"), (1, 1, "user", None), (1, 2, "assistant", "␛[INST]"), (1, 3, "user", "more"), (1, 4, "assistant", ""), (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 0, None, "x"), (None, 0, "user", "y"), (4, None, "user", "z"), (4, 0, "assistant", "long " * 50_000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r["conv_id"]: r for r in op10_chat_format.format_and_read(table).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, 3, None, 4):
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1] or "", v[2] or ""))
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns))
        assert got[conv]["loss_sha256"] == sha("".join(x or "" for _, r, x in turns if r == "assistant"))
    assert got[1]["valid"] and got[4]["valid"] and not got[2]["valid"] and not got[3]["valid"] and not got[None]["valid"]
    assert op10_chat_format.format_and_read(table.limit(0)).count() == 0


def _sentences(rng, insult, n):
    parts = ["ba", "ro", "tin", "sel", "mu", "fa", "dor", "vi"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    if insult:
        words[rng.randrange(n)] = insult
    return " ".join(words) + "."


def test_toxicity_learns_and_tolerates_insertions():
    rng = random.Random(4)
    insults = ["grumbix", "zottel", "kwackhead"]
    texts = [_sentences(rng, rng.choice(insults) if k % 2 else None, rng.randint(8, 60)) for k in range(600)]
    model = op01_toxicity.train(texts, np.array([k % 2 == 1 for k in range(600)]))
    table = model.table()

    def score(text):
        return float(model.probability(np.array([op01_toxicity.window_sums(op01_toxicity.places(op01_toxicity.symbols(text), table)).max()]))[0])

    assert all(score(_sentences(rng, i, 40)) >= 0.5 for i in insults)
    assert all(score(_sentences(rng, i, 40)) >= 0.5 for i in ("grum-bix", "zot*tel", "g.r.u.m.b.i.x", "grumbixes"))
    clean = [score(_sentences(rng, None, 40)) for _ in range(200)]
    assert sum(s >= 0.5 for s in clean) <= 2
    assert score("") < 0.5


def _kernel_features(s):
    """Every subsequence of four symbols whose steps skip at most one symbol, by its price; and where it starts."""
    found = {}
    for i in range(len(s)):
        for j in range(i + 1, min(i + 3, len(s))):
            for k in range(j + 1, min(j + 3, len(s))):
                for m in range(k + 1, min(k + 3, len(s))):
                    key = (i, tuple(int(x) for x in (s[i], s[j], s[k], s[m])))
                    found[key] = found.get(key, 0) + op01_toxicity.DECAY ** (m - i - 3)
    return found


def _kernel(a, b):
    sums = []
    for s in (a, b):
        total = {}
        for (_, f), v in _kernel_features(s).items():
            total[f] = total.get(f, 0) + v
        sums.append(total)
    return sum(v * sums[1].get(f, 0) for f, v in sums[0].items()) / np.sqrt(len(a) * len(b))


def test_subsequence_kernel_and_nystroem_against_plain_loops():
    words = ["grumbix", "grum-bix", "zottel", "otter", "a", "zot tel", "kwackhead", "quack"]
    marks = [op01_toxicity.symbols(w) for w in words]
    plain = np.array([[_kernel(a, b) for b in marks] for a in marks])
    at, phi, whiten = op01_toxicity.nystroem(marks)
    assert np.allclose(phi @ phi.T, plain, atol=1e-4)
    mapped = plain @ whiten
    assert np.allclose(mapped @ mapped.T, plain, atol=1e-3)  # the landmarks keep their kernel
    # gaps keep most of an insult's subsequences
    assert plain[0, 1] > 0.9 * plain[0, 0] > 10 * plain[0, 2]


def test_window_scores_against_plain_loops():
    rng = random.Random(9)
    texts = [_sentences(rng, "grumbix" if k % 2 else None, 12) for k in range(60)]
    model = op01_toxicity.train(texts, np.array([k % 2 == 1 for k in range(60)]))
    weight = dict(zip(model.at.tolist(), model.weight.tolist()))
    for text in [*texts[:4], "", "grumbix", "x y"]:
        s = op01_toxicity.symbols(text)
        values = [0.0] * len(s)
        for (start, f), v in _kernel_features(s).items():
            values[start] += v * weight.get(((f[0] << 5 | f[1]) << 5 | f[2]) << 5 | f[3], 0.0)
        plain = max(sum(values[a : a + op01_toxicity.PIECE]) for a in range(max(1, len(s) - op01_toxicity.PIECE + 1)))
        assert abs(op01_toxicity.window_sums(op01_toxicity.places(s, model.table())).max() - plain) < 1e-3 * max(1, abs(plain))


def test_toxicity_trains_on_whole_texts(spark):
    """What makes a long text toxic may stand anywhere in it; of the texts of one id one counts."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        filler = [_sentences(rng, None, 30) for _ in range(60)]
        if k % 2:
            filler[rng.randrange(60)] = _sentences(rng, "kwackhead", 30)
        rows += [(k, " ".join(filler))] * (1 + (k == 3))
        labels.append((k, k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op01_toxicity.score(docs, op01_toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 50 and sum((r["predicted"] == 1) == (r["doc_id"] % 2 == 1) for r in held) >= 0.95 * len(held)


def test_toxicity_table(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = op01_toxicity.fit(docs, labels)
    found = op01_toxicity.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert op01_toxicity.score(empty, model).count() == 0
    none = op01_toxicity.fit(docs, labels.limit(0))
    assert max(r["score"] for r in op01_toxicity.score(docs, none).collect()) < 1e-9


def _disclosure_rows():
    """Values with terms that stand far from them, common words, copies of one text, and values of one text."""
    rng = random.Random(2)
    common_words = [f"common{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(600):
        words = [rng.choice(common_words) for _ in range(90)]
        if k % 50 == 0:
            words[5:5] = ["jane.doe@example.com"]
            words[80:80] = ["Quixotically"]  # far from the address
        if k % 60 == 7:
            words[3:3] = ["10.1.2.3", "Ostrava7", "+1 (212) 555-0100"]
        if k in (100, 101, 102):
            words += ["ostrava7"] * 2  # now and then without the value
        if k in (303, 304):
            words += ["mail", f"solo{k}@example.com", "lonely"]
        if k % 9 == 4:
            words += ["every@example.com", f"often{k % 2}"]
        rows.append((k, " ".join(words) + f" unique{k}"))
    rows += [(1000 + k, "one text, 4111 1111 1111 1111, copied with its zyzzyva") for k in range(30)]
    return [*rows, (2000, "0" * 5000 + ".1.2.3 and 00010.0.0.0000000001"), (2001, "1" * 5000 + ".1.2.3"), (2002, None), (None, rows[50][1]), (2003, "jane.doe@example.com QUIXOTICALLY quixotically")]


def test_disclosure_of_all_spans(spark):
    """Every span against a plain version with sets of documents."""
    import math
    import re

    rows = _disclosure_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    term, upper = re.compile("[0-9A-Za-z\x80-\U0010ffff]+"), re.compile("[A-Z]")
    base = [op04_disclosure.base_spans(t or "") for _, t in rows]
    texts = [t or "" for _, t in rows]
    fold = lambda t: upper.sub(lambda m: m[0].lower(), t)
    value = lambda t, s: (s[2], t[s[0] : s[1]].lower() if s[2] in ("email", "ip") else re.sub("[^0-9]", "", t[s[0] : s[1]]))
    values = [{value(t, s) for s in b} for t, b in zip(texts, base)]
    anywhere = [{fold(m[0]) for m in term.finditer(t)} for t in texts]
    free = [[m for m in term.finditer(t) if not any(a < m.end() and m.start() < b for a, b, _ in spans)] for t, spans in zip(texts, base)]
    told, n = {}, len(rows)
    for e in set().union(*values):
        holds = [k for k in range(n) if e in values[k]]
        bits = -math.log2(len(holds) / n)
        for t in {fold(m[0]) for k in holds for m in free[k]}:
            both = [k for k in holds if any(fold(m[0]) == t for m in free[k])]
            different = len({texts[k] for k in both})
            left = -math.log2(len(both) / sum(t in x for x in anywhere) * different / (different + op04_disclosure.SMOOTH))
            if left <= min(op04_disclosure.LEFT_BITS, op04_disclosure.LEFT_SHARE * bits):
                told.setdefault(e, set()).add(t)
    expected = []
    for (i, _), spans, vs, terms in zip(rows, base, values, free):
        mine = set().union(*[told.get(e, set()) for e in vs])
        found = [(a, "email ip card phone term".split().index(k), b) for a, b, k in spans] + [(m.start(), 4, m.end()) for m in terms if fold(m[0]) in mine]
        expected.append((i, ",".join(f"{op04_disclosure.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))))
    got = [(r["doc_id"], r["spans"]) for r in op04_disclosure.find(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert "term" in dict(got)[50] and "term" not in dict(got)[303] and "term" not in dict(got)[1000]
    assert dict(got)[2000] == "ip:0:5006,ip:5011:5031" and dict(got)[2001] == ""


def test_sanitised_documents(spark, monkeypatch):
    """A rare word of all documents with one address goes wherever it stands; common words stay; and the same beyond the bound for broadcasts."""
    rows = _disclosure_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, h int, terms string")
    clean = {r["doc_id"]: r["text"] for r in op04_disclosure.sanitised(docs).collect()}
    before = dict(rows)
    assert "uixotically" not in clean[50] and "[email]" in clean[50] and "common" in clean[50] and clean[51] == before[51]
    assert clean[2003].strip() == "[email]" and clean[2002] is None and "zyzzyva" in clean[1000]
    monkeypatch.setattr(op04_disclosure, "BROADCAST_ROWS", -1)
    assert {r["doc_id"]: r["text"] for r in op04_disclosure.sanitised(docs).collect()} == clean


def test_cascade_order_does_not_change_the_verdict(docs):
    rules = op08_quality_rules.RULES
    a = {(r["doc_id"], r["kept"]) for r in op08_quality_rules.score(docs, rules).collect()}
    b = {(r["doc_id"], r["kept"]) for r in op08_quality_rules.score(docs, rules[::-1]).collect()}
    assert a == b
    estimates = op08_quality_rules.estimate(docs)
    assert [e.per_cost for e in estimates] == sorted((e.per_cost for e in estimates), reverse=True)


def test_extra_columns_and_empty_tables(spark, edge, empty):
    """Operators that return documents keep every column; all of them take an empty table."""
    benchmark = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    for apply in (op08_quality_rules.apply, op06_jaccard_join.apply, lambda d: op09_decontaminate.apply(d, benchmark), op02_pfair_mixing.mixed, op04_disclosure.sanitised):
        assert apply(edge).columns == edge.columns
        assert apply(empty).count() == 0
    for query in (op02_pfair_mixing.plan, lambda d: op03_token_output.encode_and_read(d, TOKENIZER), op04_disclosure.find, lambda d: op05_jump_shards.assign(d, 40), op06_jaccard_join.classes, op07_class_lm.score, op08_quality_rules.score, lambda d: op09_decontaminate.report(d, benchmark)):
        assert query(empty).count() == 0
        assert query(edge).count() == edge.count()


def test_weights():
    slots = op02_pfair_mixing.slots_of({"a": 0.9, "b": 0.0999, "c": 0.0001}, 50)
    assert sum(slots.values()) == 50 and slots["c"] == 1
    with pytest.raises(ValueError):
        op02_pfair_mixing.slots_of({"a": 0.0})


def test_numbering_splits_groups(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")))
    found = common.numbered(rows, ["g"], [F.col("id")], rows_per_chunk=50).collect()
    for g in (None, "x"):
        assert sorted(r["n"] for r in found if r["g"] == g) == list(range(sum(r["g"] == g for r in found)))


def test_written_shards(spark, docs, tmp_path):
    op05_jump_shards.write_shards(docs, str(tmp_path / "shards"), 5)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def _shuffled_bytes(spark):
    time.sleep(1)  # the listener is asynchronous
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_decontamination_by_many_windows(spark, docs, monkeypatch):
    """Beyond the bound for broadcasts the report is the same, and a long text is not shuffled once per word."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(3000)]
    long = spark.createDataFrame([(70_000, " ".join(words)), (70_001, " ".join(words[:5] * 3)), (70_001, " ".join(words[:5] * 3)), (None, words[7]), (70_002, "")], "doc_id long, text string")
    items = [("a", " ".join(words[995:1020])), ("b", " ".join(words[2990:])), ("c", words[7]), ("d", " ".join(words[:5] * 2)), ("e", " ".join(words[2995:] + words[:5]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("cast(item_id as string) as item_id", "text"))
    both = docs.select("doc_id", "text").unionByName(long)
    expected = sorted(map(repr, op09_decontaminate.report(both, benchmark).collect()))
    kept = sorted(repr(r["doc_id"]) for r in op09_decontaminate.apply(both, benchmark).collect())
    monkeypatch.setattr(op09_decontaminate, "BROADCAST_WINDOWS", 0)
    before = _shuffled_bytes(spark)
    assert {r["doc_id"]: r["n_hit"] for r in op09_decontaminate.report(long, benchmark).collect()} == {70_000: 36, 70_001: 15, 70_002: 0, None: 1}
    assert _shuffled_bytes(spark) - before < 5_000_000
    assert sorted(map(repr, op09_decontaminate.report(both, benchmark).collect())) == expected
    assert sorted(repr(r["doc_id"]) for r in op09_decontaminate.apply(both, benchmark).collect()) == kept


def test_words_that_a_worker_remembers_take_a_bounded_share_of_its_executor():
    import sys

    import pyarrow as pa

    op3 = op03_token_output
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[k % 26] + letters[k // 26 % 26] + letters[k // 676 % 26] + letters[k // 17_576 % 26] for k in range(400_000)]
    op3._remembered.clear()
    encoder = op3.Encoder(TOKENIZER)
    for at in range(0, len(words), 50_000):
        encoder.encode(pa.array([" ".join(words[at : at + 50_000])]), 2)
    held = sum(sys.getsizeof(g) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in g.items()) for g in encoder._known)
    op3._remembered.clear()
    assert held < 40e6


def test_many_words_are_remembered_and_old_ones_forgotten(monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    op3 = op03_token_output
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[k // 26**i % 26] for i in range(4)) for k in range(300_000)]
    parts = [pa.array([" ".join(words[at : at + 50_000])]) for at in range(0, len(words), 50_000)]
    op3._remembered.clear()
    encoder = op3.Encoder(TOKENIZER)
    first = [encoder.encode(part, 2)[0].tolist() for part in parts]
    encoder._model = None  # a word that comes again is not encoded again
    assert [encoder.encode(part, 2)[0].tolist() for part in parts] == first
    op3._remembered.clear()
    monkeypatch.setattr(op3, "REMEMBERED", 40)
    encoder, whole, rng = op3.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(5)
    for _ in range(40):
        texts = ["".join(rng.choices(["Ab", "abc", "é", "É", "ß", ".", ",", " ", " ", "\n", "'s", "9", "!", "\t", "q" * rng.randint(1, 9)], k=rng.randint(0, 30))) for _ in range(8)]
        ids, n = encoder.encode(pa.array(texts), 2)
        assert ids.tolist() == [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]
    assert len(encoder._known[0]["words"]) < 300
    op3._remembered.clear()
