"""Every operator against a plain version over a small table that has all edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamstone.llm import op02_pfair_mixing as op02
from loamstone.llm import op03_token_output as op03
from loamstone.llm import op04_disclosure as op04
from loamstone.llm import op05_jump_shards as op05
from loamstone.llm import op06_jaccard_join as op06
from loamstone.llm import op07_class_lm as op07
from loamstone.llm import op08_quality_rules as op08
from loamstone.llm import op09_decontaminate as op09

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same(df, expected):
    """Equal rows, with repeats."""
    assert Counter(map(tuple, df.collect())) == Counter(expected)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_output(docs, rows, name, tmp_path):
    """The second tokenizer keeps case and white space; its file also asks for a truncation, which whole texts do not take."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    asks = Tokenizer.from_file(public_tokenizers.path(name))
    asks.enable_truncation(8)
    asks.save(str(tmp_path / name))
    expected, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    same(op03.encode_and_read(docs, str(tmp_path / name)), expected)


def test_personal_data(docs, rows):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def spans(text):
        found = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        found += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
            if 12 <= len(digits) <= 19 and total % 10 == 0:
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(found)

    expected = []
    for i, t in rows:
        found = spans(t or "")
        line = ",".join(f"{op04.KINDS[k]}:{a}:{b}" for a, k, b in found)
        expected.append((i, *(sum(s[1] == k for s in found) for k in range(4)), hashlib.sha256(line.encode()).hexdigest()))
    result = op04.find(docs).cache()
    same(result.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), expected)


def test_jaccard_join(docs, rows):
    sets, words = [], []
    for _, t in rows:
        w = tuple(WORD.findall(low(t)))
        words.append(w)
        sets.append({w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set())
    leader = list(range(len(rows)))

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]) or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                leader[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    expected = [(i, len(sets[k]), smallest.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]
    same(op06.classes(docs), expected)


@pytest.mark.parametrize("list_rows", [op06.LIST_ROWS, 7])
def test_jaccard_join_of_large_groups(spark, monkeypatch, list_rows):
    """Near copies of one text, which differ pairwise by more than a copy differs from it, and texts that share a passage."""
    import random

    monkeypatch.setattr(op06, "LIST_ROWS", list_rows)
    random.seed(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for n in range(400):
        copy = list(base)
        for k in random.sample(range(5, 145), 1 + n % 2):
            copy[k] = f"x{n}y{k}"
        texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{n}r{i}" for i in range(6 + n % 9)) for n in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in op06.classes(docs).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    leader = list(range(len(texts)))

    def find(x):
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 180 >= 80 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                leader[max(x, y)] = min(x, y)
    assert found == {i: find(i) for i in range(len(texts))}


def test_jaccard_join_of_an_id_with_two_texts(spark):
    """Rows of one id are one node, whichever of its texts links."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    table = spark.createDataFrame([(5, a), (5, b), (2, b), (9, a), (7, c), (None, c), (None, a)], "doc_id long, text string")
    assert Counter(map(tuple, op06.classes(table).collect())) == Counter([(5, 26, 2), (5, 26, 2), (2, 26, 2), (9, 26, 2), (7, 26, 7), (None, 26, 7), (None, 26, 2)])


def test_class_lm(docs, rows):
    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    base = sorted(((str(i), h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (i, _), h, t in zip(rows, held, tokens)))
    found = op07.score(docs).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found)
    assert [g[:5] for g in got] == [b[:5] for b in base]
    assert all(abs(g[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for g, b in zip(got, base))
    # the class model explains held-out texts better than word counts do
    assert sum(r["score"] for r in found if r["held_out"]) > sum(r["base_score"] for r in found if r["held_out"])


def test_class_lm_scores(docs, rows):
    """Classes of the other words by their neighbours, class bigrams and scores, by plain loops over the texts; the head's classes are the operator's."""
    import numpy as np

    from loamstone.llm import textnum as tn

    head_words = 150
    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]
    trained = [t for (i, _), t in zip(rows, tokens) if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in trained for w in t)

    def number(word):
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        return tn.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]

    numbers = {w: number(w) for w in counts if w is not None}
    chosen = sorted(numbers, key=lambda w: (-counts[w], int(numbers[w].view(np.int64))))[:head_words]
    place = {w: k for k, w in enumerate(sorted(chosen, key=lambda w: int(numbers[w])))} | {None: head_words}
    pairs = np.zeros((head_words + 1, head_words + 1))
    for t in trained:
        for before, word in zip([None, *t], t):
            if before in place and word in place:
                pairs[place[before], place[word]] += 1
    own = op07.exchange(pairs)
    of = {w: int(own[k]) for w, k in place.items()}
    after, ahead = {}, {}
    for t in trained:
        for before, word, next_ in zip([None, *t], t, [*t[1:], None]):
            if word not in place and counts[word] >= op07.MIN_COUNT:
                if next_ in place:
                    after.setdefault(word, Counter())[of[next_]] += 1
                if before in place:
                    ahead.setdefault(word, Counter())[of[before]] += 1
    head_grid = np.zeros((op07.CLASSES, op07.CLASSES))
    for a in place:
        for b in place:
            head_grid[of[a], of[b]] += pairs[place[a], place[b]]
    grid, found = head_grid, {}
    for sweep in range(op07.TAIL_SWEEPS):
        smooth = grid + op07.FLOOR
        rows_, cols = smooth.sum(axis=1), smooth.sum(axis=0)
        for w in set(after) | set(ahead):
            gains = []
            for c in range(op07.CLASSES - 1):
                gain = sum(n * math.log(smooth[c, x] / rows_[c]) for x, n in after.get(w, {}).items())
                gains.append(gain + sum(n * math.log(smooth[x, c] / cols[c]) for x, n in ahead.get(w, {}).items()))
            best = max(gains)
            found[w] = next(c for c, g in enumerate(gains) if g >= best - 1e-9)
        grid = head_grid.copy()
        for w, c in found.items():
            for x, n in after.get(w, {}).items():
                grid[c, x] += n
            for x, n in ahead.get(w, {}).items():
                grid[x, c] += n
    of |= found
    rare = op07.RARE
    steps, mass, words = Counter(), Counter(), Counter()
    for t in trained:
        for before, word in zip([None, *t], t):
            steps[of.get(before, rare), of.get(word, rare)] += 1
    for w, n in counts.items():
        mass[of.get(w, rare)] += n + op07.ADD
    once = max(op07.ADD, sum(n == 1 for n in counts.values()))
    mass[rare] += once
    total, size = sum(steps.values()), op07.ALL_CLASSES
    before_, after_ = Counter(), Counter()
    for (x, y), n in steps.items():
        before_[x] += n
        after_[y] += n

    def log_p(t):
        p = 0.0
        for a, b in zip([None, *t], t):
            x, y = of.get(a, rare), of.get(b, rare)
            p += math.log10((steps[x, y] + op07.BACK * (after_[y] + 1) / (total + size)) / (before_[x] + op07.BACK))
            p += math.log10((counts[b] + op07.ADD if counts[b] else once) / mass[y])
        return p

    expected = sorted((str(i), log_p(t)) for (i, _), t in zip(rows, tokens))
    got = sorted((str(r["doc_id"]), r["score"]) for r in op07.score(docs, head_words).collect())
    assert [i for i, _ in got] == [i for i, _ in expected] and len(found) > 100
    assert all(abs(x - y) < 1e-6 * max(1, abs(y)) for (_, x), (_, y) in zip(got, expected))


def test_class_lm_is_a_distribution():
    """Emissions of a class and one unseen word sum to one, and so do transitions."""
    import numpy as np

    rng = np.random.default_rng(1)
    grid = rng.integers(0, 50, (op07.ALL_CLASSES, op07.ALL_CLASSES)).astype(float)
    of, totals = rng.integers(0, op07.ALL_CLASSES, 3000), rng.integers(1, 9, 3000)
    sums = [np.bincount(of, weights=x, minlength=op07.ALL_CLASSES) for x in (totals, np.ones(3000), totals == 1)]
    model = op07.Model(grid, *sums)
    assert np.allclose((10**model.step).sum(axis=1), 1)
    shares = np.bincount(of, weights=10 ** model.emissions(totals, of), minlength=op07.ALL_CLASSES)
    shares[op07.RARE] += 10 ** model.emissions(np.array([0]), np.array([op07.RARE]))[0]
    assert np.allclose(shares, 1)


def test_exchange_finds_planted_classes():
    import numpy as np

    rng = np.random.default_rng(3)
    n = 41
    pairs = np.zeros((n, n))
    for a in range(40):
        for b in range(40):
            pairs[a, b] = rng.poisson(20 if (a % 4 + 1) % 4 == b % 4 else 1)
    classes = op07.exchange(pairs, classes=5)
    assert len({tuple(sorted(np.flatnonzero(classes == c) % 4)) for c in range(4)}) == 4
    assert all(len(set(np.flatnonzero(classes == c) % 4)) == 1 for c in range(4))


def test_quality_rules(docs, rows):
    expected = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if counts[g] > 1:
                covered |= {k, k + 1, k + 2}
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        chars = sum(map(len, words))
        more = 100 * symbols > 20 * len(words) or 100 * again > 60 * sum(bool(WORD.search(x)) for x in t.split("\n")) or not 1.5 * len(words) <= chars <= 25 * len(words)
        expected.append((i, len(words), chars, symbols, again, len(covered), failed, not failed and not more))
    same(op08.score(docs).drop("rejected_by"), expected)
    kept = Counter(e[0] for e in expected if e[-1])
    assert Counter(r["doc_id"] for r in op08.apply(docs).collect()) == kept


def test_decontamination(spark, docs, rows):
    items = [("a", "W1 w2 w3, w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("b", "one two"), ("c", None), ("d", "..."), ("e", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), ("f", "no such words here at all my dear good old friend")]
    benchmark = spark.createDataFrame(items, "item_id string, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("cast(item_id as string) as item_id", "text"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in benchmark.collect():
        w = word.findall(low(r["text"]))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(r["item_id"])
    sizes = {len(w) for w in windows}
    expected = []
    for i, t in rows:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= items_
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    same(op09.report(docs, benchmark), expected)
    clean = Counter(e[0] for e in expected if not e[-1])
    assert Counter(r["doc_id"] for r in op09.apply(docs, benchmark).collect()) == clean


def test_shards(docs, rows):
    found = op05.assign(docs, 40).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({(r["doc_id"], r["shard"]) for r in found}) == len({r["doc_id"] for r in found})


def test_shards_are_even_and_move_little(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40_000).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id")
    found = op05.assign(ids, 40).select("shard", "grown_shard").collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(sizes) == 40 and max(sizes.values()) < 1.2 * min(sizes.values())
    assert 0.8 < sum(r["shard"] != r["grown_shard"] for r in found) / (40_000 / 41) < 1.2


def test_mixing(docs, rows):
    block = 4
    found = op02.plan(docs, block_rows=block, period=60).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    slots = {}
    for r in found:
        assert r["release"] <= r["slot"] < r["deadline"]
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(s) == 1 for s in slots.values())
    order = [next(iter(slots[s])) for s in sorted(slots)]
    assert {(r["source"], r["block"]): r["position"] for r in found} == {b: k for k, b in enumerate(order)}
    assert Counter((r["source"], r["block"], r["offset"]) for r in found).most_common(1)[0][1] == 1


def test_mixing_deviates_by_less_than_a_block(spark):
    sources = [(i, "t", s) for s, n in (("a", 900), ("b", 500), ("c", 250), (None, 80)) for i in range(n)]
    docs = spark.createDataFrame(sources, "doc_id long, text string, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    found = op02.plan(docs, weights, block_rows=1, period=100).collect()
    by_slot = sorted((r["slot"], r["source"]) for r in found if r["slot"] < 1600)
    given = Counter()
    for slot, source in by_slot:
        given[source] += 1
        assert all(abs(given[s] - w * (slot + 1)) < 1 for s, w in weights.items())
    assert given["a"] == 800


def test_mixed_keeps_rows_in_order(spark, docs):
    from loamstone.llm.common import stored

    spread = stored(op02.mixed(docs, block_rows=4, period=60), "mixed")
    assert Counter(r["doc_id"] for r in spread.collect()) == Counter(r["doc_id"] for r in docs.collect())
    by_id = {r["doc_id"]: (r["position"], r["offset"]) for r in op02.plan(docs, block_rows=4, period=60).collect() if r["doc_id"] is not None and r["doc_id"] < 9000}
    written = [r["doc_id"] for r in spread.orderBy(*op03.written_order(spread)).collect() if r["doc_id"] in by_id]
    assert written == sorted(written, key=by_id.get)


def test_mixing_keeps_irrational_weights_over_many_blocks(spark):
    """Over tens of thousands of slots, of which many ranges are filled apart; a weight below 1 / 720 gets no more than itself."""
    from pyspark.sql import functions as F

    ratios = {"a": math.pi, "b": math.e, "c": math.sqrt(2), "d": 1 / 997}
    weights = {s: w / sum(ratios.values()) for s, w in ratios.items()}
    sizes = {s: int(w * 30_000) for s, w in weights.items()}
    docs = spark.range(sum(sizes.values())).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    upto, source = 0, F.lit(None)
    for s, n in sizes.items():
        source = F.when((F.col("doc_id") >= upto) & (F.col("doc_id") < upto + n), s).otherwise(source)
        upto += n
    found = op02.plan(docs.withColumn("source", source), weights, block_rows=1).select("slot", "source", "release", "deadline", "block", "position").collect()
    assert len(found) == upto
    assert all(r["release"] <= r["slot"] < r["deadline"] and abs(r["release"] - r["block"] / weights[r["source"]]) < 1.001 for r in found)
    by_slot = {r["slot"]: r for r in found}
    assert len(by_slot) == upto
    given, ordered = Counter(), sorted(by_slot)
    for slot in range(29_000):
        given[by_slot[slot]["source"]] += 1
        assert all(abs(given[s] - w * (slot + 1)) < 1.000001 for s, w in weights.items())
    assert [by_slot[s]["position"] for s in ordered] == list(range(upto))
    assert not set(op02.slots_of(weights, op02.unit_of(weights, sizes)).values()) & {0}


def test_mixing_with_shuffled_blocks(spark, docs, monkeypatch):
    expected = Counter(map(tuple, op02.plan(docs, block_rows=4).collect()))
    monkeypatch.setattr(op02, "BROADCAST_BLOCKS", 0)
    assert Counter(map(tuple, op02.plan(docs, block_rows=4).collect())) == expected
