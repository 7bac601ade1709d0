"""The pipeline against a plain version of its five stages."""

import math
import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loamstone.llm import op02_pfair_mixing as op02

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def good(text):
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = len(lines) - len(set(lines))
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and 100 * symbols <= 20 * len(words) and 100 * again <= 60 * len(lines) and 1.5 * len(words) <= chars <= 25 * len(words)


def without_near_copies(docs):
    sets = {}
    for i, t, _ in docs:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    leader = {i: i for i in sets}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 180 * both >= 80 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                leader[max(x, y)] = min(x, y)
    return [d for d in docs if find(d[0]) == d[0]]


def mixed(docs):
    """Earliest deadline first, slot by slot."""
    queue = {}
    for i, t, s in sorted(docs, key=lambda d: d[0]):
        queue.setdefault(s, []).append((i, t))
    period, slots = op02.PERIOD, op02.slots_of({s: len(q) ** op02.TEMPERATURE for s, q in queue.items()})
    blocks = {s: [q[k : k + op02.BLOCK_ROWS] for k in range(0, len(q), op02.BLOCK_ROWS)] for s, q in queue.items()}
    names = sorted(queue)
    given, out, slot = dict.fromkeys(names, 0), [], 0
    while any(given[s] < len(blocks[s]) for s in names):
        ready = [(math.ceil((given[s] + 1) * period / slots[s]), names.index(s), s) for s in names if given[s] * period // slots[s] <= slot]
        if ready:
            s = min(ready)[2]
            if given[s] < len(blocks[s]):
                out += blocks[s][given[s]]
            given[s] += 1
        slot += 1
    return out


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = without_near_copies([d for d in docs if good(d[1] or "")])
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = BENCH_WORD.findall(low(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}

    def clean(text):
        w = BENCH_WORD.findall(low(text))
        return not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for i, t in mixed([d for d in docs if clean(d[1])]):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    found = [tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(found) == sorted(expected) and len(expected) > 50
