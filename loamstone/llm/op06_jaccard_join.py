"""Exact Jaccard self-join of documents' word-shingle sets, with adaptive multi-match prefixes.

All sets are ordered by one global order: shingles of fewer documents first. If two sets of n words of overlap at least
tau, then their prefixes of n - tau + l shingles share at least l of them. Each document takes its own l: where its prefix
of l = 1 costs many candidates, the prefix grows by l - 1 and a partner must share l prefix shingles before verification.

How a large group is kept from meeting in all pairs: equal texts are one node from the start. In every posting list the
smallest member is a pivot, and the others are verified against it; the links found make classes. Only members of
different classes then need to meet, class bounds first, and those pairs are all tried. Links inside a class add nothing
to a component, so the components are exact while the pairs stay few.

Shingles in at least one of ``HOT_SHARE`` documents of some slice are counted apart and broadcast (their number is bounded
by the mean set size times ``HOT_KEEP``, whatever the corpus size), so that no task receives the posting list of a
shingle that every document holds just to count it.

A posting list's length is counted before anything is joined by it: lists of more than ``LIST_ROWS`` members are dealt to as many tasks as
they need, both where members meet the pivot and where classes meet.

Shingles and texts are compared by 64-bit hashes; while shingles are counted, six bytes of a hash besides its bucket's bits
tell them apart, and buckets grow with the corpus, so that two shingles of a bucket are mixed up with the chance of
``BUCKET_SHINGLES`` in 2 ** 48 at any size. That costs a candidate more, which verification by whole hashes rejects. Defined cases: null, empty and wordless texts have the empty set and link
with nothing; texts of fewer words than a shingle have one shingle, their whole word sequence; repeated rows and equal texts
are linked; rows of one doc_id are one node; a row with a null doc_id takes the component of equal texts, and a text that has
only null ids links with nothing else; an empty table gives an empty
result; extra columns pass through ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import discard, stored
from .components import components

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 80
#: Largest number of shared prefix shingles that a document asks for.
MAX_MATCHES = 4
#: Candidates by a prefix of one match, per document, beyond which the prefix is lengthened by one, and again at each power.
COSTLY = 16
#: A shingle that one in so many documents of a slice holds is reported as locally frequent.
HOT_SHARE = 64
#: Of these, the ones whose reported counts reach one in so many of all documents are broadcast.
HOT_KEEP = 128
#: Added to a broadcast shingle's frequency, so that it comes after all others.
HOT = 1 << 40
#: Shingles per bucket of the counting step.
BUCKET_SHINGLES = 750_000
#: Most buckets that an int can number.
MAX_BUCKETS = 1 << 30
#: Members of a posting list that one task handles.
LIST_ROWS = 500
#: Ids of candidate documents that may be broadcast: 8 bytes each.
BROADCAST_IDS = 2_000_000
#: Parts that the rows of one text are dealt to.
SALTS = 256


def _sets(w: tn.Words) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Per text: its number, two hashes of its word sequence, and its sorted distinct shingles."""
    words = w.hashes(True)
    windows = tn.window_hashes(words, SHINGLE)
    for d in range(len(w.count)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if a == b:
            yield d, 0, 0, np.empty(0, np.uint64)
            continue
        own = words[a:b]
        k1 = tn.sequence_hash(own, 1)
        found = np.unique(windows[a : b - SHINGLE + 1]) if b - a >= SHINGLE else np.array([k1], dtype=np.uint64)
        yield d, k1, tn.sequence_hash(own, 2), found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tn.Words]]:
    for batch in batches:
        buf, off = tn.text_bytes(batch.column(1))
        for a, b in tn.slices(off):
            yield batch.slice(a, b - a), tn.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, and rows of locally frequent shingles (null key, the shingle in k1, its count in n_shingles)."""
    for part, w in _runs(batches):
        k1s, k2s, ns, distinct = [], [], [], {}
        for _, k1, k2, found in _sets(w):
            k1s.append(k1), k2s.append(k2), ns.append(len(found))
            distinct[k1] = found
        yield pa.RecordBatch.from_arrays([part.column(0), _signed(k1s), _signed(k2s), pa.array(ns, pa.int64()), pa.array([False] * len(ns))], ["doc_id", "k1", "k2", "n_shingles", "hot"])
        if len(distinct) >= HOT_SHARE:
            tokens, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            often = counts >= max(8, len(distinct) // HOT_SHARE)
            if often.any():
                n = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, part.column(0).type), _signed(tokens[often]), _signed(np.zeros(n)), pa.array(counts[often].astype(np.int64)), pa.array([True] * n)], ["doc_id", "k1", "k2", "n_shingles", "hot"])


def _prefix(n: np.ndarray | int):
    """Length of the prefix of one match: n - ceil(n * PERCENT / 100) + 1."""
    return n - -(-n * PERCENT // 100) + 1


def _deal(buckets: int, hot_tokens):
    """Shingles that are not hot, dealt to buckets by hash: one row per bucket and slice, with packed arrays."""
    bits = np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_tokens.value
        for part, w in _runs(batches):
            seen, keys, sizes, tokens = set(), [], [], []
            for _, k1, _, found in _sets(w):
                if len(found) and k1 not in seen:
                    seen.add(k1)
                    if len(hot):
                        found = found[~_among(found, hot)]
                    keys.append(k1), sizes.append(len(found)), tokens.append(found)
            if not keys:
                continue
            flat = np.concatenate(tokens)
            own = np.repeat(np.arange(len(keys)), sizes)
            bucket = (flat >> bits).astype(np.int64) if bits is not None else np.zeros(len(flat), np.int64)
            order = np.argsort(bucket, kind="stable")
            present, begin = np.unique(bucket[order], return_index=True)
            key_of = np.array(keys, dtype=np.uint64)
            rows = {"bucket": [], "docs": [], "sizes": [], "tokens": []}
            for b, lo, hi in zip(present.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                at = order[lo:hi]
                docs, n = np.unique(own[at], return_counts=True)
                rows["bucket"].append(b), rows["docs"].append(key_of[docs].tobytes()), rows["sizes"].append(n.astype(np.uint16 if n.max() < 65536 else np.uint32).tobytes())
                # the top bits are the bucket's; six bytes of the others are kept
                rows["tokens"].append(flat[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in ("docs", "sizes", "tokens")]], list(rows))

    return run


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def _counted(buckets: int):
    # bucket numbers are the top bits of a token; with the six bytes kept they make its identity
    shift = np.uint64(min(48, 64 - (buckets.bit_length() - 1)))

    def count(table: pa.Table) -> pa.Table:
        """Shingles of a bucket that two or more different texts hold: rows of (key, token, df)."""
        keys, tokens = [], []
        for docs, sizes, packed in zip(*(table.column(c) for c in ("docs", "sizes", "tokens"))):
            own = np.frombuffer(docs.as_buffer(), dtype=np.uint64)
            raw = sizes.as_buffer()
            n = np.frombuffer(raw, dtype=np.uint16 if raw.size == 2 * len(own) else np.uint32)
            body = np.frombuffer(packed.as_buffer(), dtype=np.uint8).reshape(-1, 6)
            wide = np.zeros((len(body), 8), dtype=np.uint8)
            wide[:, :6] = body
            tokens.append(wide.view(np.uint64)[:, 0]), keys.append(np.repeat(own, n))
        key, token = np.concatenate(keys), np.concatenate(tokens)
        del keys, tokens
        order = np.argsort(token, kind="stable")
        key, token = key[order], token[order]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        often = np.diff(np.r_[start, len(token)]) > 1  # most shingles end here
        keep = np.repeat(often, np.diff(np.r_[start, len(token)]))
        key, token = key[keep], token[keep]
        order = np.lexsort((key, token))
        key, token = key[order], token[order]
        if len(key):
            once = np.r_[True, (key[1:] != key[:-1]) | (token[1:] != token[:-1])]  # equal texts of different slices
            key, token = key[once], token[once]
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            df = np.repeat(np.diff(np.r_[start, len(token)]), np.diff(np.r_[start, len(token)]))
            key, token, df = key[df > 1], token[df > 1], df[df > 1]
        else:
            df = np.empty(0, np.int64)
        bucket = np.uint64(table.column("bucket")[0].as_py()) << shift
        return pa.table({"key": _signed(key), "token": _signed(token | bucket), "df": pa.array(df.astype(np.int64))})

    return count


def _hot_members(hot_tokens, hot_counts):
    """The hot shingles that each text's prefix can reach, one at least, with the number of its shingles that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = hot_tokens.value, hot_counts.value
        for _, w in _runs(batches):
            seen, out = set(), []
            for _, k1, _, found in _sets(w):
                if not len(found) or k1 in seen:
                    continue
                seen.add(k1)
                mine = found[_among(found, hot)] if len(hot) else found[:0]
                rest = len(found) - len(mine)
                if len(mine):
                    df = counts[np.searchsorted(hot, mine)]
                    # the longest prefix holds so many of them, the rarest; one at least, as ``rest`` is needed
                    first = np.lexsort((mine.view(np.int64), df))[: max(1, _prefix(len(found)) + MAX_MATCHES - 1 - rest)]
                    out.append((k1, mine[first], df[first] + HOT, rest))
            if out:
                n = [len(m) for _, m, _, _ in out]
                yield pa.RecordBatch.from_arrays([_signed(np.repeat(np.array([k for k, *_ in out], dtype=np.uint64), n)), _signed(np.concatenate([m for _, m, _, _ in out])), pa.array(np.concatenate([c for *_, c, _ in out]).astype(np.int64)), pa.array(np.repeat([r for *_, r in out], n).astype(np.int64))], ["key", "token", "df", "rest"])

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, w in _runs(batches):
        rows = {k1: found.tobytes() for _, k1, _, found in _sets(w) if len(found)}
        yield pa.RecordBatch.from_arrays([_signed(list(rows)), pa.array(list(rows.values()), pa.binary())], ["key", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = int(_among(p, q).sum())
            linked[i] = 100 * both >= PERCENT * (len(p) + len(q) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))


class Joined:
    """What the join found: ``digest`` (doc_id, k1, k2, n_shingles), ``nodes`` (id, k1, k2) and ``links`` (a, b) between nodes."""

    def __init__(self, digest: DataFrame, links: DataFrame):
        self.digest, self.links = digest, links

    def classes(self) -> DataFrame:
        """One row per document row: doc_id, n_shingles, component_id."""
        worded = self.digest.filter("n_shingles > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        # the rows of one text, which may be very many, meet its smallest id in salted parts
        text = ["k1", "k2", "salt"]
        nodes = worded.groupBy(*text).agg(F.min("doc_id").alias("least")).select(*text, F.min("least").over(Window.partitionBy("k1", "k2")).alias("node"))
        # the texts of one id are one node
        held = worded.filter("doc_id is not null").join(nodes, text).groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
        tied = held.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b")
        labels = components(self.links.unionByName(tied))
        known = nodes.join(labels, F.col("node") == F.col("id"), "left").select(*text, F.coalesce("label", "node").alias("component_id"))
        full = worded.join(known, text, "left").select("doc_id", "n_shingles", "component_id")
        return full.unionByName(self.digest.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def join(docs: DataFrame) -> Joined:
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(narrow.mapInArrow(_digest, "doc_id long, k1 long, k2 long, n_shingles long, hot boolean"), "digest")
    digest = found.filter("not hot").drop("hot")
    texts = digest.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"))
    n_rows, n_tokens = digest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()

    # 1. how many texts hold each shingle
    hot_rows = found.filter("hot").groupBy("k1").agg(F.sum("n_shingles").alias("df")).filter(F.col("df") * HOT_KEEP >= n_rows).toArrow()
    tokens = hot_rows.column("k1").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    hot_tokens = spark.sparkContext.broadcast(tokens[order])
    hot_counts = spark.sparkContext.broadcast(hot_rows.column("df").to_numpy()[order])
    buckets = 8
    while buckets * BUCKET_SHINGLES < n_tokens and buckets < MAX_BUCKETS:
        buckets *= 2
    dealt = narrow.mapInArrow(_deal(buckets, hot_tokens), "bucket int, docs binary, sizes binary, tokens binary")
    counted = dealt.groupBy("bucket").applyInArrow(_counted(buckets), "key long, token long, df long")
    often = counted.withColumn("rest", F.lit(None).cast("long"))
    if len(tokens):
        often = often.unionByName(narrow.mapInArrow(_hot_members(hot_tokens, hot_counts), "key long, token long, df long, rest long").dropDuplicates(["key", "token"]))

    # 2. prefixes: shingles of one text come first and match nothing, then the others by frequency
    listed = often.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"), F.max("rest").alias("rest"))
    listed = listed.join(texts.withColumnRenamed("k1", "key").select("key", "node", "n"), "key")
    p = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    n_hot_held = F.size(F.filter("held", lambda s: s["df"] >= F.lit(HOT)))
    n_rest_held = F.size("held") - n_hot_held
    alone = F.when(F.col("rest").isNotNull(), F.col("rest") - n_rest_held).otherwise(F.col("n") - n_rest_held)
    listed = listed.withColumn("p", p.cast("long")).withColumn("alone", alone).filter(F.col("alone") < F.col("p") + MAX_MATCHES - 1)
    first = F.slice("held", 1, F.greatest(F.col("p") - F.col("alone"), F.lit(0)).cast("int"))
    cost = F.aggregate(first, F.lit(0).cast("double"), lambda t, s: t + F.pmod(s["df"], F.lit(HOT)))
    matches = F.least(F.lit(MAX_MATCHES), F.lit(1) + F.floor(F.log(F.greatest(cost / COSTLY, F.lit(1.0))) / F.log(F.lit(float(COSTLY))))).cast("int")
    chosen = listed.withColumn("need", matches).withColumn("held", F.slice("held", 1, F.greatest(F.col("p") + F.col("need") - 1 - F.col("alone"), F.lit(0)).cast("int")))
    posts = chosen.select("node", "key", "n", "p", "need", "alone", F.posexplode("held").alias("at", "s")).select("node", "key", "n", "p", "need", (F.col("alone") + F.col("at")).alias("rank"), F.col("s.token").alias("token"))
    # the largest partner this member can have when the pair's first shared shingles are here
    reach = F.floor(((F.col("n") - F.col("rank") + F.col("need") - 1) * (100 + PERCENT)) / F.lit(PERCENT) - F.col("n") + 1e-9)
    posts = posts.withColumn("reach", reach.cast("long")).filter(F.col("reach") * 100 >= F.col("n") * PERCENT)
    posts = stored(posts, "postings")
    # postings of one member link nothing; long lists, which are few, are told apart before anything is dealt by list
    sized_lists = stored(posts.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "lists")
    lists = sized_lists.select("token", F.ceil(F.col("members") / LIST_ROWS).cast("int").alias("parts"))
    long_lists, each_part = lists.filter("parts > 1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    few = long_lists.count() <= BROADCAST_IDS
    dealt = posts.join(F.broadcast(long_lists) if few else long_lists, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    shared = stored(dealt.join(lists.select("token", each_part.alias("part")), ["token", "part"], "left_semi"), "shared-postings")
    discard(posts), discard(sized_lists)
    posts = shared

    # 3. the sets of the texts that any posting list names
    wanted = stored(posts.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    sets = stored(narrow.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(_set_rows, "key long, tokens binary").dropDuplicates(["key"]).join(posts.select("key", "node").distinct(), "key").select("node", "tokens"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), name)

    # 4. pivots: per posting list and class of sizes, all against the smallest id
    sized = posts.withColumn("scale", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))))
    pivots = sized.groupBy("token", "scale").agg(F.min(F.struct("node", "n")).alias("pivot"), F.max("parts").alias("parts"))
    pivots = pivots.select("token", "scale", F.col("pivot.node").alias("a"), F.col("pivot.n").alias("an"), each_part.alias("part"))
    stars = sized.join(pivots, ["token", "scale", "part"]).filter("node <> a").filter((F.least("n", "an") * 100) >= (F.greatest("n", "an") * PERCENT)).select("a", F.col("node").alias("b")).distinct()
    stars = stored(stars, "stars")
    links = verified(stars, "star-links")

    # 5. what is left: members of one list in different classes, by class bounds, then by all the bounds and matches
    labels = components(links)
    classed = posts.join(labels, F.col("node") == F.col("id"), "left").withColumn("class", F.coalesce("label", "node")).drop("id", "label")
    several = classed.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("parts").alias("parts")).filter("lo <> hi")
    classed = stored(classed.join(several.select("token", each_part.alias("part")), ["token", "part"], "left_semi"), "classed")
    # members of one class that all the bounds treat alike are one cell, so no join makes more rows than there are pairs within the bounds
    same = ["token", "class", "n", "need", "rank"]
    cells = classed.select(*same, "p", "reach", "parts").distinct()
    dealt_cells = cells.withColumn("part", F.pmod(F.xxhash64(*same), F.col("parts")).cast("int"))
    side = lambda df, s: df.select(*[c if c in ("token", "part") else F.col(c).alias(f"{s}_{c}") for c in df.columns])
    keys = lambda s: ["token", *[f"{s}_{c}" for c in same[1:]]]
    bounded = "x_n <= y_reach and y_n <= x_reach and 100 * x_n >= 80 * y_n and 100 * y_n >= 80 * x_n and x_rank < x_p + least(x_need, y_need) - 1 and y_rank < y_p + least(x_need, y_need) - 1".replace("80", str(PERCENT))
    meets = side(dealt_cells, "x").join(side(cells.withColumn("part", each_part), "y"), ["token", "part"]).filter(f"x_class < y_class and {bounded}").select(*keys("x"), *keys("y")[1:])
    members = classed.select(*same, "node")
    met = meets.join(side(members, "x"), keys("x")).join(side(members, "y"), keys("y"))
    pairs = met.groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x_need", "y_need")).alias("need")).filter("shared >= need").select("a", "b")
    more = verified(pairs.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "class-links")
    for used in (posts, sets, stars, classed, wanted):
        discard(used)
    return Joined(digest, links.unionByName(more))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return join(docs).classes()


def apply(docs: DataFrame) -> DataFrame:
    """The documents without those that are in the component of a document of smaller id; of repeated rows one stays."""
    found = stored(classes(docs), "classes")
    goes = found.filter("doc_id <> component_id").select("doc_id").distinct()
    few = goes.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(goes) if few else goes, "doc_id", "left_anti").select(*docs.columns)  # a null id stays
    repeated = found.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
