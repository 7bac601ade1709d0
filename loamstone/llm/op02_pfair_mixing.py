"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source are cut into blocks. Block i of a source of weight w (weights sum to one) is released at slot floor(i / w) and
due at ceil((i + 1) / w); earliest deadline first among the released blocks fills each slot. As the weights sum to one, every
deadline is met, so at every slot each source has had its share of blocks with a deviation of less than one block. Weights are
whole multiples of 1 / ``unit_of``, the finest unit whose products with all slots are whole numbers of 64 bits: over n slots a
share is off by n * n / 2 ** 60 blocks at most (a millionth of a block after a million slots).

The slots are cut into ranges, which are filled at the same time: no task walks all blocks. A range must start where the one
before ended, so the blocks given up to each border are fixed first, by running the slots of the range before the border from
the state in which, of the blocks whose windows span its start, those of the earliest deadlines are given. From that state all
later deadlines are met. As a range is no shorter than any window's 1 / w, each border can be reached from the border before:
blocks released from slot a on and given before border t are at most t - a for every a. So earliest deadline first within a
range, with the border as last deadline, ends at the next border.

A source that has no blocks left leaves its slots empty; the others close up and keep their proportions, so all rows stay.
``position`` is a block's place without the empty slots.

Defined cases: a null source is a source of its own; rows with equal keys follow by text hash; a null or empty text is a row
like any other; repeated rows keep their number; an empty table gives an empty result; extra columns pass through ``mixed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, numbered, stored

#: Rows of a block.
BLOCK_ROWS = 16
#: Weights that are multiples of its inverse are kept exactly; others are rounded to a unit that is finer by a power of ten.
PERIOD = 720
#: Slots of a range at least, and of the chunks in which a range's slots are gathered.
RANGE_SLOTS, CHUNK_SLOTS = 1_024, 256
#: Blocks whose slots may be broadcast (about 50 bytes each); beyond, the join is shuffled by source and block.
BROADCAST_BLOCKS = 200_000
#: Default weights: the power of a source's share of rows (1 keeps the shares, 0 makes all sources equal).
TEMPERATURE = 0.5


def slots_of(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots per period, by largest remainder; at least one each."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    ideal = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in ideal.items()}
    by_rest = sorted(ideal, key=lambda s: (-(ideal[s] - slots[s]), str(s)))
    k = 0
    while sum(slots.values()) != period:
        if sum(slots.values()) < period:
            slots[by_rest[k % len(by_rest)]] += 1
        else:  # sources raised to one slot took too much: the largest give way
            slots[max(slots, key=lambda s: (slots[s], str(s)))] -= 1
        k += 1
    return slots


def unit_of(weights: dict[str | None, float], blocks: dict[str | None, int], period: int = PERIOD) -> int:
    """``period`` times the largest power of ten whose products with all slots stay below 2 ** 61."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    n_slots = max(blocks[s] * total / w for s, w in weights.items()) + 2 * total / min(weights.values()) + RANGE_SLOTS
    unit = period
    while unit * 10 * n_slots < 2**61:
        unit *= 10
    return unit


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, where the value is computed once."""
    return F.transform(F.array(value), then)[0]


def _numbers(values: list[int]) -> Column:
    """One literal, however many the values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _release(block: Column, share: Column | int, unit: int) -> Column:
    return F.call_function("div", block * F.lit(unit), share)


def _due(block: Column, share: Column | int, unit: int) -> Column:
    return F.call_function("div", (block + 1) * F.lit(unit) + share - 1, share)


def schedule(spark: SparkSession, shares: list[int], blocks: list[int], range_slots: int = RANGE_SLOTS) -> DataFrame:
    """One row per block: i (of the source in ``shares``), k (the source's k-th block), slot, and position."""
    unit = sum(shares)
    n_slots = max(-(-b * unit // a) for a, b in zip(shares, blocks))
    length = min(max(range_slots, -(-unit // min(shares))), n_slots)
    n_ranges = -(-n_slots // length)
    share, size, indexes = _numbers(shares), _numbers(blocks), F.sequence(F.lit(0), F.lit(len(shares) - 1))
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda t, n: t + n)
    add = lambda given, pick: F.transform(given, lambda n, i: F.when(i == pick, n + 1).otherwise(n))

    def pick(given: Column, slot: Column, goal: Column | None = None, end: Column | None = None) -> Column:
        """The released source of the earliest deadline; with a goal, none gets more, and the range's end is a deadline."""
        released = lambda i: _release(given[i], share[i], unit) <= slot
        ready = F.filter(indexes, released if goal is None else lambda i: released(i) & (given[i] < goal[i]))

        def keyed(i: Column) -> Column:
            due = _due(given[i], share[i], unit)
            return F.struct(due if end is None else F.least(due, end), due, i.alias("i"))

        return F.array_min(F.transform(ready, keyed))["i"]

    def opening(slot: Column) -> Column:
        """Blocks given before a slot, where the windows that span it are served by deadline."""
        whole = F.transform(share, lambda a: F.call_function("div", a * slot, F.lit(unit)))
        open_ = F.filter(indexes, lambda i: share[i] * slot % F.lit(unit) > 0)
        by_due = F.array_sort(F.transform(open_, lambda i: F.struct(_due(F.call_function("div", share[i] * slot, F.lit(unit)), share[i], unit), i.alias("i"))))
        served = lambda n: F.slice(by_due, F.lit(1), (slot - total(n)).cast("int"))["i"]
        return _let(whole, lambda n: _let(served(n), lambda first: F.transform(n, lambda g, i: F.when(F.array_contains(first, i), g + 1).otherwise(g))))

    first, last = F.col("j") * length, (F.col("j") + 1) * length
    ranges = spark.range(0, n_ranges, 1, min(n_ranges, 4 * spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "j")
    border = F.aggregate(F.sequence(first, last - 1), opening(first), lambda given, slot: add(given, pick(given, slot)))
    borders = stored(ranges.select((F.col("j") + 1).alias("at"), border.alias("given")), "borders")
    borders = borders.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("at"), F.transform(share, lambda a: F.lit(0).cast("long")).alias("given")))
    both = ranges.join(borders.select(F.col("at").alias("j"), F.col("given").alias("start")), "j").join(borders.select((F.col("at") - 1).alias("j"), F.col("given").alias("goal")), "j")
    none = F.expr("cast(array() as array<struct<i:int,k:bigint,slot:bigint,position:bigint>>)")

    def fill(state: Column, slot: Column) -> Column:
        def take(p: Column) -> Column:
            k = state["given"][p]
            row = F.struct(p.alias("i"), k.alias("k"), slot.alias("slot"), state["ahead"].alias("position"))
            return F.struct(
                add(state["given"], p).alias("given"),
                F.when(k < size[p], state["ahead"] + 1).otherwise(state["ahead"]).alias("ahead"),
                F.when(k < size[p], F.concat(state["filled"], F.array(row))).otherwise(state["filled"]).alias("filled"),
            )

        return _let(pick(state["given"], slot, F.col("goal"), last), take)

    def chunk(state: Column, start: Column) -> Column:
        zero = F.struct(state["given"].alias("given"), state["ahead"].alias("ahead"), none.alias("filled"))
        filled = F.aggregate(F.sequence(start, F.least(start + CHUNK_SLOTS, last) - 1), zero, fill)
        return _let(filled, lambda f: F.struct(f["given"].alias("given"), f["ahead"].alias("ahead"), F.concat(state["parts"], F.array(f["filled"])).alias("parts")))

    ahead = total(F.zip_with(F.col("start"), size, lambda g, b: F.least(g, b)))
    parts = F.expr("cast(array() as array<array<struct<i:int,k:bigint,slot:bigint,position:bigint>>>)")
    zero = F.struct(F.col("start").alias("given"), ahead.alias("ahead"), parts.alias("parts"))
    filled = F.aggregate(F.sequence(first, last - 1, F.lit(CHUNK_SLOTS).cast("long")), zero, chunk)["parts"]
    return both.select(F.explode(F.flatten(filled)).alias("f")).select("f.*")


def plan(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """One row per document: doc_id, source, block (of the source), offset in it, release, deadline, slot, and position."""
    named = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    sizes = {r[0]: r[1] for r in named.groupBy("source").count().collect()}  # one row per source
    if not sizes:
        return named.select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "offset", "release", "deadline", "slot", "position")]).limit(0)
    weights = {s: (weights[s] if weights is not None else n**TEMPERATURE) for s, n in sizes.items()}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    unit = unit_of(weights, blocks, period)
    slots = slots_of(weights, unit)
    names = sorted(slots, key=lambda s: (s is None, s or ""))
    placed = numbered(named, ["source"], [F.col("doc_id"), F.col("_text")], "_n", spread=F.xxhash64("doc_id"))
    block = placed.withColumn("block", F.floor(F.col("_n") / block_rows)).withColumn("offset", F.col("_n") % block_rows)
    filled = stored(schedule(docs.sparkSession, [slots[s] for s in names], [blocks[s] for s in names]), "schedule")
    source, share = F.array(*[F.lit(s).cast("string") for s in names]), _numbers([slots[s] for s in names])
    order = filled.select(source[F.col("i")].alias("_source"), share[F.col("i")].alias("_share"), F.col("k").alias("_k"), "slot", "position")
    on = block["source"].eqNullSafe(order["_source"]) & (block["block"] == order["_k"])
    joined = block.join(F.broadcast(order) if sum(blocks.values()) <= BROADCAST_BLOCKS else order, on)
    return joined.select(
        "doc_id",
        "source",
        F.col("block").cast("long").alias("block"),
        F.col("offset").cast("long").alias("offset"),
        _release(F.col("block"), F.col("_share"), unit).alias("release"),
        _due(F.col("block"), F.col("_share"), unit).alias("deadline"),
        "slot",
        "position",
    )


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``docs``, in the order of the mix: partitions follow each other, and rows in a partition too."""
    order = plan(docs, weights, block_rows, period).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("position").alias("_position"), F.col("offset").alias("_offset"))
    # rows that share an id and a source take the first of their places, next to each other
    at = free_name(docs, "_mix_at")
    order = order.groupBy("_id", "_source").agg(F.min(F.struct("_position", "_offset")).alias(at))
    on = docs["doc_id"].eqNullSafe(order["_id"]) & docs["source"].cast("string").eqNullSafe(order["_source"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.join(order, on).select(*[docs[c] for c in docs.columns], order[at])
    return placed.repartitionByRange(n, at).sortWithinPartitions(at).drop(at)
