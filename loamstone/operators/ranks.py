"""Running totals over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of the order's hash; their totals are one small table.
DIGITS = 3


def spread(*key: Column) -> Column:
    """A fixed order of keys that looks random: the md5 of the key. Any prefix of it cuts the order into even chunks."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))


def running_total(df: DataFrame, value: str, order: Column, name: str = "total") -> DataFrame:
    """The sum of ``value`` over all rows up to this one, in the order of a ``spread`` key that differs from row to row.

    Rows are summed inside chunks of the order's first digits; the chunks before, at most 16 ** DIGITS of them, are added up in one small window."""
    cut = df.withColumn("_order", order).withColumn("_chunk", F.substring("_order", 1, DIGITS))
    chunks = cut.groupBy("_chunk").agg(F.sum(value).alias("_sum"))
    before = chunks.select("_chunk", F.coalesce(F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_chunk").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(F.broadcast(before), "_chunk").withColumn(name, F.col("_before") + inside).drop("_order", "_chunk", "_before")


def ranked_by(df: DataFrame, level: str, tie: Column, name: str = "rank") -> DataFrame:
    """Places from 1 on, by ``level`` descending and then by a ``spread`` key.

    ``level`` is a number with few different values (a count): one row for each value and chunk of ties is summed up in a window over those rows alone."""
    cut = df.withColumn("_tie", tie).withColumn("_chunk", F.substring("_tie", 1, 1))
    sizes = cut.groupBy(level, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = Window.orderBy(F.desc(level), "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(level, "_chunk", F.coalesce(F.sum("_rows").over(ordered), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(level, "_chunk").orderBy("_tie"))
    return cut.join(before, [level, "_chunk"]).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_tie", "_chunk", "_before").select(*df.columns, name)
