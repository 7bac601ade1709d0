"""Shared helpers: tables written to the cluster's shared folder, and a ranking that splits hot groups."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task ranks at most, on average, in ``numbered``.
ROWS_PER_CHUNK = 5_000
#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session without one gets a folder of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/loamstone-shared"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loamstone/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> Iterator[None]:
    """Bound what goes to a Python worker at once, for the jobs that run inside; rows may be very long."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts lineage, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "n", spread: Column | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in an order that ``spread`` and ``order`` fix.

    A group is cut into chunks by the hash ``spread`` (default: of ``order``), each chunk is numbered by itself, and
    the chunk's offset, a sum over a table of one row per group and chunk, is added: no task holds a whole hot group.
    Null group values form a group of their own. ``df`` is read twice, so keep it narrow.
    """
    biggest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-biggest // rows_per_chunk))
    chunk = F.pmod(spread if spread is not None else F.xxhash64(*order), F.lit(chunks)).cast("int")
    cut = df.withColumn("_chunk", chunk)
    sizes = cut.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = cut.withColumn("_within", F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order)) - 1)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_chunk") == F.col("_c")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = within.join(F.broadcast(offsets) if chunks <= 1000 else offsets, on, "left")
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).select(*df.columns, name)
