"""Training-corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. The mix is kept as the order of the written rows, and the token output writes
its segments in that order; its digests are per document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loamstone.llm import op02_pfair_mixing, op03_token_output, op06_jaccard_join, op08_quality_rules, op09_decontaminate
from loamstone.llm.common import stored


#: Rows and bytes that go to a Python worker at once; texts may be very long, and executors small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bounded(spark: SparkSession) -> None:
    """Set the session's batch sizes: a stage's result is written after its function has returned."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    bounded(spark)
    return op08_quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates."""
    bounded(spark)
    return op06_jaccard_join.apply(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    bounded(spark)
    return op09_decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which Pfair scheduling interleaves their sources."""
    bounded(spark)
    return op02_pfair_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token segments in the order of the mix, read back as digests per document."""
    bounded(spark)
    return op03_token_output.encode_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), order=op03_token_output.written_order(docs))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix), ("token-ID output", tokens)]

#: SQL can express neither the tokenizer nor the schedule; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
