"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_toxicity as op01
from . import op02_pfair_mixing as op02
from . import op03_token_output as op03
from . import op04_disclosure as op04
from . import op05_jump_shards as op05
from . import op06_jaccard_join as op06
from . import op07_class_lm as op07
from . import op08_quality_rules as op08
from . import op09_decontaminate as op09
from . import op10_chat_format as op10
from . import op11_filter_audit as op11
from . import op12_phrase_dedup as op12
from . import op13_fill_in_middle as op13
from . import sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08.score(_docs(spark, sf_dir)).drop("rejected_by")  # which rule comes first is a matter of measured time


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03.encode_and_read(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06.classes(_docs(spark, sf_dir))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02.plan(_docs(spark, sf_dir))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05.assign(_docs(spark, sf_dir), 40)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09.report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are control strings of another template."""
    found = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", words), (-1, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    extra = extra.select(*[F.col(c).cast(found.schema[c].dataType) for c in found.columns])
    return op10.format_and_read(found.unionByName(extra))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04.find(_docs(spark, sf_dir))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07.score(_docs(spark, sf_dir))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return op01.score(docs, op01.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.report(_docs(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.report(_docs(spark, sf_dir))


_ALL = (op1_toxicity, op2_pfair_mixing, op3_token_output, op4_disclosure, op5_jump_shards, op6_jaccard_join, op7_class_lm, op8_quality_rules, op9_decontaminate, op10_chat_format, op11_filter_audit, op12_phrase_dedup, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _ALL}

#: SQL can't express a fitted machine, a schedule by integer weights, a tokenizer, Luhn digits with disclosing terms, and exchange clustering.
ORACLE_SQL = {"op5_jump_shards": sql.OP5, "op6_jaccard_join": sql.OP6, "op8_quality_rules": sql.OP8, "op9_decontaminate": sql.OP9, "op10_chat_format": sql.OP10, "op11_filter_audit": sql.OP11, "op12_phrase_dedup": sql.OP12, "op13_fill_in_middle": sql.OP13}
