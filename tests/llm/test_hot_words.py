"""Words that are frequent and not in the head: their neighbours travel as counts."""

import pytest
from pyspark.sql import functions as F

from loamstone.llm import op07_class_lm as op07


@pytest.mark.parametrize("dense", [0, 3])
def test_counts_instead_of_neighbours(docs, monkeypatch, dense):
    """Scores are the same, however many occurrences come with their neighbours."""
    told = lambda: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in op07.score(docs, 20).collect())
    plain = told()
    monkeypatch.setattr(op07, "DENSE", dense)
    assert told() == plain


def test_a_hot_word_stays_small(spark, monkeypatch):
    """A word of a hundred thousand occurrences sends a bounded entry per slice."""
    import numpy as np

    text = " ".join(f"hot w{k % 9}" for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blobs = ", ".join(f"{c} binary" for c in ("held", "sizes", "tokens", "words", "counts"))
    slices = docs.mapInArrow(op07._slices, f"slice string, doc_ids array<long>, {blobs}")
    head = spark.sparkContext.broadcast(op07.Head(np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    dealt = slices.select("slice", "held", "sizes", "tokens", "words", "counts").mapInArrow(op07._deal(4, head, op07.DENSE), op07._DEALT)
    sizes = dealt.agg(*[F.sum(F.octet_length(c)).alias(c) for c in ("left", "right", "dense")]).first()
    assert sizes["left"] + sizes["right"] == 0 and sizes["dense"] == 10 * 2 * op07.CLASSES * 4
