"""Connected components of an edge table, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label) for every id of ``edges`` (a long, b long): label is the smallest id reachable.

    Each round takes the smallest label among neighbours, then the label's own label, and is written to the shared
    folder, so lineage stays short. The rounds grow with the logarithm of a path's length. An empty table gives none.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        hop = labels.select(F.col("id").alias("low"), F.col("label").alias("hop"))
        new = stored(low.join(hop, "low").select("id", F.least("low", "hop").alias("new"), F.col("label").alias("old")), name)
        changed = new.filter("new <> old").limit(1).count()
        discard(labels)
        labels = new.select("id", F.col("new").alias("label"))
        labels._stored_at = new._stored_at
        if not changed:
            discard(both)
            return labels
