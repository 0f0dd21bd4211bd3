"""Connected components by label propagation with pointer jumping; every round is a few joins on the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (a, b): label is the smallest id that it reaches. No edges give no rows."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = materialize(least.join(jump, "label").select("id", F.least("label", "next").alias("label"), "was"))
        if not new.filter("label <> was").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")
