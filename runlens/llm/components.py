"""Connected components of an edge table: smallest label of the neighbourhood, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round is written to the shared folder, so lost executors cost one round at most. Rows with a null end are
    left out; an empty table gives an empty one.
    """
    known = edges.select("a", "b").dropna().where("a <> b")
    both = keep(known.union(known.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = keep(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("theirs").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        labels = keep(
            lower.join(jump, "low").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("old")).alias("moved")),
            "labels",
        )
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
