"""Connected components by minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; label is the least node of its component.

    Each pass takes the least label among neighbours, then the label's own label, so a path of n
    links needs about log n passes. Only counts reach the driver.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(one.union(one.select("v", "u")).where("u != v").distinct(), "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left")
        fresh = materialize(jump.select("node", F.col("label").alias("old"), F.least("next", "far").alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.where("old != label").isEmpty():
            return labels
