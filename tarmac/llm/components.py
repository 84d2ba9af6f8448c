"""Connected components of links, by hooking to the smallest neighbour and pointer doubling, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import written


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the labels of linked nodes made equal, to the smallest label of each component.

    ``links`` has a and b. Every round hooks each label to its smallest linked one and follows the hooks to their ends by
    doubling; rounds end when no link joins two labels. Every table of a round is written to the shared folder.
    """
    links = written(links)
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_ = links.join(a, "a").join(b, "b").where(F.col("la") != F.col("lb"))
        hooks = written(open_.select(F.greatest("la", "lb").alias("old"), F.least("la", "lb").alias("new")).groupBy("old").agg(F.min("new").alias("new")))
        if hooks.isEmpty():
            return labels
        while True:
            further = hooks.select(F.col("old").alias("new"), F.col("new").alias("far"))
            doubled = written(hooks.join(further, "new", "left").select("old", F.coalesce("far", "new").alias("new"), F.col("far").isNotNull().alias("moved")))
            hooks = doubled.select("old", "new")
            if doubled.where("moved").isEmpty():
                break
        labels = written(labels.join(hooks, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")))
