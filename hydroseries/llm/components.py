"""Connected components of a table of links, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import cut, discard


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp (smallest node of its component) of every node in links (a, b).

    Each round a node takes the smallest label among its neighbours' labels and
    then its label's label, which halves distances; labels are cut each round."""
    both = cut(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels_table = labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
                .select(F.col("a").alias("node"), "low"))
        took = (labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp")))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = cut(took.join(jump, "comp").select("node", "old", F.least("comp", "next").alias("comp")))
        discard(labels_table)
        labels_table, labels = new, new.select("node", "comp")
        if not new.where("old <> comp").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both)
    return labels


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only the components that the links touch are solved anew."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    known = cut(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))))
    near = (links.join(known.toDF("a", "ca"), "a").join(known.toDF("b", "cb"), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = components(near).toDF("comp", "next")
    return cut(known.join(new, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")))
