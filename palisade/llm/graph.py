"""Connected components of a set of links, by the smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of the links (a, b)."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs")))
        joined = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stage(joined.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if not new.filter("label != old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
