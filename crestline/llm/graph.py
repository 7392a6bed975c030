"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import written
from crestline.session import drop_tables


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that ``links`` = (a, b), longs, reach; only nodes with links.

    Each round takes the smallest label among neighbours, merged per task before the shuffle, and then
    follows the label's own label, so long chains take a logarithmic number of rounds. Links stay on the
    left of joins: a node with a large share of them is split by adaptive execution. Rounds are cut by
    written tables, whose real sizes the next round's plan sees (a checkpoint would keep estimates, which
    multiply from join to join).
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                 F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        drop_tables(labels)
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            drop_tables(both)
            return labels
