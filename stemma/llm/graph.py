"""Connected components of a table of links, without collecting them.

Labels start as the smaller end of each link. A round takes the smallest label
among a node and its neighbours, then the label of the label (pointer jumping),
until nothing changes; every round is written to the shared folder, so a lost
executor costs one round at most. Long chains shrink by half a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns a written table of node, root: the smallest node of its component. Nodes without links are left out."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        old = labels.select("node", F.col("root").alias("old"))
        near = edges.join(old.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("old").alias("near"))
        low = old.join(near, "node").select("node", "old", F.least("old", "near").alias("low"))
        jump = old.select(F.col("node").alias("low"), F.col("old").alias("next"))
        step = low.join(jump, "low").select("node", F.least("low", "next").alias("root"), (F.least("low", "next") < F.col("old")).alias("moved"))
        new = materialize(step, "labels")
        discard(labels)
        labels = new
    discard(edges)
    out = labels.select("node", "root")
    out._stemma_path = labels._stemma_path
    return out
