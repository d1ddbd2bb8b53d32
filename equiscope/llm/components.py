"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(``node``, ``label``): the least node that each node with an edge reaches. ``edges``: long ``a``, ``b``.

    Each round takes the least label of the neighbours, then the label's own
    label; rounds grow with the logarithm of a component's diameter in
    practice, and each is written in the shared folder, which cuts the lineage. A hot node is an edge table's join
    key only, which adaptive execution splits; the least label is a partial
    aggregate. An empty edge table gives an empty result.
    """
    plain = edges.select("a", "b").where("a != b")
    both = scratch.table(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        nearer = labels.join(least, F.col("node") == F.col("v")).select("node", "label", F.least("label", "near").alias("near"))
        jump = nearer.select(F.col("node").alias("v"), F.col("near").alias("far"))
        after = nearer.join(jump, F.col("near") == F.col("v"), "left").select("node", F.col("label").alias("old"), F.least("near", F.coalesce("far", "near")).alias("label"))
        after = scratch.table(after, "labels")
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            return labels
