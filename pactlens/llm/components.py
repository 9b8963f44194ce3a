"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work_table, work_table


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for every node with a link.

    ``links`` has long columns a and b; null ends, self-links and repeated rows are as
    good as none. Each round contracts the graph: a node goes into its least neighbour
    if that is less than itself, that into its own, and the links are carried over to
    what is left, once each. Only links between different groups are looked at again,
    so a group that has one centre is gone after the first round. Nodes are taken to be
    hashes: in random order a round leaves a fraction of them, few rounds do. Rows are
    pre-aggregated by node before the shuffle; a hub costs a row a task.
    """
    edges = work_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        least = edges.groupBy("a").agg(F.min("b").alias("b"))
        own = edges.groupBy(F.col("b").alias("a")).agg(F.lit(None).cast("long").alias("b"))
        parents = least if labels is not None else least.unionByName(own).groupBy("a").agg(F.min("b").alias("b"))
        parents = work_table(parents.select(F.col("a").alias("node"), F.coalesce("b", "a").alias("parent")), "parents")
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        into = work_table(parents.join(above, "parent", "left").select("node", F.coalesce("further", "parent").alias("label")), "into")
        drop_work_table(parents)
        if labels is None:
            new = into
        else:
            further = into.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = work_table(labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
            drop_work_table(labels)
        to = lambda c: into.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}"))
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        moved = moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        left = work_table(moved, "links")
        drop_work_table(edges)
        if labels is not None:
            drop_work_table(into)
        labels, edges = new, left
        if not edges.limit(1).count():
            drop_work_table(edges)
            return labels
