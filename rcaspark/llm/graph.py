"""Connected components of an undirected edge table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger end first, without loops and null ends."""
    return cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round hooks a node to its smallest neighbour, follows the hooks to
    their roots by pointer doubling, and contracts the edges to edges between
    roots; few are left after the first round. A hub's neighbours are reduced
    by partial minima, and the joins read written tables, so that Spark can
    split a hot side. Null ends and loops are no edges; an empty table gives
    no rows.
    """
    left = _oriented(edges)
    labels = cut_lineage(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while left.limit(1).count():
        hooks = cut_lineage(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))).withColumn("moved", F.lit(True))
        while hooks.where("moved").limit(1).count():
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = cut_lineage(hooks.join(up, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        for end in ("a", "b"):
            moved = hooks.select(F.col("node").alias(end), "root")
            left = left.join(moved, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = _oriented(left)
        labels = cut_lineage(labels.join(hooks.select(F.col("node").alias("label"), "root"), "label", "left").select(
            "node", F.coalesce("root", "label").alias("label")))
    return labels.withColumnRenamed("label", "component")
