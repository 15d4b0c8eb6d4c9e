"""Connected components of an edge table, by contraction of pointer forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Tables


def _roots(pointers: DataFrame, tables: Tables) -> DataFrame:
    """``node, label``: where following ``label`` ends; pointers never rise, so there are no cycles."""
    while True:
        up = pointers.select(F.col("node").alias("label"), F.col("label").alias("further"))
        on = pointers.join(up, "label", "left").select("node", F.col("label").alias("old"), F.coalesce("further", "label").alias("label"))
        on = on.join(up, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label"))
        step = tables.put("pointers", on)
        pointers = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return pointers


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge; the label is the component's smallest node.

    Every node points to its least neighbour, the trees of that forest become
    one node each, and the edges left between different ones go into the next
    round. Each round at least halves the nodes that still have edges, and
    edges inside a tree go at once, so a dense group costs its edges about once.
    Minima are combined before the shuffle; rounds are tables in the shared
    folder, deleted when the next one is written; nothing but counts reaches the
    driver. Edges that join a node to itself are ignored; without others there
    is no row.
    """
    tables = Tables(edges.sparkSession, name)
    left = tables.put("links", edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct())
    mapping: DataFrame | None = None
    while True:
        ends = left.select("x", "y").unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        labels = _roots(tables.put("pointers", ends.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label"))), tables)
        if mapping is None:
            mapping = tables.put("components", labels)
        else:
            over = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
            mapping = tables.put("components", mapping.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label")))
        moved = left.join(labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x").join(labels.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y")
        left = tables.put("links", moved.where("lx <> ly").select(F.least("lx", "ly").alias("x"), F.greatest("lx", "ly").alias("y")).distinct())
        if left.isEmpty():
            tables.drop("links", "pointers")
            return mapping
