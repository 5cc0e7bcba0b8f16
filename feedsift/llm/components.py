"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsift.llm.scratch import stored


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` of (node, parent) to its root; parents are smaller than nodes."""
    while True:
        up = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
        jumped = stored(
            parents.join(up, F.col("parent") == F.col("_node"), "left")
            .select("node", F.coalesce("_parent", "parent").alias("parent"), F.col("_parent").isNotNull().alias("moved")),
            "roots",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node on an edge (a, b); root is the component's least node.

    Each round lets every node point to its least neighbour, follows the
    pointers to their ends and contracts the edges to these. A round at least
    halves the nodes that still have edges; jumps double their reach. Rows are
    reduced before each shuffle, so a node with many edges makes no large task.
    """
    labels = None
    edges = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    while not edges.isEmpty() or labels is None:
        # Only nodes with a smaller neighbour point somewhere; the others are roots.
        pointing = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        found = _roots(stored(pointing, "parents"))
        if labels is None:
            ends = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node")
            labels = ends.select("node", F.col("node").alias("root"))
        to = found.select(F.col("node").alias("_node"), F.col("parent").alias("_root"))
        labels = stored(
            labels.join(to, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root")),
            "labels",
        )
        at_a = to.select(F.col("_node").alias("_a"), F.col("_root").alias("_root_a"))
        moved = (
            edges.join(at_a, F.col("a") == F.col("_a"), "left").join(to, F.col("b") == F.col("_node"), "left")
            .select(F.coalesce("_root_a", "a").alias("a"), F.coalesce("_root", "b").alias("b"))
        )
        edges = stored(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
        )
    return labels
