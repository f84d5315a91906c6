"""Connected components of a table of links, by contraction: every node joins its least neighbour, trees collapse, links shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.scratch import discard, materialize


def flatten_trees(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent < node until each parent is a root, which needs no row: path lengths halve with each join."""
    own: list[DataFrame] = []
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        nxt = materialize(
            parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")),
            "parents",
        )
        parents = nxt.select("node", "parent")
        discard(*own)
        if nxt.filter("moved").isEmpty():
            return parents
        own = [nxt]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one type that has an order -> (node, component): one row for each node of an edge, component = its least node.

    Each round at least halves the nodes that still have edges. Loops and repeated edges are ignored, edges
    with a null end are dropped, no edges give no rows. Nothing is collected but one row that tells if edges are left.
    Of the scratch tables only that of the result stays.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), "parents")
        roots = flatten_trees(least)
        ra, rb = roots.select(F.col("node").alias("a"), F.col("parent").alias("pa")), roots.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        fewer = materialize(
            edges.join(ra, "a").join(rb, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        discard(edges, least)
        edges = fewer
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("component"))
        else:
            step = roots.select(F.col("node").alias("component"), "parent")
            new = materialize(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
            discard(labels, roots)
            labels = new
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(edges)
    return labels
