"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, materialize

#: Links up to which one task may take all of a node's: they are two numbers each.
HOT_LINKS = 1_000_000


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every node of links(a, b); component is its component's smallest node.

    Each round takes the smallest label of the neighbours and then the label of that label, so the
    distance to the smallest node at least halves on chains and stars end after two rounds. Every
    round is written to ``folder``: a lost executor repeats one round at most. Beyond HOT_LINKS links, a
    node of many, or the smallest one of a large component, is dealt to several tasks. Null ends are
    ignored; no links give no rows.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, f"{folder}/edges")
    many = edges.count() > HOT_LINKS
    start = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = materialize(start.select("node", F.least("node", "low").alias("component")), f"{folder}/labels-0")
    for turn in range(1, 1000):
        ends = labels.select(F.col("node").alias("b"), "component")
        met = join_hot(edges, ends, "b", F.col("a"), f"{folder}/hot-{turn}") if many else edges.join(ends, "b")
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lowered = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "low").alias("via")
        )
        jumps = labels.select(F.col("node").alias("via"), F.col("component").alias("jump"))
        if many:
            lowered = materialize(lowered, f"{folder}/lowered-{turn}")
            jumped = join_hot(lowered, jumps, "via", F.col("node"), f"{folder}/hot-via-{turn}")
        else:
            jumped = lowered.join(jumps, "via")
        after = materialize(
            jumped.select("node", "was", F.least("via", "jump").alias("component")), f"{folder}/labels-{turn}"
        )
        moved = after.filter("was <> component").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not settle in 1000 rounds")
