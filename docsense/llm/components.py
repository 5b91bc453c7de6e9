"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsense.llm.common import discard, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every (larger, or smaller-or-own) neighbour of a node to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = around.join(least, "a")
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes of ``edges`` (columns a, b of one orderable type) with the smallest node reachable: columns node, root.

    Self-links, repeated links and links with a null end are ignored; a node without links to others isn't returned; an
    empty table gives an empty result. Every round is written to the shared folder and its predecessor deleted, so
    neither lineage, disk nor the driver grows with the number of rounds.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        before = links
        links = materialise(_star(_star(before, True), False), "links")
        discard(before)
        # Stars that don't touch are components: every node has one root, and no root has one.
        degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        roots = links.select(F.col("b").alias("a")).distinct()
        if degree.where("n > 1").select("a").unionByName(roots.join(degree.select("a"), "a", "left_semi")).isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not converge")
