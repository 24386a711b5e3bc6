"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each round only
    needs minima per node, which merge before the shuffle, and every node ends up
    linked to its root after a logarithmic number of rounds in practice. The edges of
    each round are written out, so a lost executor never replays earlier rounds.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct()
    nodes = links.select(F.explode(F.array("u", "w")).alias("node")).distinct()
    links = cut_lineage(links.filter("u <> w"), "links")
    while True:
        # Large star: the larger neighbours of each node move to its smallest neighbour.
        both = links.select("u", "w").unionAll(links.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .filter("w > u")
            .select(F.col("w").alias("u"), F.col("m").alias("w"))
            .distinct()
        )
        # Small star: each node and its smaller neighbours move to the smallest one.
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("w").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("w"))
            .filter("u <> w")
            .distinct()
        )
        links = cut_lineage(small, "links")
        if _all_stars(links):
            roots = links.select(F.col("u").alias("node"), F.col("w").alias("root"))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _all_stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: nothing is left to do."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
    if row["n"] != row["u"]:
        return False
    ends = links.select(F.col("w").alias("u")).distinct()
    return links.join(ends, "u", "left_semi").isEmpty()
