"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfare.llm.stored import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Join the larger neighbours of a node to the least of the node and all its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    seen = links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")
    return seen.select("u", F.col("m").alias("v")).union(seen.where("v > m").select("v", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its least node.

    A node with very many links is no hot group: its links are reduced on the
    map side, and the joins are ones that adaptive execution splits. The number
    of rounds grows with the logarithm of a component's diameter.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(),
        "links",
    )
    while True:
        starred = stored(_small_star(_large_star(edges)), "stars")
        # a star forest no longer changes: every smaller end is nobody's larger end,
        # and every node has one smaller end
        changed = starred.join(starred.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = starred.groupBy("u").count().where("count > 1")
        edges = starred
        if changed.isEmpty() and several.isEmpty():
            break
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
