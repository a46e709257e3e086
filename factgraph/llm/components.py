"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import replaced


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), both long: node and root, the smallest node of its component, for every node
    that has an edge to a smaller one in the end (so for all but the roots).

    Each round links neighbours to the smallest node known near them (a partially aggregated
    minimum, joined back to the edges) and writes the new edges to the shared folder in place of the
    last round's; the number of rounds grows with the logarithm of the longest path. Null ends, loops and repeated
    edges count for nothing.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    (edges, path), before = replaced(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_")).select("_.a", "_.b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges, path = replaced(small.union(low.select("a", F.col("low").alias("b"))).distinct(), now[0], path)
