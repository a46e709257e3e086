"""Pairs of similar sets by a prefix filter: rare members first, no pair left out.

Two sets of sizes n and m with a Jaccard similarity of s share at least s * max(n, m) members, so if
all members stand in one order, they share one among the first n - ceil(s * n) + 1 of each. Ordered by
how rare they are, these prefixes leave common members out of the join, and sizes that are too far
apart do not meet at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leeway for similarities that are rounded to six places.
SLACK = 1e-6


def prefix_size(n: Column, least: float) -> Column:
    return (n - F.ceil(n * (least - SLACK) - 1e-9) + 1).cast("int")


def _ordered(sets: DataFrame, times: DataFrame, id_col: str, name: str) -> DataFrame:
    rows = sets.select(F.col(id_col).alias(f"{name}_id"), F.explode(F.array_distinct("members")).alias("member")).join(times, "member")
    return rows.groupBy(f"{name}_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "member"))), lambda x: x["member"]).alias(name))


def candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a_id, b_id, a, b (members, rare ones first): pairs that may be so similar, each once.

    a and b: id, members (an array; repeated members count once, sets without members have no pairs).
    Ids are unique on each side.
    """
    members = a.select(F.explode(F.array_distinct("members")).alias("member")).union(b.select(F.explode(F.array_distinct("members"))))
    times = members.groupBy("member").agg(F.count("*").alias("n"))
    sides = []
    for sets, name in ((a, "a"), (b, "b")):
        rows = _ordered(sets, times, "id", name)
        rows = rows.withColumn(f"{name}_prefix", F.slice(name, 1, prefix_size(F.size(name), least)))
        sides.append(rows.withColumn("member", F.explode(f"{name}_prefix")))
    both = sides[0].join(sides[1], "member")
    n, m = F.size("a"), F.size("b")
    # A pair counts where its prefixes meet first, so that it comes once.
    first = F.element_at(F.array_intersect("a_prefix", "b_prefix"), 1) == F.col("member")
    return both.filter((m >= n * (least - SLACK)) & (n >= m * (least - SLACK)) & first).select("a_id", "b_id", "a", "b")


def similar(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a_id, b_id, score of all pairs with a Jaccard similarity, rounded to six places, of ``least`` or more."""
    shared = F.size(F.array_intersect("a", "b"))
    score = F.round(shared / (F.size("a") + F.size("b") - shared), 6)
    return candidates(a, b, least).select("a_id", "b_id", score.alias("score")).filter(F.col("score") >= least)
