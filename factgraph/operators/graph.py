"""Pointers and hierarchies, followed for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.session import checkpoint_dir


def _checkpoint(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def survivors(entities: DataFrame, rounds: int = 40) -> DataFrame:
    """entity_id and root, the entity at the end of its chain of merges (itself without one).

    Pointers double with each round, which ends when nothing moves; entities that still move after
    ``rounds`` rounds are on a cycle and have a null root. Only merged entities take part in rounds.
    """
    ends = merged(entities, rounds).withColumn("_known", F.lit(True))
    return entities.select("entity_id").join(ends, "entity_id", "left").select("entity_id", F.when(F.col("_known"), F.col("root")).otherwise(F.col("entity_id")).alias("root"))


def merged(entities: DataFrame, rounds: int = 40) -> DataFrame:
    """entity_id and root, as of survivors, of merged entities only."""
    p = _checkpoint(entities.filter("merged_into_entity_id IS NOT NULL").select("entity_id", F.col("merged_into_entity_id").alias("root"), F.lit(False).alias("moved")))
    for _ in range(rounds):
        q = p.select(F.col("entity_id").alias("root"), F.col("root").alias("next"))
        p = _checkpoint(p.join(q, "root", "left").select("entity_id", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        if p.filter("moved").isEmpty():
            return p.select("entity_id", "root")
    return p.select("entity_id", F.when(~F.col("moved"), F.col("root")).alias("root"))


def identity_groups(entities: DataFrame, direct_only: bool = False) -> DataFrame:
    """survivor_id and member_id: every entity that ends at the survivor (or is merged into it
    directly), the survivor included."""
    roots = survivors(entities)
    if not direct_only:
        return roots.select(F.col("root").alias("survivor_id"), F.col("entity_id").alias("member_id"))
    tops = roots.filter("entity_id = root").select(F.col("entity_id").alias("survivor_id"))
    direct = entities.filter("merged_into_entity_id IS NOT NULL").select(F.col("merged_into_entity_id").alias("survivor_id"), F.col("entity_id").alias("member_id"))
    return tops.select("survivor_id", F.col("survivor_id").alias("member_id")).union(direct.join(tops, "survivor_id"))


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reflexive transitive closure of (child, parent) over nodes (node): node, ancestor.

    Pairs found in one round are joined to all known ones, so paths double in length each round, and
    a round looks only at what the last one added; cycles end it too.
    """
    known = _checkpoint(nodes.select("node", F.col("node").alias("ancestor")).union(edges.select("child", "parent")).distinct())
    new = known.filter("node <> ancestor")
    while not new.isEmpty():
        further = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("beyond"))
        step = new.join(further, "ancestor").select("node", F.col("beyond").alias("ancestor")).distinct()
        have = known.select(F.col("node").alias("_node"), F.col("ancestor").alias("_ancestor"))
        new = _checkpoint(step.join(have, (F.col("node") == F.col("_node")) & (F.col("ancestor") == F.col("_ancestor")), "left_anti"))
        known = known.union(new)
    return known


def siblings(edges: DataFrame) -> DataFrame:
    """Nodes that share a parent: node, sibling, parent."""
    a, b = edges.alias("a"), edges.alias("b")
    pairs = a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.child") != F.col("b.child")))
    return pairs.select(F.col("a.child").alias("node"), F.col("b.child").alias("sibling"), F.col("a.parent").alias("parent"))


def connected_support(picked: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The first ``most`` supports (links: concept, support) of each picked concept, by key."""
    place = F.row_number().over(Window.partitionBy("concept").orderBy("support"))
    return links.join(picked.select("concept"), "concept", "left_semi").withColumn("_k", place).filter(F.col("_k") <= most).select("concept", "support")


def cycle_gate(proposed: DataFrame, closed: DataFrame) -> DataFrame:
    """Proposed (child, parent) edges that would close a cycle: the parent already descends from the child."""
    closed = closed.select(F.col("node").alias("parent"), F.col("ancestor").alias("child"))
    return proposed.join(closed, ["parent", "child"], "left_semi").select("child", "parent")


def endless(pointers: DataFrame) -> DataFrame:
    """Ids of (id, next) whose walk never ends: those on a cycle or leading into one.

    Pointers double with each round; after as many rounds as the number of rows has bits, every
    walk that ends has ended.
    """
    p = pointers.filter("next IS NOT NULL").select("id", "next")
    rounds = max(1, int(p.count()).bit_length())
    p = _checkpoint(p)
    for _ in range(rounds):
        q = p.select(F.col("id").alias("next"), F.col("next").alias("after"))
        p = _checkpoint(p.join(q, "next").select("id", F.col("after").alias("next")))
        if p.isEmpty():
            break
    return p.select("id")


def cycle_tops(pointers: DataFrame) -> DataFrame:
    """Ids on cycles of (id, next, seq), and top, the largest seq of the cycle that each is on.

    Pointers double with each round and carry the largest seq on their way, until a round changes
    nothing: no way has ended, the ids where ways lead are as many as before (these only get fewer,
    until they are the ids on cycles), and no top has grown (so it is that of the whole cycle). So
    rounds grow with the logarithm of the longest way, not of the number of rows.
    """
    p = _checkpoint(pointers.filter("next IS NOT NULL").select("id", "next", F.col("seq").alias("top"), F.lit(True).alias("grown")))
    before = None
    while True:
        q = p.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("top").alias("further"))
        p = _checkpoint(p.join(q, "next").select("id", F.col("after").alias("next"), F.greatest("top", "further").alias("top"), (F.col("further") > F.col("top")).alias("grown")))
        now = p.agg(F.count("*").alias("n"), F.count_if("grown").alias("grown")).first()
        if now.n == 0:
            break
        if now.grown == 0:
            now = (now.n, p.select("next").distinct().count())
            if now == before:
                break
            before = now
    return p.join(p.select(F.col("next").alias("id")).distinct(), "id", "left_semi").select("id", "top")
