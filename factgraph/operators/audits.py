"""Whole-table checks; each returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.graph import endless


def not_one_object(statements: DataFrame, columns: list[str]) -> DataFrame:
    """Statements that fill none or several of the object columns."""
    filled = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns])
    return statements.filter(filled != 1)


def kind_mismatches(statements: DataFrame, column_of: dict[str, str]) -> DataFrame:
    """Statements whose value kind's own object column is empty, or whose kind is unknown."""
    expected = reduce(lambda c, kv: c.when(F.col("value_kind") == kv[0], F.col(kv[1]).isNotNull()), column_of.items(), F)
    return statements.filter(~F.coalesce(expected.otherwise(False), F.lit(False)))


def bad_bounds(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows whose upper bound lies before the lower one."""
    return df.filter(F.col(high) < F.col(low))


def out_of_unit(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~F.col(column).between(0, 1))


def outside_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(allowed))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def collisions(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """repeated_keys with the members' ids, sorted and comma-joined."""
    groups = df.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).groupBy(*keys)
    return groups.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(member)), ",").alias("members")).filter("n > 1")


def supersession_findings(statements: DataFrame) -> DataFrame:
    """statement_id, note, severity: superseded statements without successor, with one that does not
    exist, with one about something else, or on (or leading into) a cycle."""
    rows = statements.filter("status = 'superseded'").select("statement_id", "subject_entity_id", "predicate_key", F.col("superseded_by_statement_id").alias("next"))
    to = statements.select(F.col("statement_id").alias("next"), F.col("subject_entity_id").alias("to_subject"), F.col("predicate_key").alias("to_predicate"), F.lit(True).alias("there"))
    # Rows without a successor meet nothing; joined, they would all end up in one task.
    pointing = rows.filter("next IS NOT NULL").join(to, "next", "left")
    ending = rows.filter("next IS NULL").select("next", "statement_id", "subject_entity_id", "predicate_key", *[F.lit(None).cast(kind).alias(c) for c, kind in to.dtypes if c != "next"])
    linked = pointing.union(ending)
    notes = (
        F.when(F.col("next").isNull(), "missing_successor")
        .when(F.col("there").isNull(), "dangling_successor")
        .when((F.col("to_subject") != F.col("subject_entity_id")) | (F.col("to_predicate") != F.col("predicate_key")), "incompatible_successor")
    )
    found = linked.withColumn("note", notes).filter("note IS NOT NULL").select("statement_id", "note")
    walks = endless(statements.select(F.col("statement_id").alias("id"), F.col("superseded_by_statement_id").alias("next")))
    cycles = rows.join(walks, rows.statement_id == walks.id, "left_semi").select("statement_id", F.lit("supersession_cycle").alias("note"))
    severity = F.when(F.col("note") == "supersession_cycle", "critical").when(F.col("note") == "incompatible_successor", "high").otherwise("medium")
    return found.union(cycles).withColumn("severity", severity)


#: Rows of an ontology's table that are broadcast; more are shuffled.
ONTOLOGY_BROADCAST = 100_000


def _few(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are no more than ONTOLOGY_BROADCAST."""
    return F.broadcast(rows) if rows.limit(ONTOLOGY_BROADCAST + 1).count() <= ONTOLOGY_BROADCAST else rows


def class_violations(statements: DataFrame, types: DataFrame, closed: DataFrame, allowed: DataFrame, end: str) -> DataFrame:
    """Statements whose entity at ``end`` has no class, or ancestor of one, that the predicate allows.

    types: entity_id, class_key; closed: node, ancestor; allowed: predicate_key, class_key. A
    predicate without rows in ``allowed`` takes any class; an entity without class breaks the rule.
    """
    # What each class allows is worked out first; predicates and classes are few and have many rows each.
    limited = statements.join(_few(allowed.select("predicate_key").distinct()), "predicate_key", "left_semi").filter(F.col(end).isNotNull())
    fits = closed.join(allowed, closed.ancestor == allowed.class_key).select("node", "predicate_key").distinct()
    fits = types.join(_few(fits), types.class_key == F.col("node")).select(F.col("entity_id").alias(end), "predicate_key").distinct()
    return limited.join(fits, [end, "predicate_key"], "left_anti")
