"""Findings of audits: routing, issues over time, and repairs of successor links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators import audits
from factgraph.operators.graph import cycle_tops
from factgraph.session import written


def routed(findings: DataFrame) -> DataFrame:
    """findings with route: critical ones to a person at once, high ones to repair, others to be asked about."""
    return findings.withColumn("route", F.when(F.col("severity") == "critical", "escalate").when(F.col("severity") == "high", "repair").otherwise("clarify"))


def issues(old: DataFrame, findings: DataFrame, fingerprint: Column) -> DataFrame:
    """Open issues (fingerprint, occurrence_count) after new findings: known ones count up, new ones start at 1."""
    new = findings.groupBy(fingerprint.alias("fingerprint")).agg(F.count("*").alias("n"))
    both = old.select("fingerprint", F.col("occurrence_count").alias("n")).union(new)
    return both.groupBy("fingerprint").agg(F.sum("n").alias("occurrence_count"))


def repairs(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """statement_id, successor_id, seq, outcome of proposed (statement_id, successor_id, seq), as if
    they were taken one by one by seq (which tells them apart).

    REPAIRED where a statement with a finding gets an existing successor of its subject and predicate
    without closing a cycle; NO_LONGER_APPLICABLE where it has no finding, or an earlier edge has
    repaired it; else REJECTED. Until its own edge is taken, a statement under repair counts as
    having no successor.

    All edges are judged at once: each statement points to its first edge that is not rejected, and
    of every cycle only the latest edge closes it and is rejected; then its statement's next edge
    comes up, until no cycle holds an edge.
    """
    bad = audits.supersession_findings(statements).select("statement_id", F.lit(True).alias("_found")).distinct()
    s = statements.select("statement_id", F.col("subject_entity_id").alias("s_subject"), F.col("predicate_key").alias("s_predicate"), F.lit(True).alias("_known"))
    t = statements.select(F.col("statement_id").alias("successor_id"), F.col("subject_entity_id").alias("t_subject"), F.col("predicate_key").alias("t_predicate"))
    rows = edges.select("statement_id", "successor_id", "seq").join(s, "statement_id", "left").join(t, "successor_id", "left").join(bad, "statement_id", "left")
    fits = F.coalesce((F.col("t_subject") == F.col("s_subject")) & (F.col("t_predicate") == F.col("s_predicate")) & (F.col("successor_id") != F.col("statement_id")), F.lit(False))
    rows = written(rows.select("statement_id", "successor_id", "seq", F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce("_found", F.lit(False)).alias("found"), fits.alias("fits")), "edges")
    open_edges = rows.filter("found AND fits").select("statement_id", "successor_id", "seq")
    rest = statements.select(F.col("statement_id").alias("id"), F.col("superseded_by_statement_id").alias("next")).join(open_edges.select(F.col("statement_id").alias("id")).distinct(), "id", "left_anti")
    rest = written(rest.filter("next IS NOT NULL").select("id", "next", F.lit(-1).cast("long").alias("seq")), "pointers")
    rejected = None
    while True:
        first = open_edges.groupBy("statement_id").agg(F.min(F.struct("seq", "successor_id")).alias("_e"))
        first = written(first.select(F.col("statement_id").alias("id"), F.col("_e.successor_id").alias("next"), F.col("_e.seq").cast("long").alias("seq")), "first-edges")
        tops = cycle_tops(rest.union(first))
        closing = written(first.join(tops, "id").filter("seq = top").select("seq"), "closing")
        if closing.isEmpty():
            break
        rejected = closing if rejected is None else rejected.union(closing)
        open_edges = open_edges.join(closing, "seq", "left_anti").select("statement_id", "successor_id", "seq")
    taken = first.select("seq", F.col("id").alias("_taken"))
    rows = rows.join(taken, "seq", "left").join(first.select(F.col("id").alias("statement_id"), F.col("seq").alias("_by")), "statement_id", "left")
    late = ~F.col("found") | F.coalesce(F.col("seq") > F.col("_by"), F.lit(False))
    outcome = F.when(~F.col("known"), "REJECTED").when(F.col("_taken").isNotNull(), "REPAIRED").when(late, "NO_LONGER_APPLICABLE").otherwise("REJECTED")
    return rows.select("statement_id", "successor_id", "seq", outcome.alias("outcome"))


def repaired(statements: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The statements after repairs: superseded by the successor that each one got."""
    to = outcomes.filter("outcome = 'REPAIRED'").select("statement_id", F.col("successor_id").alias("_to"))
    rows = statements.join(to, "statement_id", "left")
    rows = rows.withColumns({"superseded_by_statement_id": F.coalesce("_to", "superseded_by_statement_id"), "status": F.when(F.col("_to").isNotNull(), "superseded").otherwise(F.col("status"))})
    return rows.select(*statements.columns)


def closed_issues(issues: DataFrame, outcomes: DataFrame, after: DataFrame) -> DataFrame:
    """issue_id, statement_id, status, resolution of issues (issue_id, statement_id, status) once the
    repaired statements (after) have been audited again: an open issue whose statement has no finding
    any more is resolved, by a structural_repair or by no_action; others stay as they are."""
    still = audits.supersession_findings(after).select("statement_id", F.lit(True).alias("_still")).distinct()
    got = outcomes.groupBy("statement_id").agg(F.max(F.col("outcome") == "REPAIRED").alias("_repaired"))
    rows = issues.join(still, "statement_id", "left").join(got, "statement_id", "left")
    done = (F.col("status") == "open") & F.col("_still").isNull() & F.col("_repaired").isNotNull()
    resolution = F.when(done, F.when(F.col("_repaired"), "structural_repair").otherwise("no_action"))
    return rows.select("issue_id", "statement_id", F.when(done, "resolved").otherwise(F.col("status")).alias("status"), resolution.alias("resolution"))
