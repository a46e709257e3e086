"""Clarifications of ambiguous requests: issued, answered once, re-checked, expired and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Minutes in which a clarification can be answered.
MINUTES = 30


def issue(requests: DataFrame, candidates: DataFrame, outcomes: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """clarification_id, request_id, candidates, created_at, expires_at, supersedes_id for every request
    (request_id, created_at) whose outcome (request_id, outcome) is AMBIGUOUS. candidates (request_id,
    entity_id) are listed sorted; those that were ruled out stay with the caller."""
    asked = requests.join(outcomes.filter("outcome = 'AMBIGUOUS'").select("request_id"), "request_id", "left_semi")
    listed = candidates.groupBy("request_id").agg(F.sort_array(F.collect_set("entity_id")).alias("candidates"))
    rows = asked.join(listed, "request_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return rows.select(
        F.concat(F.lit("clarify:"), F.col("request_id").cast("string")).alias("clarification_id"), "request_id", "candidates", "created_at",
        (F.col("created_at") + F.make_interval(mins=F.lit(minutes))).alias("expires_at"), F.lit(None).cast("string").alias("supersedes_id"),
    )


def status_at(asked: DataFrame, history: DataFrame) -> DataFrame:
    """asked (entity_id, at, and others) with entity_status, the last of history (entity_id, status,
    changed_at) at that time; null before the first. One ordered pass over both, no join by range."""
    others = [c for c in asked.columns if c not in ("entity_id", "at")]
    rows = asked.select("entity_id", "at", F.lit(1).alias("_asks"), F.struct(*others).alias("_row"), F.lit(None).cast("string").alias("_status"))
    told = history.select("entity_id", F.col("changed_at").alias("at"), F.lit(0).alias("_asks"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("status").alias("_status"))
    # A change at the very time of the question counts.
    order = Window.partitionBy("entity_id").orderBy("at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.union(told).withColumn("entity_status", F.last("_status", ignorenulls=True).over(order))
    return both.filter("_asks = 1").select("entity_id", "at", "_row.*", "entity_status")


def answered(clarifications: DataFrame, answers: DataFrame, history: DataFrame, minutes: int = MINUTES) -> tuple[DataFrame, DataFrame]:
    """Outcomes of answers (answer_id, clarification_id, resolution, chosen_entity_id, answered_at) and
    the clarifications that they lead to.

    The first answer that counts closes its clarification: REJECTED (nothing is written), CREATED (the
    entity is new), CHOSEN (the entity is active at the time of the answer), or, if the chosen entity
    isn't active any more, by the candidates that are: SUPERSEDED by a new clarification where there
    are several, RERUN where there is one at most. Other answers change nothing: NOT_FOUND, EXPIRED
    (after its time), INVALID (no candidate was chosen, or an unknown resolution), and, once it is
    closed, ALREADY_RESOLVED or ALREADY_SUPERSEDED.
    """
    asked = answers.join(clarifications.select("clarification_id", "request_id", "candidates", "expires_at", F.lit(True).alias("known")), "clarification_id", "left")
    chosen = F.col("resolution") == "chosen_entity"
    listed = F.coalesce(F.array_contains("candidates", F.col("chosen_entity_id")), F.lit(False))
    known = F.coalesce("known", F.lit(False))
    first_look = (
        F.when(~known, "NOT_FOUND").when(F.col("answered_at") > F.col("expires_at"), "EXPIRED").when(F.col("resolution") == "reject", "REJECTED").when(F.col("resolution") == "create_new", "CREATED")
        .when(chosen & listed, "CHOSEN").otherwise("INVALID")
    )
    asked = asked.withColumn("look", first_look)
    picks = asked.filter("look = 'CHOSEN'").select("answer_id", "chosen_entity_id", F.col("answered_at").alias("at"), F.explode("candidates").alias("entity_id"))
    now = status_at(picks, history).withColumn("active", F.coalesce(F.col("entity_status") == "active", F.lit(False)))
    left = F.sort_array(F.collect_list(F.when(F.col("active"), F.col("entity_id"))))
    now = now.groupBy("answer_id").agg(F.max(F.col("active") & (F.col("entity_id") == F.col("chosen_entity_id"))).alias("still"), left.alias("left"))
    asked = asked.join(now, "answer_id", "left")
    look = F.when((F.col("look") == "CHOSEN") & ~F.col("still"), F.when(F.size("left") > 1, "SUPERSEDED").otherwise("RERUN")).otherwise(F.col("look"))
    counts = look.isin("REJECTED", "CREATED", "CHOSEN", "SUPERSEDED", "RERUN")
    asked = asked.withColumn("look", look).withColumn("counts", counts)
    closing = F.first(F.when(F.col("counts"), F.struct("answer_id", "look")), ignorenulls=True)
    by = closing.over(Window.partitionBy("clarification_id").orderBy("answered_at", "answer_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = asked.withColumn("by", by)
    late = F.col("by").isNotNull() & (F.col("by.answer_id") != F.col("answer_id")) & ~F.col("look").isin("NOT_FOUND", "EXPIRED")
    outcome = F.when(late, F.when(F.col("by.look") == "SUPERSEDED", "ALREADY_SUPERSEDED").otherwise("ALREADY_RESOLVED")).otherwise(F.col("look"))
    asked = asked.withColumn("outcome", outcome)
    told = asked.select("answer_id", "clarification_id", "outcome", F.when(F.col("outcome") == "CHOSEN", F.col("chosen_entity_id")).alias("entity_id"))
    new = asked.filter("outcome = 'SUPERSEDED'").select(
        F.concat("clarification_id", F.lit("+")).alias("clarification_id"), "request_id", F.col("left").alias("candidates"), F.col("answered_at").alias("created_at"),
        (F.col("answered_at") + F.make_interval(mins=F.lit(minutes))).alias("expires_at"), F.col("clarification_id").alias("supersedes_id"),
    )
    return told, new


def states(clarifications: DataFrame, outcomes: DataFrame, now: str, days: int = 7) -> DataFrame:
    """clarification_id and state at a time: superseded, resolved, expired or open; those made over
    ``days`` before are removed, whatever their state."""
    at = F.lit(now).cast("timestamp")
    closed = outcomes.filter(F.col("outcome").isin("REJECTED", "CREATED", "CHOSEN", "RERUN", "SUPERSEDED")).groupBy("clarification_id").agg(F.max(F.col("outcome") == "SUPERSEDED").alias("again"))
    rows = clarifications.filter(F.col("created_at") >= at - F.make_interval(days=F.lit(days))).join(closed, "clarification_id", "left")
    state = F.when(F.col("again"), "superseded").when(F.col("again").isNotNull(), "resolved").when(F.col("expires_at") < at, "expired").otherwise("open")
    return rows.select("clarification_id", state.alias("state"))
