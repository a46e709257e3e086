"""Statements: conflicts, duplicates, evidence, timelines and effective state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions.temporal import overlap


def with_status(statements: DataFrame, intent: str) -> DataFrame:
    """Asserted statements, or all of them for a historical intent."""
    return statements if intent == "historical" else statements.filter("status = 'asserted'")


def select_statements(statements: DataFrame, **wanted: str | None) -> DataFrame:
    """Statements for which every given column has the given value."""
    for column, value in wanted.items():
        if value is not None:
            statements = statements.filter(F.col(column) == value)
    return statements


def touching(statements: DataFrame, ids: DataFrame) -> DataFrame:
    """Statements with an entity of ``ids`` (column entity_id) as subject or object, each once."""
    subject = statements.join(ids, statements.subject_entity_id == ids.entity_id, "left_semi")
    other = statements.join(ids, statements.object_entity_id == ids.entity_id, "left_semi")
    return subject.union(other).dropDuplicates(["statement_id"])


#: Intervals of a key beyond which it is parted by time, and how many slices it then has at most.
SLICED, SLICES = 2000, 512


def overlapping_pairs(rows: DataFrame, key: list[str], id_col: str = "statement_id", sliced: int = SLICED, slices: int = SLICES) -> DataFrame:
    """Pairs (structs a and b) of rows of the same key whose validity (valid_from, valid_to; a missing
    bound is open) overlaps, each once; a begins first (the smaller id, if both begin at once).

    A sweep in slices of time: each row is at home in the slice in which it begins, and asks in all
    slices that it covers for rows that begin after it there. Keys of over ``sliced`` rows are parted
    at the quantiles of their beginnings, so that no task holds all of a hot key; others are one slice.
    Rows whose key has a null have no pairs.
    """
    begin, end = F.unix_micros(F.col("valid_from").cast("timestamp")), F.unix_micros(F.col("valid_to").cast("timestamp"))
    rows = rows.select(*key, F.struct(*rows.columns).alias("row"), F.col(id_col).alias("id"), begin.alias("begin"), end.alias("end"))
    hot = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > sliced).select(*key)
    shares = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    cuts = rows.join(hot, key, "left_semi").groupBy(*key).agg(F.array_distinct(F.percentile_approx("begin", shares, 10 * slices)).alias("cuts"))
    rows = rows.join(cuts, key, "left")
    no_cuts = F.array().cast("array<bigint>")
    slice_of = lambda x, default: F.when(x.isNull(), default).otherwise(F.size(F.filter(F.coalesce("cuts", no_cuts), lambda c: c <= x)))
    rows = rows.withColumn("home", slice_of(F.col("begin"), F.lit(0))).withColumn("last", slice_of(F.col("end"), F.size(F.coalesce("cuts", no_cuts))))
    asks = rows.filter("last >= home").select(*key, F.explode(F.sequence("home", "last")).alias("slice"), F.col("row").alias("a"), F.col("id").alias("a_id"), F.col("begin").alias("a_begin"), F.col("end").alias("a_end"))
    homes = rows.select(*key, F.col("home").alias("slice"), F.col("row").alias("b"), F.col("id").alias("b_id"), F.col("begin").alias("b_begin"), F.col("end").alias("b_end"))
    lowest = F.lit(-(1 << 63)).cast("long")
    a, b = F.coalesce("a_begin", lowest), F.coalesce("b_begin", lowest)
    first = (a < b) | ((a == b) & (F.col("a_id") < F.col("b_id")))
    met = F.coalesce(F.col("b_begin") <= F.col("a_end"), F.lit(True)) & F.coalesce(F.col("a_begin") <= F.col("b_end"), F.lit(True))
    return asks.join(homes, [*key, "slice"]).filter(first & met).select("a", "b")


def cardinality_conflicts(statements: DataFrame, predicates: list[str]) -> DataFrame:
    """Pairs of asserted statements of single-valued predicates whose values differ and whose
    validity overlaps: subject_entity_id, predicate_key, statement_a_id, statement_b_id (a < b),
    value_a, value_b. Subjects with many statements are swept in slices of time."""
    rows = statements.filter(F.col("status").eqNullSafe("asserted") & F.col("predicate_key").isin(predicates))
    value = F.coalesce("object_entity_id", "object_string", F.col("object_number").cast("string"))
    rows = rows.select("subject_entity_id", "predicate_key", "statement_id", value.alias("value"), "valid_from", "valid_to")
    pairs = overlapping_pairs(rows, ["subject_entity_id", "predicate_key"]).filter("a.value <> b.value")
    turned = F.col("a.statement_id") > F.col("b.statement_id")
    low, high = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    pairs = pairs.select(low.alias("a"), high.alias("b"))
    return pairs.select("a.subject_entity_id", "a.predicate_key", F.col("a.statement_id").alias("statement_a_id"), F.col("b.statement_id").alias("statement_b_id"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


def ordered_pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("statement_a_id"), F.greatest(a, b).alias("statement_b_id")]


def new_pairs(pairs: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """Pairs, in whichever order they come, that are not open yet, each once."""
    keys = ["statement_a_id", "statement_b_id"]
    ordered = [x.select(*ordered_pair(F.col(keys[0]), F.col(keys[1]))).distinct() for x in (pairs, open_pairs)]
    return ordered[0].join(ordered[1], keys, "left_anti")


def conflicts_of(conflicts: DataFrame, statements: DataFrame, entity: str) -> DataFrame:
    """Conflicts with the entity as subject or object on either side, each once."""
    sides = conflicts.withColumn("statement_id", F.explode(F.array("statement_a_id", "statement_b_id")))
    found = sides.join(statements.filter((F.col("subject_entity_id") == entity) | (F.col("object_entity_id") == entity)).select("statement_id"), "statement_id", "left_semi")
    return found.select("statement_a_id", "statement_b_id").distinct()


def semantic_duplicates(statements: DataFrame, object_key: Column) -> DataFrame:
    """Asserted statements that repeat another one's subject, predicate, object and bounds (missing
    bounds are equal): statement_id, kept_statement_id (the smallest id)."""
    key = ["subject_entity_id", "predicate_key", "object_key", "valid_from", "valid_to"]
    rows = statements.filter("status = 'asserted'").withColumn("object_key", object_key)
    first = F.min("statement_id").over(Window.partitionBy(*key))
    return rows.select("statement_id", first.alias("kept_statement_id")).filter("statement_id <> kept_statement_id")


def evidence_stats(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """statement_id, n_evidence, max_reliability."""
    rows = evidence.join(sources.select("source_id", "reliability"), "source_id", "left")
    return rows.groupBy("statement_id").agg(F.count("*").alias("n_evidence"), F.max("reliability").alias("max_reliability"))


def add_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that existing lacks by (statement, source, excerpt), missing excerpts being equal."""
    key = ["statement_id", "source_id", "excerpt"]
    fresh = new.dropDuplicates(key).alias("n")
    have = existing.select(*key).alias("e")
    same = F.col("n.statement_id").eqNullSafe(F.col("e.statement_id")) & F.col("n.source_id").eqNullSafe(F.col("e.source_id")) & F.col("n.excerpt").eqNullSafe(F.col("e.excerpt"))
    return fresh.join(have, same, "left_anti")


def explanations(statements: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Per statement: its number of sources and their ids, the most reliable first, comma-joined."""
    rows = evidence.join(sources.select("source_id", "reliability"), "source_id", "left")
    ordered = F.sort_array(F.collect_set(F.struct((-F.coalesce("reliability", F.lit(-1))).alias("r"), F.col("source_id"))))
    told = rows.groupBy("statement_id").agg(ordered.alias("told"))
    out = statements.select("statement_id", "predicate_key").join(told, "statement_id", "left")
    return out.select("statement_id", "predicate_key", F.coalesce(F.array_size("told"), F.lit(0)).cast("long").alias("n_sources"), F.array_join("told.source_id", ",").alias("sources"))


def timeline(statements: DataFrame, survivors: DataFrame) -> DataFrame:
    """Each surviving entity's statements in order of validity start, else of assertion."""
    key = F.coalesce("root", "subject_entity_id")
    rows = statements.join(survivors, statements.subject_entity_id == survivors.entity_id, "left").withColumn("survivor_id", key)
    at = F.coalesce("valid_from", "asserted_at")
    place = F.row_number().over(Window.partitionBy("survivor_id").orderBy(at, "asserted_at", "statement_id"))
    return rows.select("survivor_id", place.alias("place"), "statement_id", "predicate_key", "status")


def effective_state(statements: DataFrame, survivors: DataFrame, most: int = 20) -> DataFrame:
    """Newest asserted statements of each survivor and predicate, at most so many, and whether more exist."""
    rows = statements.filter("status = 'asserted'").join(survivors, statements.subject_entity_id == survivors.entity_id, "left")
    rows = rows.withColumn("survivor_id", F.coalesce("root", "subject_entity_id"))
    group = Window.partitionBy("survivor_id", "predicate_key")
    place = F.row_number().over(group.orderBy(F.desc("asserted_at"), F.desc("statement_id")))
    rows = rows.withColumn("place", place).withColumn("truncated", F.count("*").over(group) > most)
    return rows.filter(F.col("place") <= most).select("survivor_id", "predicate_key", "place", "statement_id", "truncated")


def neighbourhood(statements: DataFrame, survivors: DataFrame) -> DataFrame:
    """Per surviving entity and asserted entity-valued statement: direction and surviving neighbour."""
    rows = statements.filter("status = 'asserted' AND value_kind = 'entity'").select("statement_id", "predicate_key", "subject_entity_id", "object_entity_id")
    s, o = survivors.select(F.col("entity_id").alias("subject_entity_id"), F.col("root").alias("s")), survivors.select(F.col("entity_id").alias("object_entity_id"), F.col("root").alias("o"))
    rows = rows.join(s, "subject_entity_id", "left").join(o, "object_entity_id", "left")
    rows = rows.select("statement_id", "predicate_key", F.coalesce("s", "subject_entity_id").alias("s"), F.coalesce("o", "object_entity_id").alias("o"))
    ends = F.when(F.col("s") == F.col("o"), F.array(F.struct(F.col("s").alias("entity_id"), F.lit("self").alias("direction"), F.col("o").alias("neighbour_id")))).otherwise(
        F.array(F.struct(F.col("s").alias("entity_id"), F.lit("outgoing").alias("direction"), F.col("o").alias("neighbour_id")), F.struct(F.col("o").alias("entity_id"), F.lit("incoming").alias("direction"), F.col("s").alias("neighbour_id")))
    )
    return rows.select("statement_id", "predicate_key", F.explode(ends).alias("_")).select("_.*", "predicate_key", "statement_id")


def related(statements: DataFrame, most: int = 5) -> DataFrame:
    """For each statement the newest other asserted ones of its subject, at most so many. Only the
    first ``most`` + 1 of a subject can be among them, so each subject's history is read once."""
    order = Window.partitionBy("subject_entity_id").orderBy(F.desc("asserted_at"), F.desc("statement_id"))
    best = statements.filter("status = 'asserted'").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most + 1)
    best = best.groupBy("subject_entity_id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("statement_id").alias("id")))).alias("best"))
    rows = statements.select("statement_id", "subject_entity_id").join(best, "subject_entity_id")
    # Places are counted within the subject's short list, so nothing is shuffled once it is multiplied.
    others = F.slice(F.filter(F.transform("best", lambda x: x["id"]), lambda x: x != F.col("statement_id")), 1, most)
    return rows.select("statement_id", F.posexplode(others).alias("place", "related_id")).select("statement_id", "related_id", (F.col("place") + 1).alias("place"))


def overlap_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key: pairs, how many pairs of its intervals (valid_from, valid_to; a missing bound is open)
    meet. Of all pairs those count out in which one interval ends before the other begins, and these
    are counted in one pass over the key's bounds in order of time, not by pairs."""
    begins = rows.filter("valid_from IS NOT NULL").select(*key, F.col("valid_from").alias("at"), F.lit(0).alias("ends"))
    ends = rows.filter("valid_to IS NOT NULL").select(*key, F.col("valid_to").alias("at"), F.lit(1).alias("ends"))
    # At one time beginnings come first: closed intervals that touch meet.
    order = Window.partitionBy(*key).orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = begins.union(ends).withColumn("over", F.sum("ends").over(order))
    apart = bounds.filter("ends = 0").groupBy(*key).agg(F.sum("over").alias("apart"))
    # An interval that ends before it begins is counted as apart from itself.
    wrong = F.count_if(F.col("valid_to") < F.col("valid_from"))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), wrong.alias("wrong"))
    return sizes.join(apart, key, "left").select(*key, (F.expr("n * (n - 1) DIV 2") - F.coalesce("apart", F.lit(0)) + F.col("wrong")).alias("pairs"))
