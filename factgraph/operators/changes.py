"""State transitions: tables of requested changes against snapshots, giving outcomes and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions.text import normal
from factgraph.session import written

#: Merged entities, and those that they were merged into, that are broadcast; more are shuffled.
_BROADCAST = 300_000


def _first_of(requests: DataFrame, key: str) -> Column:
    """Number of a request among those on the same key: by request_id if there is one, else by all of
    its columns."""
    order = ["request_id"] if "request_id" in requests.columns else [c for c in requests.columns if c != key] or [key]
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """old, with the rows of new in place of those with the same keys. Of several new rows with the same
    keys the one stays that is last by ``order`` (by all its other columns, if none is given)."""
    order = order or [c for c in new.columns if c not in keys] or keys
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return old.join(last, keys, "left_anti").unionByName(last)


def insert_missing(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def replays(log: DataFrame) -> DataFrame:
    """operation_id, decision: per actor and idempotency key the first request executes; later ones
    with the same hash replay it, others are rejected."""
    order = Window.partitionBy("actor_id", "idempotency_key").orderBy("started_at", "operation_id")
    first = F.first("request_hash").over(order)
    decision = F.when(F.row_number().over(order) == 1, "execute").when(F.col("request_hash") == first, "replay").otherwise("reject")
    return log.select("operation_id", decision.alias("decision"))


def assert_statements(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, outcome, statement_id of requests with the key columns of a statement.

    A request that equals an asserted statement (missing bounds are equal) is a REUSE of it; of equal
    requests the first creates and the others reuse its statement.
    """
    keys = ["subject_entity_id", "predicate_key", "object_key", "valid_from", "valid_to"]
    have = existing.filter("status = 'asserted'").groupBy(*keys).agg(F.min("statement_id").alias("have_id"))
    r, h = requests.alias("r"), have.alias("h")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
    order = Window.partitionBy(*[F.col(f"r.{k}") for k in keys]).orderBy("r.requested_at", "r.request_id")
    rows = r.join(h, on, "left").select("r.request_id", "h.have_id", F.row_number().over(order).alias("k"), F.first("r.request_id").over(order).alias("first_id"))
    new_id = F.concat(F.lit("new:"), F.col("first_id").cast("string"))
    return rows.select("request_id", F.when(F.col("have_id").isNull() & (F.col("k") == 1), "CREATE").otherwise("REUSE").alias("outcome"), F.coalesce("have_id", new_id).alias("statement_id"))


def supersede(statements: DataFrame, requests: DataFrame) -> DataFrame:
    """New statements for requests (statement_id, object_string, valid_from; null inherits) on asserted
    statements: what replaces what, with fields that are not given taken over. Of several requests on
    one statement the first counts; after it the statement is superseded."""
    first = requests.withColumn("_k", _first_of(requests, "statement_id")).filter("_k = 1")
    patch = first.select("statement_id", F.col("object_string").alias("_s"), F.col("valid_from").alias("_f"))
    rows = statements.filter("status = 'asserted'").join(patch, "statement_id")
    return rows.select(
        F.concat(F.lit("new:"), F.col("statement_id")).alias("statement_id"), F.col("statement_id").alias("supersedes_id"), "subject_entity_id", "predicate_key",
        F.coalesce("_s", "object_string").alias("object_string"), F.coalesce("_f", "valid_from").alias("valid_from"),
    )


def retract(statements: DataFrame, requests: DataFrame) -> DataFrame:
    """statement_id, outcome: RETRACTED, NO_CHANGE if it is already (by an earlier request, too),
    REJECTED if superseded or unknown."""
    rows = requests.withColumn("_k", _first_of(requests, "statement_id")).join(statements.select("statement_id", "status"), "statement_id", "left")
    outcome = F.when((F.col("status") == "asserted") & (F.col("_k") == 1), "RETRACTED").when(F.col("status").isin("asserted", "retracted"), "NO_CHANGE").otherwise("REJECTED")
    return rows.select("statement_id", outcome.alias("outcome"))


def resolve(issues: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """key, outcome: open issues resolve by the first request with a note; other requests are rejected."""
    rows = requests.withColumn("_noted", F.trim(F.coalesce("note", F.lit(""))) != "")
    order = ["request_id"] if "request_id" in requests.columns else [c for c in requests.columns if c != key]
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_noted").orderBy(*order))).join(issues.select(key, "status"), key, "left")
    ok = (F.col("status") == "open") & F.col("_noted") & (F.col("_k") == 1)
    return rows.select(key, F.when(F.coalesce(ok, F.lit(False)), "RESOLVED").otherwise("REJECTED").alias("outcome"))


def merged_statements(statements: DataFrame, survivors: DataFrame) -> DataFrame:
    """Statements after merges: ends rewritten to survivors, and of asserted statements that became
    alike the one stays that had these ends before (else the smallest id), the others are retracted.

    survivors: entity_id, root of merged entities at least. Only asserted statements with an end that
    is merged, or that another was merged into, can become alike; no others are grouped.
    """
    to = survivors.filter("root <> entity_id").select("entity_id", "root")
    to = written(to.union(to.select(F.col("root").alias("entity_id"), "root").distinct()).groupBy("entity_id").agg(F.max(F.when(F.col("root") != F.col("entity_id"), F.col("root"))).alias("root")).withColumn("root", F.coalesce("root", "entity_id")), "merges")
    to = F.broadcast(to) if to.count() <= _BROADCAST else to
    rows = statements
    for end in ("subject", "object"):
        rows = rows.join(to.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("root").alias(f"_{end[0]}")), f"{end}_entity_id", "left")
    rows = rows.withColumn("new_subject", F.coalesce("_s", "subject_entity_id")).withColumn("new_object", F.coalesce("_o", "object_entity_id"))
    near = (F.col("_s").isNotNull() | F.col("_o").isNotNull()) & F.coalesce(F.col("status") == "asserted", F.lit(False))
    done = lambda df, status: df.select("statement_id", F.col("new_subject").alias("subject_entity_id"), "predicate_key", F.col("new_object").alias("object_entity_id"), status.alias("status"))
    apart, rows = done(rows.filter(~near), F.col("status")), rows.filter(near)
    moved = (F.col("new_subject") != F.col("subject_entity_id")) | ~F.col("new_object").eqNullSafe(F.col("object_entity_id"))
    key = ["new_subject", "predicate_key", "new_object", F.coalesce("object_string", F.col("object_number").cast("string")), "valid_from", "valid_to", "status"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(moved, "statement_id"))
    status = F.when((place > 1) & (F.max(moved).over(Window.partitionBy(*key))), "retracted").otherwise(F.col("status"))
    return apart.union(done(rows, status))


def merged_entities(entities: DataFrame, survivors: DataFrame) -> DataFrame:
    """Entities after merges (survivors: entity_id, root): merged ones point to their survivor, and
    their status says so; an entity on a cycle (root null) stays."""
    rows = entities.join(survivors.select("entity_id", "root"), "entity_id", "left")
    moved = F.coalesce(F.col("root") != F.col("entity_id"), F.lit(False))
    return rows.withColumns({"status": F.when(moved, "merged").otherwise(F.col("status")), "merged_into_entity_id": F.when(moved, F.col("root")).otherwise(F.col("merged_into_entity_id"))}).select(*entities.columns)


def merged_aliases(entities: DataFrame, aliases: DataFrame, survivors: DataFrame) -> DataFrame:
    """Aliases (entity_id, alias, norm, identity_strength) after merges: a merged entity's name becomes an
    authoritative alias of its survivor, its other aliases follow with the strength that they had.

    What another active entity has as an alias is not transferred, nor what the survivor has already,
    but that an authoritative one strengthens a supporting one. Of equal transfers to one survivor
    the strongest counts. The merged entity's own aliases stay where they are.
    """
    norm = lambda c: normal(F.col(c)).alias("norm")
    after = merged_entities(entities, survivors).select("entity_id", "canonical_name", "status")
    have = aliases.select("entity_id", "alias", norm("alias"), "identity_strength")
    to = survivors.filter("root IS NOT NULL AND root <> entity_id").select("entity_id", "root")
    active = after.filter("status = 'active'").select("entity_id")
    to = to.join(active.select(F.col("entity_id").alias("root")), "root", "left_semi")
    own = after.join(to, "entity_id").select("entity_id", "root", F.col("canonical_name").alias("alias"), norm("canonical_name"), F.lit("authoritative").alias("identity_strength"))
    other = have.join(to, "entity_id").join(own.select("entity_id", F.col("norm")), ["entity_id", "norm"], "left_anti").select("entity_id", "root", "alias", "norm", "identity_strength")
    moved = own.union(other)
    held = have.join(active, "entity_id", "left_semi").groupBy("norm").agg(F.min("entity_id").alias("_low"), F.max("entity_id").alias("_high"))
    moved = moved.join(held, "norm", "left").filter(F.col("_low").isNull() | ((F.col("_low") == F.col("root")) & (F.col("_high") == F.col("root"))))
    best = moved.groupBy(F.col("root").alias("entity_id"), "norm").agg(F.min(F.struct("identity_strength", "alias")).alias("_a"))
    best = best.select("entity_id", F.col("_a.alias").alias("alias"), "norm", F.col("_a.identity_strength").alias("identity_strength"))
    stronger = best.filter("identity_strength = 'authoritative'").select("entity_id", "norm", F.lit("authoritative").alias("_now"))
    kept = have.join(stronger, ["entity_id", "norm"], "left").select("entity_id", "alias", "norm", F.coalesce("_now", "identity_strength").alias("identity_strength"))
    return kept.union(best.join(have, ["entity_id", "norm"], "left_anti").select("entity_id", "alias", "norm", "identity_strength"))


def ingest_entities(items: DataFrame, existing: DataFrame) -> DataFrame:
    """batch_id, client_ref, entity_id, outcome of entities to be taken in (batch_id, client_ref,
    canonical_name, class_key): REUSE of an active one of that name and class, else CREATE; of equal
    ones in all batches the first creates, the others reuse it."""
    have = existing.filter("status = 'active'").groupBy(normal(F.col("canonical_name")).alias("norm"), "class_key").agg(F.min("entity_id").alias("_have"))
    rows = items.withColumn("norm", normal(F.col("canonical_name"))).join(have, ["norm", "class_key"], "left")
    order = Window.partitionBy("norm", "class_key").orderBy("batch_id", "client_ref")
    made = F.concat(F.lit("new:"), F.sha2(F.concat_ws(":", "class_key", "norm"), 256))
    outcome = F.when(F.col("_have").isNull() & (F.row_number().over(order) == 1), "CREATE").otherwise("REUSE")
    return rows.select("batch_id", "client_ref", F.coalesce("_have", made).alias("entity_id"), outcome.alias("outcome"))


def ingest_statements(items: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """batch_id, item, outcome, statement_id of statements of batches (batch_id, item, subject_ref,
    predicate_key, object_ref, object_string, valid_from, valid_to), whose ends are client references
    of the same batch or entity ids. An end that is neither is REJECTED; the others are asserted.

    entities: what ingest_entities gave, and known ids with a null batch_id and client_ref;
    existing: asserted statements with object_key, as assert_statements takes them.
    """
    own = entities.filter("client_ref IS NOT NULL").select("batch_id", "client_ref", "entity_id")
    known = entities.filter("client_ref IS NULL").select("entity_id").distinct()
    rows = items
    for end in ("subject", "object"):
        refs = own.select("batch_id", F.col("client_ref").alias(f"{end}_ref"), F.col("entity_id").alias(f"_{end}_own"))
        ids = known.select(F.col("entity_id").alias(f"{end}_ref"), F.lit(True).alias(f"_{end}_known"))
        rows = rows.join(refs, ["batch_id", f"{end}_ref"], "left").join(ids, f"{end}_ref", "left")
        rows = rows.withColumn(f"_{end}", F.coalesce(f"_{end}_own", F.when(F.col(f"_{end}_known"), F.col(f"{end}_ref"))))
    lost = F.col("_subject").isNull() | (F.col("object_ref").isNotNull() & F.col("_object").isNull())
    rows = rows.withColumn("_lost", lost).withColumn("request_id", F.concat_ws("/", "batch_id", "item"))
    key = F.when(F.col("object_ref").isNotNull(), F.concat(F.lit("entity:"), "_object")).otherwise(F.concat(F.lit("string:"), "object_string"))
    asked = rows.filter(~F.col("_lost")).select("request_id", F.col("_subject").alias("subject_entity_id"), "predicate_key", key.alias("object_key"), "valid_from", "valid_to", F.struct("batch_id", "item").alias("requested_at"))
    done = assert_statements(existing, asked)
    return rows.join(done, "request_id", "left").select("batch_id", "item", F.coalesce("outcome", F.lit("REJECTED")).alias("outcome"), "statement_id")


def merged_metadata(old: Column, new: Column) -> Column:
    """Metadata (maps) put together; where both have a key, the new value stands."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def batch_outcomes(items: DataFrame) -> DataFrame:
    """Per batch of (batch_id, outcome): counts, and failed if any item is rejected, else applied."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return items.groupBy("batch_id").agg(n("CREATE").alias("created"), n("REUSE").alias("reused"), n("REJECTED").alias("rejected"), F.when(n("REJECTED") > 0, "failed").otherwise("applied").alias("status"))


def dry_run(outcomes: DataFrame) -> DataFrame:
    """The same outcomes under the names of what would have been done."""
    return outcomes.withColumn("outcome", F.concat(F.lit("WOULD_"), F.col("outcome")))


def expired(requests: DataFrame, now: str, minutes: int = 30, days: int = 7) -> DataFrame:
    """request_id, state of open clarifications: open, expired, or gone when due to be removed."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")) / 60
    return requests.select("request_id", F.when(age > days * 1440, "gone").when(age > minutes, "expired").otherwise("open").alias("state"))
