"""Roll-ups of operations, calls, feedback, reviews and retrieval quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.segments import ranked_values


def created_between(df: DataFrame, after: str | None = None, before: str | None = None, column: str = "created_at") -> DataFrame:
    """Rows created in the closed range; a missing bound is open."""
    if after is not None and before is not None and after > before:
        raise ValueError("the range ends before it begins")
    if after is not None:
        df = df.filter(F.col(column) >= F.lit(after).cast("timestamp"))
    if before is not None:
        df = df.filter(F.col(column) <= F.lit(before).cast("timestamp"))
    return df


def page(df: DataFrame, limit: int, offset: int = 0, at: str = "created_at", key: str = "id") -> DataFrame:
    """Newest rows first, ties by id."""
    return df.orderBy(F.desc(at), F.desc(key)).offset(offset).limit(limit)


def counts_by(df: DataFrame, blocks: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """block, key, n: for each block the rows of a filter counted by a key, in one pass.

    A row gives one key for each block that it belongs to; without a key a block is a single total.
    """
    one = [F.when(cond, F.struct(F.lit(name).alias("block"), (F.lit("") if key is None else key.cast("string")).alias("key"))) for name, (cond, key) in blocks.items()]
    rows = df.select(F.explode(F.array_compact(F.array(*one))).alias("_")).select("_.*").filter("key IS NOT NULL")
    return rows.groupBy("block", "key").agg(F.count("*").alias("n"))


def operations_summary(log: DataFrame) -> DataFrame:
    failed, rejected = F.col("status") == "failed", F.col("status") == "rejected"
    return counts_by(log, {"total": (F.lit(True), None), "by_status": (F.lit(True), F.col("status")), "failed_by_operation": (failed, F.col("operation_name")), "rejected_by_error_code": (rejected, F.col("error_code"))})


def call_costs(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """calls with cost_amount, cost_currency and cost_status: the reported cost, else tokens times
    rates, else unknown (a null amount, never zero). pricing has a row for each priced model."""
    priced = calls.join(pricing, ["provider", "model"], "left")
    known = F.col("input_rate").isNotNull() & F.col("output_rate").isNotNull() & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    reported = F.col("provider_reported_cost").isNotNull()
    estimate = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")).cast("decimal(18,8)")
    return priced.select(
        *calls.columns,
        F.when(reported, F.col("provider_reported_cost")).when(known, estimate).alias("cost_amount"),
        F.when(reported, F.lit("USD")).otherwise(F.col("currency")).alias("cost_currency"),
        F.when(reported, "provider_reported").when(known, "estimated").otherwise("unknown").alias("cost_status"),
    )


def _call_totals() -> list[Column]:
    known = (F.col("cost_status") != "unknown") & F.col("cost_amount").isNotNull() & F.col("cost_currency").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count("*").alias("calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        F.count_if(known).alias("known_cost_calls"), F.count_if(~known).alias("unknown_cost_calls"), F.sum("cost_amount").cast("double").alias("cost"),
    ]


def calls_summary(costed: DataFrame) -> DataFrame:
    """One row: calls, tokens, calls with known and unknown cost, and the known cost in all."""
    return costed.agg(*_call_totals())


def rolling_calls(costed: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """calls_summary per window, purpose and status: start, end, purpose, status and the sums. For a
    stream, ``late`` is its watermark: windows come out once they are over by that much."""
    rows = costed if late is None else costed.withWatermark("created_at", late)
    rows = rows.groupBy(F.window("created_at", window).alias("_w"), "purpose", "status").agg(*_call_totals())
    return rows.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "purpose", "status", *[c for c in rows.columns if c not in ("_w", "purpose", "status")])


def occurrences(reports: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Per fingerprint: how often it was reported, when last, and the first report's id."""
    return reports.groupBy(key).agg(F.count("*").alias("occurrence_count"), F.max("created_at").alias("last_seen_at"), F.min("report_id").alias("first_report_id"))


def feedback_summary(issues: DataFrame) -> DataFrame:
    return counts_by(issues, {"open_total": (F.lit(True), None), "by_severity": (F.lit(True), F.col("severity")), "by_type": (F.lit(True), F.col("feedback_type")), "repeated": (F.col("occurrence_count") > 1, None)})


def nearest_rank(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles: the value at place round(share * (n - 1)), halves to even, in sorted order."""
    return ranked_values(df, groups, value, {name: F.bround(F.lit(p) * (F.col("n") - 1)) for name, p in shares.items()})


def retrieval_quality(ranks: DataFrame, groups: list[str]) -> DataFrame:
    """Of (case_id, rank; null is a miss): cases, recall at 1, 3 and 10, mean reciprocal rank, misses."""
    best = ranks.groupBy(*groups, "case_id").agg(F.min("rank").alias("rank"))
    at = [F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6).alias(f"recall_at_{k}") for k in (1, 3, 10)]
    return best.groupBy(*groups).agg(F.count("*").alias("cases"), *at, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("zero_hits"))


#: Decisions that count as the same, and those that change the ontology when wrong.
AGREE, UNSAFE = {"approve": "accept", "reuse_existing": "reuse", "reject": "reject", "manual_review": "manual"}, ("approve", "reuse_existing")


def review_scores(cases: DataFrame, sure: float = 0.85) -> DataFrame:
    """One row: cases compared, agreed, wrong though sure, and of these the unsafe and conservative ones."""
    same = reduce(lambda c, kv: c.when(F.col("model_decision") == kv[0], kv[1]), AGREE.items(), F).otherwise("other")
    human = reduce(lambda c, kv: c.when(F.col("human_decision") == kv[0], kv[1]), AGREE.items(), F).otherwise("other")
    agreed = same == human
    wrong = ~agreed & (F.col("confidence") >= sure)
    unsafe = F.col("model_decision").isin(*UNSAFE)
    return cases.agg(F.count("*").alias("compared"), F.count_if(agreed).alias("agreed"), F.count_if(wrong).alias("wrong_confident"), F.count_if(wrong & unsafe).alias("unsafe"), F.count_if(wrong & ~unsafe).alias("conservative"), (F.count_if(wrong & unsafe) == 0).alias("promotion_ready"))


def outcomes(decisions: DataFrame, key: str) -> DataFrame:
    """Identity outcome per request from its candidates' decisions: AMBIGUOUS with an uncertain one
    or several that are the same, MATCH with one that is, else NO_MATCH."""
    agg = decisions.groupBy(key).agg(F.count_if(F.col("decision") == "SAME").alias("same"), F.count_if(F.col("decision") == "UNCERTAIN").alias("uncertain"))
    return agg.select(key, F.when((F.col("uncertain") > 0) | (F.col("same") > 1), "AMBIGUOUS").when(F.col("same") == 1, "MATCH").otherwise("NO_MATCH").alias("outcome"))
