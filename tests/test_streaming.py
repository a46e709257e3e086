"""Streams against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from factgraph.operators import changes, summaries
from factgraph.sources.tables import table, view
from factgraph.streaming import jobs


def streamed(spark, df, path, job, mode="append", name="out"):
    """The rows that a job over df, given as files, has put out when all input is used up."""
    df.repartition(1).write.mode("overwrite").parquet(path)
    source = spark.readStream.schema(df.schema).parquet(path)
    q = job(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path + "-state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_rolling_summary(spark, sf_dir, tmp_path):
    log = view(spark, sf_dir, "fx_operation_log").select("operation_id", "actor_id", "status", "idempotency_key", "started_at")
    end = log.agg(F.max("started_at")).first()[0]
    got = {(r.start, r.status): r.n for r in streamed(spark, log, str(tmp_path / "a"), jobs.rolling_summary, name="rolled").collect()}
    want = {(r.w.start, r.status): r.n for r in log.groupBy(F.window("started_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert all(k in got for k in want if k[0] < end - dt.timedelta(hours=3))


def test_first_requests(spark, sf_dir, tmp_path):
    log = view(spark, sf_dir, "fx_operation_log").select("operation_id", "actor_id", "idempotency_key", "request_hash", "started_at")
    got = streamed(spark, log, str(tmp_path / "b"), lambda x: jobs.first_requests(x, "365 days"), name="firsts").count()
    assert got == changes.replays(log).filter("decision = 'execute'").count()


def test_fingerprint_counts(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "fx_feedback").select(F.sha2(F.col("title"), 256).alias("fingerprint"), "created_at")
    got = streamed(spark, rows, str(tmp_path / "c"), jobs.fingerprint_counts, "complete", "prints")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in jobs.fingerprint_counts(rows).collect()}


def test_clarifications_expire(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("r1", at), ("r2", at + dt.timedelta(minutes=5))]
    path = str(tmp_path / "d")
    schema = "request_id string, created_at timestamp"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(path)
    later = [[("r3", at + dt.timedelta(hours=5))], [("r4", at + dt.timedelta(days=8))], [("r5", at + dt.timedelta(days=9))]]
    states = jobs.clarification_states(spark.readStream.schema(schema).parquet(path))
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    q = states.writeStream.format("memory").queryName("clarified").option("checkpointLocation", path + "-state").start()
    try:
        q.processAllAvailable()
        for rows in later:
            spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(path)
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {tuple(r) for r in spark.table("clarified").collect()}
    assert {(r, x) for r in ("r1", "r2") for x in ("open", "expired", "gone")} <= got and ("r4", "gone") not in got


def test_replay_decisions(spark, sf_dir, tmp_path):
    log = view(spark, sf_dir, "fx_operation_log").select("operation_id", F.lit(1).alias("actor_id"), "idempotency_key", "request_hash", "started_at")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = streamed(spark, log, str(tmp_path / "e"), lambda x: jobs.replay_decisions(x, 10000, "3650 days"), name="judged")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.operation_id: r.decision for r in got.collect()}
    assert got == {r.operation_id: r.decision for r in changes.replays(log).collect()} and set(got.values()) >= {"execute", "reject"}


def test_rolling_call_costs(spark, sf_dir, tmp_path):
    """Windows that are over come out with the sums of their batch twin."""
    calls = view(spark, sf_dir, "fx_llm_call_log")
    pricing = spark.createDataFrame([("openai", "model-a", "0.00000100", "0.00000200", "USD")], "provider string, model string, input_rate string, output_rate string, currency string").selectExpr("provider", "model", "CAST(input_rate AS DECIMAL(18,8)) AS input_rate", "CAST(output_rate AS DECIMAL(18,8)) AS output_rate", "currency")
    end = calls.agg(F.max("created_at")).first()[0]
    key = lambda r: (r.start, r.purpose, r.status)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in tuple(r)[4:])
    want = {key(r): plain(r) for r in summaries.rolling_calls(summaries.call_costs(calls, pricing), "6 hours").collect()}
    got = {key(r): plain(r) for r in streamed(spark, calls, str(tmp_path / "costs"), lambda df: jobs.rolling_call_costs(df, pricing, "6 hours"), name="costs").collect()}
    assert got and all(want[k] == x for k, x in got.items()) and any(x[3] and x[4] for x in got.values())
    assert all(k in got for k in want if k[0] < end - dt.timedelta(hours=9))
