"""Fact-graph views over the provided tables, and reading of these tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.session import share_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: SQL of each view; it runs alike in Spark and DuckDB, but for the name of the SHA-256 function.
VIEWS = {
    "fx_entity": """
SELECT 'region:' || CAST(r_regionkey AS STRING) AS entity_id, r_name AS canonical_name, 'Place' AS class_key, 'active' AS status, CAST(NULL AS STRING) AS merged_into_entity_id, TIMESTAMP '2001-06-01 00:00:00' AS updated_at FROM region
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), n_name, 'Place', 'active', NULL, TIMESTAMP '2001-06-01 00:00:00' FROM nation
UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), c_name, 'Organization', CASE WHEN c_custkey % 50 = 7 THEN 'deprecated' ELSE 'active' END, NULL, TIMESTAMP '2001-03-01 00:00:00' FROM customer
UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), s_name, 'Organization', 'active', NULL, TIMESTAMP '2000-12-01 00:00:00' FROM supplier
UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), p_name, 'Product', CASE WHEN p_partkey % 10 = 3 OR p_partkey % 100 = 12 THEN 'merged' ELSE 'active' END, CASE WHEN p_partkey % 10 = 3 OR p_partkey % 100 = 12 THEN 'part:' || CAST(p_partkey - 1 AS STRING) END, TIMESTAMP '2000-01-01 00:00:00' FROM part
UNION ALL SELECT 'order:' || CAST(o_orderkey AS STRING), 'Order#' || CAST(o_orderkey AS STRING), 'Event', 'active', NULL, o_orderdate FROM orders
""",
    "fx_entity_alias": """
SELECT 'part:' || CAST(p_partkey AS STRING) AS entity_id, '  ' || upper(p_name) || '  ' || lower(p_brand) AS alias, CASE WHEN p_partkey % 7 = 0 THEN 'authoritative' ELSE 'supporting' END AS identity_strength FROM part
UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), c_name || ' ' || c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 'authoritative' ELSE 'supporting' END FROM customer
""",
    "fx_statement": """
SELECT 'st:pp:' || CAST(o_orderkey AS STRING) AS statement_id, 'customer:' || CAST(o_custkey AS STRING) AS subject_entity_id, 'preferredPriority' AS predicate_key, 'string' AS value_kind, CAST(NULL AS STRING) AS object_entity_id, o_orderpriority AS object_string, CAST(NULL AS DECIMAL(18,2)) AS object_number,
 CASE WHEN o_orderkey % 20 = 0 THEN 'retracted' WHEN o_orderstatus = 'F' THEN 'superseded' ELSE 'asserted' END AS status,
 o_orderdate AS asserted_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS valid_from, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL '30' DAY END AS valid_to,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 20 <> 0 THEN CASE WHEN o_orderkey % 97 = 1 THEN NULL WHEN o_orderkey % 89 = 1 THEN 'st:pp:-1' WHEN o_orderkey % 83 = 1 THEN 'st:pp:' || CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING) WHEN o_orderkey % 79 = 1 THEN 'st:ob:' || CAST(o_orderkey AS STRING) ELSE 'st:pp:' || CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING) END END AS superseded_by_statement_id FROM orders
UNION ALL SELECT 'st:ob:' || CAST(o_orderkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), 'orderedBy', 'entity', 'customer:' || CAST(o_custkey AS STRING), NULL, NULL, 'asserted', o_orderdate, o_orderdate, NULL, NULL FROM orders
UNION ALL SELECT 'st:tp:' || CAST(o_orderkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), 'totalPrice', 'number', NULL, NULL, CAST(o_totalprice AS DECIMAL(18,2)), 'asserted', o_orderdate, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'st:li:' || concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)), 'order:' || CAST(l_orderkey AS STRING), 'contains', 'entity', 'part:' || CAST(l_partkey AS STRING), NULL, NULL, CASE l_returnflag WHEN 'R' THEN 'retracted' WHEN 'A' THEN 'superseded' ELSE 'asserted' END, l_shipdate, l_shipdate, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL '14' DAY END, NULL FROM lineitem
UNION ALL SELECT 'st:pd:' || CAST(p_partkey AS STRING), 'part:' || CAST(p_partkey AS STRING), 'description', 'string', NULL, p_type || ' ' || p_name, NULL, 'asserted', TIMESTAMP '2000-01-01 00:00:00', NULL, NULL, NULL FROM part
UNION ALL SELECT 'st:cl:' || CAST(c_custkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'locatedAt', 'entity', 'nation:' || CAST(c_nationkey AS STRING), NULL, NULL, 'asserted', TIMESTAMP '1996-01-01 00:00:00', TIMESTAMP '1996-01-01 00:00:00', NULL, NULL FROM customer
UNION ALL SELECT 'st:nr:' || CAST(n_nationkey AS STRING), 'nation:' || CAST(n_nationkey AS STRING), 'locatedAt', 'entity', 'region:' || CAST(n_regionkey AS STRING), NULL, NULL, 'asserted', TIMESTAMP '1996-01-01 00:00:00', NULL, NULL, NULL FROM nation
UNION ALL SELECT 'st:od:' || CAST(o_orderkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), 'orderedBy', 'entity', 'customer:' || CAST(o_custkey AS STRING), NULL, NULL, 'asserted', o_orderdate + INTERVAL '1' DAY, o_orderdate, NULL, NULL FROM orders WHERE o_orderkey % 25 = 0
UNION ALL SELECT 'st:td:' || CAST(o_orderkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), 'totalPrice', 'number', NULL, NULL, CAST(o_totalprice AS DECIMAL(18,2)), 'asserted', o_orderdate + INTERVAL '1' DAY, NULL, NULL, NULL FROM orders WHERE o_orderkey % 40 = 0
""",
    "fx_source": """
SELECT 'src:' || CAST(s_suppkey AS STRING) AS source_id, CASE s_suppkey % 5 WHEN 0 THEN 'Wiki' WHEN 1 THEN 'Corp Wiki' WHEN 2 THEN 'corp-wiki ' WHEN 3 THEN 'Tracker' ELSE NULL END AS source_system, CASE WHEN s_suppkey % 11 <> 0 THEN 'ext-' || CAST(s_suppkey % 37 AS STRING) END AS external_id, CAST((s_suppkey % 101) / 100.0 AS DECIMAL(5,4)) AS reliability FROM supplier
""",
    "fx_evidence": """
SELECT 'st:li:' || concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS statement_id, 'src:' || CAST(l_suppkey AS STRING) AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN 'line ' || CAST(l_linenumber AS STRING) END AS excerpt FROM lineitem WHERE l_returnflag <> 'A'
""",
    "fx_operation_log": """
SELECT event_id AS operation_id, user_id AS actor_id, event_type AS operation_name, CASE WHEN event_type <> 'error' THEN 'success' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'rejected' END AS status, CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'E' || CAST(event_id % 7 AS STRING) END AS error_code, 'k' || CAST(event_id % 400 AS STRING) AS idempotency_key, sha2(event_type || props, 256) AS request_hash, ts AS started_at, ts AS created_at FROM events
""",
    "fx_llm_call_log": """
SELECT event_id AS call_id, user_id AS actor_id, CASE user_id % 3 WHEN 0 THEN 'mock' WHEN 1 THEN 'openai' ELSE 'other' END AS provider, CASE user_id % 3 WHEN 0 THEN 'mock-reviewer' WHEN 1 THEN 'model-a' ELSE 'model-b' END AS model, event_type AS purpose, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN event_id % 10 <> 3 THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens, CASE WHEN event_id % 10 <> 4 THEN CAST(floor(value) AS BIGINT) END AS output_tokens, CASE WHEN event_id % 17 = 0 THEN CAST(0.05 AS DECIMAL(18,8)) END AS provider_reported_cost, ts AS created_at FROM events WHERE event_type IN ('view', 'click')
""",
    "fx_feedback": """
SELECT event_id AS report_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'data_quality' ELSE 'ambiguity' END AS feedback_type, CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, 'Issue  ' || props AS title, 'Seen by user ' || CAST(user_id % 20 AS STRING) AS description, ts AS created_at FROM events WHERE event_type = 'error'
""",
    "fx_review_eval": """
SELECT doc_id AS case_id, CASE doc_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'reuse_existing' ELSE 'manual_review' END AS model_decision, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'approve' ELSE 'manual_review' END AS human_decision, CAST((doc_id % 101) / 100.0 AS DECIMAL(5,4)) AS confidence FROM labels
""",
    "fx_content_ingest": """
SELECT doc_id * 10 AS ingest_id, 'doc-src:' || source AS source_id, text AS content, 'text' AS content_format, TIMESTAMP '2001-01-01 00:00:00' AS captured_at FROM documents
UNION ALL SELECT doc_id * 10 + 1, 'doc-src:' || source, text || '  ', 'text', TIMESTAMP '2001-01-02 00:00:00' FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id * 10 + 2, 'doc-src:' || source, 'withdrawn', 'text', TIMESTAMP '2001-01-03 00:00:00' FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT doc_id * 10 + 3, 'doc-src:' || source, text, 'text', TIMESTAMP '2001-01-04 00:00:00' FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT 10000000000 + page_id, 'page-src:' || CAST(page_id % 50 AS STRING), html, 'html', TIMESTAMP '2001-01-01 00:00:00' FROM pages
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table, with its local times read as instants in UTC."""
    share_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact-graph view; nothing is read before it is used."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\bFROM {t}\b", VIEWS[name])}
    # Tables are handed in by name, so no view of the session is touched.
    return spark.sql(re.sub(rf"\bFROM ({'|'.join(TABLES)})\b", r"FROM {\1}", VIEWS[name]), **used)


def duckdb_views(sql: str) -> str:
    """sql with the views that it names put in front as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    bodies = [f"{n} AS ({VIEWS[n].strip().replace('sha2(event_type || props, 256)', 'sha256(event_type || props)')})" for n in used]
    body = sql.strip()
    if not bodies:
        return body
    if re.match("WITH RECURSIVE", body, re.I):
        return "WITH RECURSIVE " + ", ".join(bodies) + ", " + body[len("WITH RECURSIVE") :]
    if re.match("WITH ", body, re.I):
        return "WITH " + ", ".join(bodies) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(bodies) + " " + body
