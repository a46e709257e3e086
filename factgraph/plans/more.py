"""More registered queries: filters, joins, roll-ups, sets, keys, governance and state jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions import identity as ids
from factgraph.functions import temporal, text
from factgraph.operators import changes, content, facts, governance, graph, identity, ontology, proposals, redaction, retrieval, summaries
from factgraph.operators.segments import Segments
from factgraph.plans.core import AS_OF, CLOSED, DECIDED, NAMES, ROOTS, _closed, _decided, _named, _requests, query
from factgraph.sources.tables import table, view

# Scans and sinks


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def a01_typed_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT case_id, model_decision, human_decision FROM fx_review_eval WHERE human_decision <> 'manual_review'")
def a03_review_cases(spark, sf_dir):
    return view(spark, sf_dir, "fx_review_eval").filter("human_decision <> 'manual_review'").select("case_id", "model_decision", "human_decision")


@query("""
WITH s AS (SELECT DISTINCT p_brand AS k, p_type AS label FROM part), i AS (SELECT DISTINCT sha256(concat_ws(':', k, label)) AS id FROM s)
SELECT id FROM i WHERE id NOT IN (SELECT sha256(concat_ws(':', p_brand, p_type)) FROM part WHERE p_partkey % 2 = 0)""")
def a05_seed_missing(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    have = parts.filter("p_partkey % 2 = 0").select(F.sha2(F.concat_ws(":", "p_brand", "p_type"), 256).alias("id"))
    return ontology.seed(have, parts.select("p_brand", "p_type"), "p_brand", "p_type").select("id")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE label = 3")
def a09_rebuild_partition(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rows.filter("label <> 3").union(rows.filter("label = 3").select("vec_id", (F.col("label") + 100).cast("int")))


@query("SELECT o_orderkey, coalesce(n_name, 'unknown') AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def a12_backfill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "orders").join(c, "o_custkey", "left").join(n, "n_nationkey", "left")
    return rows.select("o_orderkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


# Filters


@query("SELECT DISTINCT p_type AS key, p_brand AS label FROM part WHERE contains(lower(p_type), 'brass') OR contains(lower(p_brand), 'brass') ORDER BY key, label")
def b06_ontology_search(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("label")).distinct()
    return ontology.search(terms, "BRASS", 1 << 20)


@query("SELECT predicate_key, count(*) AS n FROM fx_statement WHERE predicate_key IN ('contains', 'locatedAt') AND value_kind = 'entity' AND status = 'asserted' GROUP BY 1")
def b10_allowed_facts(spark, sf_dir):
    allowed = spark.createDataFrame([("contains",), ("locatedAt",)], "predicate_key string")
    rows = view(spark, sf_dir, "fx_statement").filter("value_kind = 'entity' AND status = 'asserted'")
    return rows.join(allowed, "predicate_key", "left_semi").groupBy("predicate_key").agg(F.count("*").alias("n"))


@query("SELECT 'neutral' AS intent, count(*) AS n FROM fx_statement WHERE status = 'asserted' UNION ALL SELECT 'historical', count(*) FROM fx_statement")
def b11_status_by_intent(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_statement")
    counts = [facts.with_status(rows, i).agg(F.count("*").alias("n")).select(F.lit(i).alias("intent"), "n") for i in ("neutral", "historical")]
    return counts[0].union(counts[1])


@query("SELECT class_key, count(*) AS n FROM fx_entity WHERE status = 'active' GROUP BY 1")
def b12_active(spark, sf_dir):
    return view(spark, sf_dir, "fx_entity").filter("status = 'active'").groupBy("class_key").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT entity_id, coalesce(merged_into_entity_id, 'nobody') AS parent FROM fx_entity) SELECT entity_id FROM e WHERE entity_id = parent OR parent = 'part:6'")
def b16_no_self_parent(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_entity").withColumn("parent", F.coalesce("merged_into_entity_id", F.lit("nobody")))
    return rows.filter("entity_id = parent OR parent = 'part:6'").select("entity_id")


@query("""
WITH f AS (SELECT sha256(feedback_type || severity) AS fingerprint, report_id % 5 = 0 AS closed FROM fx_feedback) SELECT fingerprint, count(*) AS n FROM f WHERE NOT closed GROUP BY 1 HAVING count(*) > 1""")
def b18_open_uniqueness(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_feedback").filter("report_id % 5 <> 0").withColumn("fingerprint", F.sha2(F.concat("feedback_type", "severity"), 256))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT event_id, '{\"k\":' || CAST(props->>'k' AS VARCHAR) || ',\"api_token\":\"[REDACTED]\",\"title\":\"[REDACTED]\"}' AS payload FROM events WHERE event_type = 'click'")
def b20_redacted_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'click'")
    secret = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "api_token": "abc", "title": "free text"}'))
    return redaction.redact(rows.select("event_id", secret.alias("payload")), "payload", "redacted")


@query("SELECT operation_id, status, CASE WHEN status = 'success' THEN NULL ELSE error_code END AS error_code FROM fx_operation_log")
def b21_minimal_results(spark, sf_dir):
    return view(spark, sf_dir, "fx_operation_log").select("operation_id", "status", F.when(F.col("status") != "success", F.col("error_code")).alias("error_code"))


# Joins


@query("""
SELECT DISTINCT e.entity_id, e.canonical_name FROM fx_entity e JOIN fx_entity_alias a USING (entity_id) WHERE contains(lower(a.alias), 'plate') AND e.class_key = 'Product' AND e.status = 'active'""")
def c01_entities_by_alias(spark, sf_dir):
    found = view(spark, sf_dir, "fx_entity_alias").filter(F.contains(F.lower("alias"), F.lit("plate"))).select("entity_id")
    return view(spark, sf_dir, "fx_entity").filter("class_key = 'Product' AND status = 'active'").join(found, "entity_id", "left_semi").select("entity_id", "canonical_name")


@query("""
SELECT s.statement_id, a.canonical_name AS subject_name, b.canonical_name AS object_name FROM fx_statement s LEFT JOIN fx_entity a ON a.entity_id = s.subject_entity_id LEFT JOIN fx_entity b ON b.entity_id = s.object_entity_id WHERE s.predicate_key = 'locatedAt'""")
def c02_role_names(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entity")
    a, b = e.select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject_name")), e.select(F.col("entity_id").alias("object_entity_id"), F.col("canonical_name").alias("object_name"))
    rows = view(spark, sf_dir, "fx_statement").filter("predicate_key = 'locatedAt'")
    return rows.join(a, "subject_entity_id", "left").join(b, "object_entity_id", "left").select("statement_id", "subject_name", "object_name")


PREDICATES = [("preferredPriority", "one", 1), ("orderedBy", "one", 1), ("totalPrice", "one", 1), ("contains", "many", 2), ("description", "one", 1)]


def _predicates(spark):
    return spark.createDataFrame(PREDICATES, "predicate_key string, cardinality string, revision int")


@query("""
WITH p AS (SELECT * FROM (VALUES ('preferredPriority', 'one', 1), ('orderedBy', 'one', 1), ('totalPrice', 'one', 1), ('contains', 'many', 2), ('description', 'one', 1)) t(predicate_key, cardinality, revision))
SELECT cardinality, count(*) AS n FROM fx_statement JOIN p USING (predicate_key) GROUP BY 1""")
def c03_predicate_join(spark, sf_dir):
    # Counted first: predicates are few and have many statements each.
    counts = view(spark, sf_dir, "fx_statement").groupBy("predicate_key").agg(F.count("*").alias("n"))
    return counts.join(_predicates(spark), "predicate_key").groupBy("cardinality").agg(F.sum("n").alias("n"))


@query("""
WITH p AS (SELECT * FROM (VALUES ('preferredPriority', 1), ('orderedBy', 1), ('totalPrice', 1), ('contains', 2), ('description', 1)) t(predicate_key, revision))
SELECT f.predicate_key, p.revision, count(*) AS n FROM fx_statement f LEFT JOIN p USING (predicate_key) GROUP BY 1, 2""")
def c04_current_revision(spark, sf_dir):
    counts = view(spark, sf_dir, "fx_statement").groupBy("predicate_key").agg(F.count("*").alias("n"))
    rows = counts.join(_predicates(spark), "predicate_key", "left")
    return rows.groupBy("predicate_key", "revision").agg(F.sum("n").alias("n"))


@query("""
WITH ref AS (SELECT 'supplier:' || s_suppkey AS entity_id, CASE s_suppkey % 2 WHEN 0 THEN 'erp' ELSE 'crm' END AS source_system, 'x' || (s_suppkey % 60) AS external_id FROM supplier),
 ask AS (SELECT c_custkey AS request_id, 'erp' AS source_system, 'x' || (c_custkey % 90) AS external_id FROM customer)
SELECT DISTINCT request_id, entity_id FROM ask JOIN ref USING (source_system, external_id)""")
def c12_external_references(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    refs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), s).alias("entity_id"), F.when(s % 2 == 0, "erp").otherwise("crm").alias("source_system"), F.concat(F.lit("x"), s % 60).alias("external_id"))
    asked = table(spark, sf_dir, "customer").select(c.alias("request_id"), F.lit("erp").alias("source_system"), F.concat(F.lit("x"), c % 90).alias("external_id"))
    return identity.by_reference(asked, refs)


@query(NAMES + "SELECT request_id, count(DISTINCT entity_id) AS n FROM asked JOIN named USING (norm) WHERE strength = 'canonical' GROUP BY 1")
def c13_canonical_names(spark, sf_dir):
    members = identity.alike(_requests(spark, sf_dir))
    found = identity.exact_names(identity.asked_names(members), _named(spark, sf_dir).filter("strength = 'canonical'"))
    return identity.spread(found.groupBy("request_id").agg(F.count("*").alias("n")), members)


@query(NAMES + """, m AS (SELECT request_id, entity_id, strength FROM asked JOIN named USING (norm)) SELECT request_id, entity_id, string_agg(DISTINCT strength, '+' ORDER BY strength) AS reasons FROM m GROUP BY 1, 2""")
def c15_candidate_reasons(spark, sf_dir):
    members = identity.alike(_requests(spark, sf_dir))
    rows = identity.asked_names(members).join(_named(spark, sf_dir), "norm")
    return identity.spread(rows.groupBy("request_id", "entity_id").agg(F.array_join(F.sort_array(F.collect_set("strength")), "+").alias("reasons")), members)


@query("""
WITH c AS (SELECT 'order:' || o_orderkey AS a, 'order:' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
 p AS (SELECT a, b FROM c WHERE b IS NOT NULL UNION ALL SELECT b, a FROM c WHERE b IS NOT NULL),
 f AS (SELECT subject_entity_id AS e, predicate_key, object_entity_id AS n, statement_id AS s, valid_from, valid_to FROM fx_statement WHERE status = 'asserted' AND predicate_key IN ('contains', 'orderedBy')),
 m AS (SELECT p.a, p.b, x.* EXCLUDE (e), EXISTS (SELECT 1 FROM f y WHERE y.e = p.b AND y.predicate_key = x.predicate_key AND y.n = x.n) AS shared FROM p JOIN f x ON x.e = p.a),
 j AS (SELECT m.a, m.b, m.predicate_key, m.n, m.s, y.s AS t, m.shared, y.n AS other, coalesce(m.valid_from <= y.valid_to, true) AND coalesce(y.valid_from <= m.valid_to, true) AS at_once FROM m JOIN f y ON y.e = m.b AND y.predicate_key = m.predicate_key),
 o AS (SELECT a, b, 'shared_neighbor' AS signal, predicate_key, n AS neighbour_id, array_to_string(list_sort(list_distinct(list_concat(list(s), list(t)))), ' ') AS statements FROM j WHERE shared AND other = n GROUP BY ALL
  UNION ALL SELECT DISTINCT a, b, 'conflicting_neighbor', predicate_key, n, least(s, t) || ' ' || greatest(s, t) FROM j WHERE NOT shared
  UNION ALL SELECT DISTINCT a, b, 'temporal_conflict', predicate_key, n, least(s, t) || ' ' || greatest(s, t) FROM j WHERE NOT shared AND at_once)
SELECT * FROM o""")
def c18_graph_evidence(spark, sf_dir):
    """Each order of a customer against the customer's next one."""
    follow = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = lambda c: F.concat(F.lit("order:"), c)
    pairs = table(spark, sf_dir, "orders").select(name(F.col("o_orderkey")).alias("a"), name(F.lead("o_orderkey").over(follow)).alias("b")).filter("b IS NOT NULL")
    found = view(spark, sf_dir, "fx_statement").filter("status = 'asserted' AND predicate_key IN ('contains', 'orderedBy')")
    found = found.select(F.col("subject_entity_id").alias("entity_id"), "predicate_key", F.col("object_entity_id").alias("neighbour_id"), "statement_id", "valid_from", "valid_to")
    return identity.graph_evidence(pairs, found).withColumn("statements", F.array_join("statements", " "))


@query(ROOTS + """, f AS (SELECT DISTINCT subject_entity_id AS e, object_entity_id AS n FROM fx_statement WHERE status = 'asserted' AND predicate_key = 'contains'),
 p AS (SELECT DISTINCT 'order:' || a.o_orderkey AS a, 'order:' || b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT DISTINCT p.a, p.b, 'contains' AS predicate_key, x.n AS neighbour_id FROM p JOIN f x ON x.e = p.a JOIN f y ON y.e = p.b AND y.n = x.n""")
def c18_shared_neighbours(spark, sf_dir):
    """All orders of a customer against each other."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.concat(F.lit("order:"), "o_orderkey").alias("entity_id"), F.col("o_orderkey").alias("rank"))
    found = view(spark, sf_dir, "fx_statement").filter("status = 'asserted' AND predicate_key = 'contains'")
    return identity.shared_neighbours(orders, found.select(F.col("subject_entity_id").alias("entity_id"), "predicate_key", F.col("object_entity_id").alias("neighbour_id")))


@query("""
WITH t AS (SELECT entity_id, class_key FROM fx_entity) SELECT statement_id, predicate_key FROM fx_statement JOIN t ON entity_id = subject_entity_id WHERE predicate_key = 'description' AND class_key <> 'Product' OR predicate_key = 'locatedAt' AND class_key <> 'Organization'""")
def c20_domain_violations(spark, sf_dir):
    from factgraph.operators import audits

    types = view(spark, sf_dir, "fx_entity").select("entity_id", "class_key")
    closed = types.select(F.col("class_key").alias("node"), F.col("class_key").alias("ancestor")).distinct()
    allowed = spark.createDataFrame([("description", "Product"), ("locatedAt", "Organization")], "predicate_key string, class_key string")
    return audits.class_violations(view(spark, sf_dir, "fx_statement"), types, closed, allowed, "subject_entity_id").select("statement_id", "predicate_key")


@query("""
WITH i AS (SELECT event_id AS issue_id, 'customer:' || user_id AS entity_id, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS severity, ts FROM events WHERE event_type = 'error'),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY severity DESC, ts DESC, issue_id) AS place FROM i WHERE entity_id IN (SELECT entity_id FROM fx_entity))
SELECT entity_id, issue_id, place FROM r WHERE place <= 5""")
def c27_open_warnings(spark, sf_dir):
    e = F.col("event_id")
    issues = table(spark, sf_dir, "events").filter("event_type = 'error'").select(e.alias("issue_id"), F.concat(F.lit("customer:"), "user_id").alias("entity_id"), F.when(e % 4 == 0, 3).when(e % 4 == 1, 2).otherwise(1).alias("severity"), "ts")
    hits = issues.join(view(spark, sf_dir, "fx_entity").select("entity_id"), "entity_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("severity"), F.desc("ts"), "issue_id"))
    return hits.withColumn("place", place).filter("place <= 5").select("entity_id", "issue_id", "place")


@query("SELECT actor_id, idempotency_key, max_by(operation_id, (started_at, operation_id)) AS operation_id FROM fx_operation_log GROUP BY 1, 2")
def c28_latest_operation(spark, sf_dir):
    return view(spark, sf_dir, "fx_operation_log").groupBy("actor_id", "idempotency_key").agg(F.max_by("operation_id", F.struct("started_at", "operation_id")).alias("operation_id"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, p_partkey IS NULL AS rejected FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 5 <> 0""")
def c29_client_references(spark, sf_dir):
    refs = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    return table(spark, sf_dir, "lineitem").join(refs, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.col("known").isNull().alias("rejected"))


@query(CLOSED + ", d AS (SELECT 'region:' || r_regionkey AS class_key, 'p' || r_regionkey AS predicate_key FROM region) SELECT DISTINCT node AS class_key, predicate_key FROM closed JOIN d ON d.class_key = ancestor")
def c30_applicable_predicates(spark, sf_dir):
    domains = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("class_key"), F.concat(F.lit("p"), "r_regionkey").alias("predicate_key"))
    return ontology.applicable_predicates(_closed(spark, sf_dir), domains)


@query("""
SELECT DISTINCT n_name AS name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'alias:' || n_nationkey END, CASE WHEN n_nationkey % 2 = 0 THEN 'own:' || n_nationkey END) AS target FROM nation""")
def c31_ontology_aliases(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    aliases = n.filter("n_nationkey % 3 = 0").select(F.upper("n_name").alias("alias"), F.concat(F.lit("alias:"), "n_nationkey").alias("key"))
    own = n.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("_n"), F.concat(F.lit("own:"), "n_nationkey").alias("_key"))
    asked = n.select(F.col("n_name").alias("name"))
    keys = own.select(F.col("_n").alias("key"), "_key")
    found = ontology.resolve_aliases(asked, aliases, keys.select("key"))
    return found.join(keys, F.lower("target") == F.col("key"), "left").select("name", F.coalesce("_key", "target").alias("target"))


# Roll-ups


@query("SELECT status, count(*) AS n FROM fx_statement GROUP BY status")
def d06_status_counts(spark, sf_dir):
    return view(spark, sf_dir, "fx_statement").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS batches, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def d07_batch_summary(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").join(sizes, "o_orderkey").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("batches"), F.sum("n").alias("items"))


@query("""
SELECT 'operations' AS block, status AS metric, count(*) AS n FROM fx_operation_log GROUP BY 2 UNION ALL SELECT 'calls', status, count(*) FROM fx_llm_call_log GROUP BY 2 UNION ALL SELECT 'feedback', severity, count(*) FROM fx_feedback GROUP BY 2 UNION ALL SELECT 'reviews', model_decision, count(*) FROM fx_review_eval GROUP BY 2""")
def d08_dashboard(spark, sf_dir):
    parts = [("operations", "fx_operation_log", "status"), ("calls", "fx_llm_call_log", "status"), ("feedback", "fx_feedback", "severity"), ("reviews", "fx_review_eval", "model_decision")]
    blocks = [view(spark, sf_dir, v).groupBy(F.col(c).alias("metric")).agg(F.count("*").alias("n")).select(F.lit(b).alias("block"), "metric", "n") for b, v, c in parts]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


@query("""
WITH c AS (SELECT subject_entity_id AS entity_id, count(DISTINCT predicate_key) AS n FROM fx_statement GROUP BY 1) SELECT entity_id, round(greatest(0, least(1, 0.3 + 0.2 * n))::DOUBLE, 6) AS specificity FROM c""")
def d10_specificity(spark, sf_dir):
    n = view(spark, sf_dir, "fx_statement").groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.countDistinct("predicate_key").alias("n"))
    return n.select("entity_id", F.round(retrieval.specificity(F.col("n"), 0.2), 6).alias("specificity"))


@query("""
WITH t AS (SELECT DISTINCT p_brand, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS cue FROM part), g AS (SELECT cue, count(DISTINCT p_brand) AS n FROM t GROUP BY 1) SELECT cue, n FROM g WHERE length(cue) >= 2""")
def d12_cue_owners(spark, sf_dir):
    cues = table(spark, sf_dir, "part").select("p_brand", F.explode(text.content_tokens(F.col("p_type"))).alias("cue"))
    return cues.groupBy("cue").agg(F.countDistinct("p_brand").alias("n"))


@query("SELECT source_id, count(*) + 1 AS next_revision FROM fx_content_ingest WHERE content <> '' GROUP BY 1")
def d14_next_number(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_content_ingest").filter("content <> ''")
    return rows.groupBy("source_id").agg((F.count("*") + 1).alias("next_revision"))


@query("""
WITH r AS (SELECT case_id % 50 AS proposal, case_id, model_decision, lag(model_decision) OVER (PARTITION BY case_id % 50 ORDER BY case_id) AS before_ FROM fx_review_eval)
SELECT count(*) AS reviews, count(DISTINCT proposal) AS proposals, count(*) FILTER (before_ IS NOT NULL AND before_ <> model_decision) AS overturned, round(count(*)::DOUBLE / nullif(count(DISTINCT proposal), 0), 6) AS rounds_per_proposal FROM r""")
def d16_review_metrics(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_review_eval").select((F.col("case_id") % 50).alias("proposal_id"), F.col("case_id").alias("review_id"), F.col("model_decision").alias("decision"))
    told = governance.review_lineage(rows)
    n = F.countDistinct("proposal_id")
    return told.agg(F.count("*").alias("reviews"), n.alias("proposals"), F.count_if("decision_changed").alias("overturned"), F.round(F.count("*") / F.nullif(n, F.lit(0)), 6).alias("rounds_per_proposal"))


@query("""
WITH r AS (SELECT doc_id AS case_id, doc_id % 13 + 1 AS rank, unnest(CASE WHEN toxic = 1 THEN ['toxic', 'all'] ELSE ['all'] END) AS tag FROM labels)
SELECT tag, count(*) AS cases, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 3)::INT), 6) AS recall_at_3, round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr, 0::BIGINT AS zero_hits FROM r GROUP BY 1""")
def d19_quality_by_tag(spark, sf_dir):
    d = F.col("doc_id")
    tags = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    rows = table(spark, sf_dir, "labels").select(d.alias("case_id"), (d % 13 + 1).alias("rank"), F.explode(tags).alias("tag"))
    return summaries.retrieval_quality(rows, ["tag"])


# Windows, sorts and sets


@query("""
WITH r AS (SELECT case_id % 50 AS proposal_id, case_id AS review_id, model_decision AS decision, lag(model_decision) OVER (PARTITION BY case_id % 50 ORDER BY case_id) AS previous_decision FROM fx_review_eval) SELECT *, previous_decision IS NOT NULL AND previous_decision <> decision AS decision_changed FROM r""")
def e10_review_lineage(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_review_eval").select((F.col("case_id") % 50).alias("proposal_id"), F.col("case_id").alias("review_id"), F.col("model_decision").alias("decision"))
    return governance.review_lineage(rows)


@query("""
WITH r AS (SELECT actor_id, operation_id, row_number() OVER (PARTITION BY actor_id ORDER BY created_at DESC, operation_id DESC) AS k FROM fx_operation_log WHERE status <> 'success') SELECT actor_id, operation_id FROM r WHERE k = 1""")
def e09_newest_open(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_operation_log").filter("status <> 'success'")
    return rows.groupBy("actor_id").agg(F.max_by("operation_id", F.struct("created_at", "operation_id")).alias("operation_id"))


@query("SELECT statement_id, predicate_key FROM fx_statement ORDER BY asserted_at DESC, statement_id DESC LIMIT 100 OFFSET 20")
def f01_stable_page(spark, sf_dir):
    return summaries.page(view(spark, sf_dir, "fx_statement"), 100, 20, "asserted_at", "statement_id").select("statement_id", "predicate_key")


@query(DECIDED + "SELECT request_id, entity_id, row_number() OVER (PARTITION BY request_id ORDER BY length(reasons) - length(replace(reasons, '+', '')) DESC, entity_id) AS place FROM decided")
def f06_candidate_order(spark, sf_dir):
    rows, members = _decided(spark, sf_dir)
    rows = rows.select("request_id", "entity_id", (-F.size(F.split("reasons", r"\+"))).alias("signs"))
    placed = Segments(rows, ["request_id"], ["signs", "entity_id"]).running(F.lit(1), "_place")
    return identity.spread(placed.select("request_id", "entity_id", F.col("_place").cast("int").alias("place")), members)


@query("""
WITH a AS (SELECT l_partkey AS id, 1 AS pass FROM lineitem WHERE l_quantity > 45), b AS (SELECT l_partkey, 2 FROM lineitem WHERE l_discount > 0.08), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, min(pass) AS pass FROM u GROUP BY id""")
def g02_union_by_pass(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    both = rows.filter("l_quantity > 45").select(F.col("l_partkey").alias("id"), F.lit(1).alias("pass")).union(rows.filter("l_discount > 0.08").select("l_partkey", F.lit(2)))
    return both.groupBy("id").agg(F.min("pass").alias("pass"))


@query("""
WITH h AS (SELECT p_size AS query_id, 'part' AS hit_type, p_brand AS id, round(p_retailprice, 2) AS score, p_type AS reason FROM part),
 m AS (SELECT query_id, hit_type, id, max(score) AS score FROM h GROUP BY ALL) SELECT query_id, hit_type, id, score FROM m""")
def g03_merged_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.lit("part").alias("hit_type"), F.col("p_brand").alias("id"), F.round("p_retailprice", 2).alias("score"), F.col("p_type").alias("reason"))
    return retrieval.merged_hits(hits).select("query_id", "hit_type", "id", "score")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def g04_skip_known(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(known, "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM t""")
def g05_jaccard(spark, sf_dir):
    a, b = text.words(F.col("p_name")), text.words(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))


# Columns


@query("SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS norm_hash FROM documents")
def h01_normal_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normal(F.col("text")), 256).alias("norm_hash"))


@query("SELECT o_orderkey, regexp_full_match(o_orderpriority, '[A-Z][A-Za-z0-9]*') AS pascal, regexp_full_match(lower(o_orderstatus), '[a-z][A-Za-z0-9]*') AS camel FROM orders")
def h02_key_shapes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.is_class_key(F.col("o_orderpriority")).alias("pascal"), text.is_predicate_key(F.lower("o_orderstatus")).alias("camel"))


@query("SELECT c_custkey, trim(regexp_replace(lower(trim(c_name || ' / ' || c_mktsegment || '!')), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM customer")
def h04_source_system_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.source_system_key(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("key"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS phrase_hash FROM documents")
def h06_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.phrase(F.col("text"))).alias("phrase_hash"))


@query(f"""
WITH c AS (SELECT DISTINCT predicate_key AS k FROM fx_statement), p AS (SELECT k, regexp_replace(k, '([a-z])([A-Z])', '\\1 \\2', 'g') AS s FROM c), t AS (SELECT k, list_filter(string_split(lower(s), ' '), lambda x: length(x) >= 2) AS a FROM p)
SELECT k AS predicate_key, array_to_string(list_sort(list_distinct(list_concat(a, list_transform(a, lambda x: CASE WHEN x[-1] = 's' AND length(x) > 3 THEN x[:-2] ELSE x || 's' END)))), ' ') AS cues FROM t""")
def h10_predicate_cues(spark, sf_dir):
    keys = view(spark, sf_dir, "fx_statement").select("predicate_key").distinct()
    return keys.select("predicate_key", F.array_join(F.sort_array(ontology.with_plurals(ontology.camel_parts(F.col("predicate_key")))), " ").alias("cues"))


OTHER = "CASE WHEN x[-1] = 's' AND length(x) > 3 THEN x[:-2] ELSE x || 's' END"


@query(f"""
WITH k AS (SELECT DISTINCT predicate_key FROM fx_statement), c AS (SELECT predicate_key, list_filter(string_split(lower(regexp_replace(predicate_key, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), lambda x: length(x) >= 2) AS a FROM k),
 cues AS (SELECT DISTINCT predicate_key, unnest(list_concat(a, list_transform(a, lambda x: {OTHER}))) AS cue FROM c), lex AS (SELECT *, count(*) OVER (PARTITION BY cue) = 1 AS own FROM cues),
 nl(cue, predicate_key) AS (VALUES ('buyer', 'orderedBy'), ('buyers', 'orderedBy'), ('price', 'totalPrice'), ('where', 'locatedAt'), ('urgent', 'preferredPriority')),
 q AS (SELECT o_orderkey AS query_id, regexp_extract_all(CASE WHEN o_orderkey % 3 = 0 THEN 'buyers of orders ' ELSE 'preferred priority ' END || lower(o_orderpriority), '[a-z0-9]+') AS w FROM orders),
 t AS (SELECT query_id, unnest(list_distinct(list_filter(w, lambda x: (length(x) >= 2 AND x NOT IN ({', '.join(f"'{w}'" for w in text.STOP_WORDS)})) OR x IN ('buyer', 'buyers', 'price', 'where', 'urgent')))) AS x FROM q),
 said AS (SELECT DISTINCT query_id, unnest([x, {OTHER}]) AS cue FROM t),
 h AS (SELECT query_id, predicate_key, count(*) AS o, count(*) FILTER (own) AS d, 0 AS n FROM said JOIN lex USING (cue) GROUP BY 1, 2 UNION ALL SELECT query_id, predicate_key, 0, 0, 1 FROM said JOIN nl USING (cue) GROUP BY 1, 2),
 s AS (SELECT query_id, predicate_key, sum(o) AS o, sum(d) AS d, max(n) AS n FROM h GROUP BY 1, 2),
 r AS (SELECT query_id, predicate_key, round(greatest(CASE WHEN d > 0 THEN least(1.0, 0.60 + 0.20 * least(d, 3)) WHEN o >= 2 THEN least(1.0, 0.50 + 0.15 * least(o, 3)) ELSE 0.0 END::DOUBLE, CASE WHEN n > 0 THEN 0.78 ELSE 0.0 END::DOUBLE), 6) AS score FROM s WHERE predicate_key NOT IN ({', '.join(f"'{x}'" for x in ontology.NO_BOOST)}))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, predicate_key) AS place FROM r WHERE score >= 0.55) WHERE place <= 2""")
def h11_predicate_intents(spark, sf_dir):
    keys = view(spark, sf_dir, "fx_statement").select("predicate_key", F.lit(None).cast("string").alias("label")).distinct()
    nl = spark.createDataFrame([("buyer", "orderedBy"), ("buyers", "orderedBy"), ("price", "totalPrice"), ("where", "locatedAt"), ("urgent", "preferredPriority")], "cue string, predicate_key string")
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "buyers of orders ").otherwise("preferred priority "), F.lower("o_orderpriority")).alias("query"))
    return ontology.intents(asked, ontology.lexicon(keys), nl)


@query("SELECT entity_id, round(greatest(0.0, least(1.0, 1.0::DOUBLE - (epoch(TIMESTAMP '2001-12-31') - floor(epoch(updated_at))) / 86400.0::DOUBLE / 365.0::DOUBLE)), 6) AS recency FROM fx_entity")
def h12_recency(spark, sf_dir):
    return view(spark, sf_dir, "fx_entity").select("entity_id", F.round(temporal.recency(F.col("updated_at"), F.lit(AS_OF).cast("timestamp")), 6).alias("recency"))


@query("SELECT part_id, round(0.30 * a + 0.15 * b + 0.15 * c + 0.10 * (a + b + c + 0.5), 6) AS score FROM (SELECT p_partkey AS part_id, (p_size / 100.0)::DOUBLE AS a, ((p_partkey % 7) / 7.0)::DOUBLE AS b, ((p_partkey % 11) / 11.0)::DOUBLE AS c FROM part)")
def h14_ranking_score(spark, sf_dir):
    k = F.col("p_partkey")
    a, b, c = F.col("p_size") / 100.0, (k % 7) / 7.0, (k % 11) / 11.0
    signals = {"lexical": a, "temporal": b, "recency": c, "evidence": a, "reliability": b, "proximity": c, "specificity": F.lit(0.5)}
    return table(spark, sf_dir, "part").select(k.alias("part_id"), retrieval.score(signals).alias("score"))


@query("SELECT report_id, sha256(concat_ws('|', feedback_type, lower(title), '', severity)) AS fingerprint FROM fx_feedback")
def h19_fingerprints(spark, sf_dir):
    return view(spark, sf_dir, "fx_feedback").select("report_id", ids.fingerprint(F.col("feedback_type"), F.lower("title"), F.lit(None), F.col("severity")).alias("fingerprint"))


@query("""
WITH v AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, b, round(s, 6) AS cosine FROM v""")
def h22_cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = a.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m.cast("double") * n.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, "a").select("a", "b", F.round(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), 6).alias("cosine"))


@query("SELECT p_partkey, concat_ws(' | ', p_name, p_brand, CASE WHEN p_size > 10 THEN p_type END) AS embedding_text FROM part")
def h23_embedding_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" | ", "p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_type"))).alias("embedding_text"))


@query("""
WITH t AS (SELECT doc_id, rtrim(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), chr(10)) AS b FROM documents) SELECT doc_id, sha256(CASE WHEN b = '' THEN '' ELSE b || chr(10) END) AS body_hash FROM t""")
def h24_canonical_bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.canonical_body(F.col("text")), 256).alias("body_hash"))


@query("SELECT doc_id, (length(text) // 4) + 520 AS tokens FROM documents")
def h28_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.expr("length(text) DIV 4") + 520).alias("tokens"))


@query("""
WITH n AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT event_id, CAST(date_diff('millisecond', ts, next) AS BIGINT) AS duration_ms FROM n WHERE next IS NOT NULL""")
def h30_durations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.filter("next IS NOT NULL").select("event_id", (F.unix_millis("next") - F.unix_millis("ts")).alias("duration_ms"))


# State jobs


@query("SELECT class_key, proposal_id, CASE WHEN base_revision = 1 AND k = 1 THEN 'applied' ELSE 'stale' END AS outcome FROM (SELECT p_brand AS class_key, p_partkey AS proposal_id, p_partkey % 3 AS base_revision, row_number() OVER (PARTITION BY p_brand, p_partkey % 3 = 1 ORDER BY p_partkey) AS k FROM part)")
def j19_apply_classes(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    classes = parts.select(F.col("p_brand").alias("class_key"), F.lit(1).alias("revision")).distinct()
    accepted = parts.select(F.col("p_partkey").alias("proposal_id"), F.col("p_brand").alias("class_key"), (F.col("p_partkey") % 3).alias("base_revision"))
    return governance.apply_classes(classes, accepted).join(accepted.select("proposal_id", "class_key"), "proposal_id").select("class_key", "proposal_id", "outcome")


APPLIED = """WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'alias' WHEN p_partkey % 4 = 1 THEN 'predicate' ELSE 'class' END AS kind, 'C' || p_partkey AS key, CASE WHEN p_partkey % 20 = 19 THEN 'Nowhere' WHEN p_partkey % 4 IN (2, 3) AND p_partkey % 20 >= 7 THEN 'C' || (p_partkey - CASE WHEN p_partkey % 4 = 2 THEN 7 ELSE 5 END) END AS parent FROM part),
 made AS (SELECT id, key, 1 AS level FROM p WHERE kind = 'class' AND parent IS NULL UNION ALL SELECT p.id, p.key, m.level + 1 FROM p JOIN made m ON p.parent = m.key WHERE p.kind = 'class'), top AS (SELECT max(level) + 1 AS l FROM made),
 alias AS (SELECT id, 'C' || (id - 1) AS target, 'also ' || id % 97 AS alias FROM p WHERE kind = 'alias'), al AS (SELECT a.*, m.level + 1 AS level, row_number() OVER (PARTITION BY alias ORDER BY m.level, a.id) AS k FROM alias a JOIN made m ON m.key = a.target),
 pr AS (SELECT id, CASE WHEN id % 8 = 1 THEN 'C' || (id + 1) END AS domain, id % 3 AS base FROM p WHERE kind = 'predicate'), """


@query(APPLIED + """ready AS (SELECT pr.*, CASE WHEN domain IS NULL THEN 1 ELSE m.level + 1 END AS level FROM pr LEFT JOIN made m ON m.key = pr.domain WHERE domain IS NULL OR m.level IS NOT NULL),
 o AS (SELECT id, level, 'applied' AS outcome, 1 AS revision FROM made UNION ALL SELECT id, level, 'applied', NULL FROM al WHERE k = 1 UNION ALL SELECT id, greatest(level, (SELECT min(b.level) + 1 FROM al b WHERE b.alias = al.alias)), 'exists', NULL FROM al WHERE k > 1
  UNION ALL SELECT id, level, CASE WHEN base = 0 THEN 'applied' ELSE 'stale' END, CASE WHEN base = 0 THEN 1 END FROM ready)
SELECT id AS proposal_id, level, outcome, revision FROM o UNION ALL SELECT id, (SELECT greatest(max(level), 0) + 1 FROM o), 'blocked', NULL FROM p WHERE id NOT IN (SELECT id FROM o)""")
def j19_apply_proposals(spark, sf_dir):
    """Classes that need each other's, names for them, and predicates on them, applied level by level."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    key, kind = F.concat(F.lit("C"), k), F.when(k % 4 == 0, "alias").when(k % 4 == 1, "predicate").otherwise("class")
    parent = F.when(k % 20 == 19, F.array(F.lit("Nowhere"))).when(k % 20 >= 7, F.array(F.concat(F.lit("C"), k - F.when(k % 4 == 2, 7).otherwise(5)))).otherwise(none)
    text = F.lit(None).cast("string")
    given = table(spark, sf_dir, "part").select(
        k.alias("proposal_id"), kind.alias("kind"), F.lit("core").alias("namespace_key"), F.when(k % 4 == 1, F.concat(F.lit("has"), k)).otherwise(key).alias("key"), F.lit("string").alias("value_kind"), F.lit("one").alias("cardinality"), text.alias("constraint_type"),
        F.when(k % 4 == 0, F.concat(F.lit("also "), k % 97)).alias("alias"), F.lit("class").alias("target_type"), F.concat(F.lit("C"), k - 1).alias("target_key"), text.alias("child_key"), text.alias("parent_key"), parent.alias("parent_keys"),
        F.when(k % 8 == 1, F.array(F.concat(F.lit("C"), k + 1))).otherwise(none).alias("domain_keys"), none.alias("range_keys"), F.when(kind == "predicate", k % 3).cast("int").alias("base_revision"),
    )
    empty = proposals.Ontology(*[spark.createDataFrame([], x) for x in ("kind string, namespace_key string, key string, revision int", "namespace_key string, alias string, target_type string, target_key string", "namespace_key string, key string", "namespace_key string, child_key string, parent_key string")])
    return proposals.apply_accepted(given, empty)[0]


@query("""
SELECT o_orderkey AS conflict_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN 'RESOLVED' ELSE 'REJECTED' END AS outcome FROM orders WHERE o_orderkey % 2 = 0""")
def j08_resolve_conflicts(spark, sf_dir):
    k = F.col("o_orderkey")
    issues = table(spark, sf_dir, "orders").select(k.alias("conflict_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))
    asked = table(spark, sf_dir, "orders").filter(k % 2 == 0).select(k.alias("conflict_id"), F.when(k % 3 == 0, " ").otherwise("seen").alias("note"))
    return changes.resolve(issues, asked, "conflict_id")


@query("""
WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings), p AS (SELECT q.vec_id AS query_id, max(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS top FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1)
SELECT query_id, CASE WHEN top >= 0.95 THEN 'manual' ELSE 'pass' END AS decision FROM p""")
def j16_similarity_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    near = content.nearest(rows, rows.filter("vec_id % 20 = 0"), 1, -1.0)
    return near.select("query_id", F.when(F.col("score") >= 0.95, "manual").otherwise("pass").alias("decision"))


@query(ROOTS + """, t AS (SELECT coalesce(root, subject_entity_id) AS entity_id, 'timeline' AS section, count(*) AS n FROM fx_statement LEFT JOIN roots ON entity_id = subject_entity_id GROUP BY 1),
 x AS (SELECT coalesce(a.root, subject_entity_id) AS s, coalesce(b.root, object_entity_id) AS o FROM fx_statement LEFT JOIN roots a ON a.entity_id = subject_entity_id LEFT JOIN roots b ON b.entity_id = object_entity_id WHERE status = 'asserted' AND value_kind = 'entity'),
 y AS (SELECT s AS e FROM x UNION ALL SELECT o FROM x WHERE s <> o) SELECT * FROM t UNION ALL SELECT e, 'neighbourhood', count(*) FROM y GROUP BY 1""")
def j22_context_sections(spark, sf_dir):
    rows, roots = view(spark, sf_dir, "fx_statement"), graph.survivors(view(spark, sf_dir, "fx_entity"))
    times = facts.timeline(rows, roots).groupBy(F.col("survivor_id").alias("entity_id")).agg(F.count("*").alias("n"))
    near = facts.neighbourhood(rows, roots).groupBy("entity_id").agg(F.count("*").alias("n"))
    return times.select("entity_id", F.lit("timeline").alias("section"), "n").union(near.select("entity_id", F.lit("neighbourhood"), "n"))
