"""Registered queries of retrieval details, repairs, governance rules and small column jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions import temporal, text
from factgraph.operators import audits, changes, clarifications, content, facts, governance, graph, identity, proposals, redaction, relevance, repair, reporting, retrieval, summaries
from factgraph.plans.core import PARENTS, ROOTS, WALKS, _asked, _edges, _found, query
from factgraph.session import written
from factgraph.sources.tables import table, view

ANY = "(contains(lower(p_name), 'red') OR contains(lower(p_name), 'plate'))"


@query(f"SELECT p_partkey FROM part WHERE {ANY}")
def b04_any_token(spark, sf_dir):
    q = retrieval.prepared(_asked(spark).filter("query_id = 0"))
    return retrieval.candidates(table(spark, sf_dir, "part").select("p_partkey", "p_name"), q, ["p_name"]).select("p_partkey")


@query("SELECT event_id, length(props) AS n FROM events WHERE contains(props, '_') OR contains(props, '%') OR contains(props, '\"k\": 1')")
def b05_literal_contains(spark, sf_dir):
    hit = F.contains("props", F.lit("_")) | F.contains("props", F.lit("%")) | F.contains("props", F.lit('"k": 1'))
    return table(spark, sf_dir, "events").filter(hit).select("event_id", F.length("props").cast("long").alias("n"))


@query("""
WITH i AS (SELECT * FROM fx_feedback WHERE severity = 'high'), c AS (SELECT count(*) AS total FROM i) SELECT report_id, total FROM i, c ORDER BY created_at DESC, report_id DESC LIMIT 20 OFFSET 5""")
def b09_issue_page(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_feedback").filter("severity = 'high'")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("created_at"), F.desc("report_id")).offset(5).limit(20).crossJoin(F.broadcast(total)).select("report_id", "total")


@query("SELECT event_id, '{\"k\":' || (props->>'k') || '}' AS payload FROM events WHERE event_type = 'signup'")
def b22_public_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    full = F.map_concat(F.from_json("props", "map<string,int>"), F.create_map(F.lit("_internal"), F.lit(1)))
    return rows.select("event_id", F.to_json(redaction.public(full)).alias("payload"))


@query("""
SELECT count(*) AS pairs FROM fx_statement a JOIN fx_statement b ON a.subject_entity_id = b.subject_entity_id AND a.predicate_key = b.predicate_key AND a.statement_id < b.statement_id
WHERE a.predicate_key = 'preferredPriority' AND coalesce(a.valid_from <= b.valid_to, true) AND coalesce(b.valid_from <= a.valid_to, true)""")
def c08_overlaps(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_statement").filter("predicate_key = 'preferredPriority'")
    return facts.overlap_counts(rows, ["subject_entity_id", "predicate_key"]).agg(F.sum("pairs").alias("pairs"))


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def c19_distinct_evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").dropDuplicates(["l_suppkey", "l_returnflag", "l_linestatus"]).select("l_suppkey", "l_returnflag", "l_linestatus")


@query("""
WITH ask AS (SELECT doc_id, source, md5(text) AS h FROM documents), have AS (SELECT md5(text) AS h, min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, CASE WHEN id IS NOT NULL THEN 'MATCH' ELSE 'CREATE' END AS outcome, coalesce('src:' || id, 'new:' || h) AS source_id FROM ask LEFT JOIN have USING (h)""")
def c26_resolve_or_create(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), none.alias("canonical_system"), none.alias("external_id"), F.md5("text").alias("content_hash"))
    have = rows.filter("request_id % 2 = 0").groupBy("content_hash").agg(F.min("request_id").alias("id"))
    have = have.select(F.concat(F.lit("src:"), "id").alias("source_id"), none.alias("canonical_system"), none.alias("external_id"), "content_hash")
    return identity.resolve_sources(rows, have).withColumnRenamed("request_id", "doc_id")


@query("""
WITH r AS (SELECT source_id, ingest_id, row_number() OVER (PARTITION BY source_id ORDER BY captured_at DESC, ingest_id DESC) AS k FROM fx_content_ingest WHERE content <> '') SELECT source_id, ingest_id FROM r WHERE k = 1""")
def c33_latest_content(spark, sf_dir):
    return content.newest_content(view(spark, sf_dir, "fx_content_ingest"))


@query("SELECT count(*) AS total FROM fx_statement WHERE status = 'asserted' AND predicate_key = 'contains'")
def d01_total(spark, sf_dir):
    return facts.select_statements(view(spark, sf_dir, "fx_statement"), status="asserted", predicate_key="contains").agg(F.count("*").alias("total"))


@query("SELECT p_type AS type, p_size % 3 AS status, count(*) AS n, grouping(p_type, p_size % 3) AS level FROM part GROUP BY GROUPING SETS ((p_type), (p_size % 3), ())")
def d05_proposal_summary(spark, sf_dir):
    table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), (F.col("p_size") % 3).alias("status")).createOrReplaceTempView("proposal_rows")
    return spark.sql("SELECT type, status, count(*) AS n, grouping_id() AS level FROM proposal_rows GROUP BY GROUPING SETS ((type), (status), ())")


@query("""
WITH d AS (SELECT predicate_key, count(DISTINCT e.class_key) AS n FROM fx_statement JOIN fx_entity e ON e.entity_id = subject_entity_id GROUP BY 1), r AS (SELECT predicate_key, count(DISTINCT e.class_key) AS n FROM fx_statement JOIN fx_entity e ON e.entity_id = object_entity_id GROUP BY 1)
SELECT predicate_key, round(greatest(0, least(1, 0.3 + 0.15 * (d.n + coalesce(r.n, 0))))::DOUBLE, 6) AS specificity FROM d LEFT JOIN r USING (predicate_key)""")
def d11_predicate_specificity(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entity").select("entity_id", "class_key")
    rows = view(spark, sf_dir, "fx_statement")
    n = lambda end: rows.join(e, rows[end] == e.entity_id).groupBy("predicate_key").agg(F.countDistinct("class_key").alias(end))
    both = n("subject_entity_id").join(n("object_entity_id"), "predicate_key", "left")
    return both.select("predicate_key", F.round(retrieval.specificity(F.col("subject_entity_id") + F.coalesce("object_entity_id", F.lit(0)), 0.15), 6).alias("specificity"))


@query("""
WITH hits AS (SELECT subject_entity_id AS q, statement_id AS id, row_number() OVER (PARTITION BY subject_entity_id ORDER BY asserted_at DESC, statement_id) AS place FROM fx_statement WHERE predicate_key IN ('contains', 'orderedBy', 'totalPrice', 'preferredPriority')),
 h AS (SELECT q, 'statement' AS hit_type, id, place FROM hits WHERE place <= 5 UNION ALL SELECT o.q, 'entity', e.entity_id, 6 FROM (SELECT DISTINCT q FROM hits WHERE q LIKE 'order:%') o JOIN fx_entity e ON e.entity_id = 'part:' || (CAST(split_part(o.q, ':', 2) AS BIGINT) % 100 + 1)),
 k AS (SELECT q, CAST(split_part(q, ':', 2) AS BIGINT) AS n FROM (SELECT DISTINCT q FROM h)),
 c AS (SELECT q, CASE WHEN n % 3 = 0 THEN 'part:' || (n % 100 + 1) WHEN n % 3 = 1 THEN 'customer:' || (n % 100 + 1) END AS entity, CASE WHEN n % 2 = 0 THEN 'totalPrice' END AS predicate, CASE WHEN n % 5 = 0 THEN 'RED' END AS needle, 'st:od:' || n AS bad FROM k),
 d AS (SELECT h.*, c.entity, c.predicate, c.needle, c.bad, s.subject_entity_id, s.object_entity_id, s.predicate_key, CASE WHEN h.hit_type = 'entity' THEN lower(e.canonical_name) ELSE lower(concat_ws(' ', s.object_string, s.predicate_key)) END AS said, coalesce(c.entity IN (h.id, s.subject_entity_id, s.object_entity_id), false) AS touches
  FROM h JOIN c ON c.q = h.q LEFT JOIN fx_statement s ON h.hit_type = 'statement' AND s.statement_id = h.id LEFT JOIN fx_entity e ON h.hit_type = 'entity' AND e.entity_id = h.id),
 m AS (SELECT *, max(touches) OVER (PARTITION BY q) AS met FROM d)
SELECT q AS query_id, hit_type, id, place, touches OR coalesce(predicate_key = predicate AND (entity IS NULL OR met), false) OR coalesce(contains(said, lower(needle)), false) AS relevant, hit_type = 'statement' AND id = bad AS must_not FROM m""")
def d18_relevance(spark, sf_dir):
    rows, names = view(spark, sf_dir, "fx_statement"), view(spark, sf_dir, "fx_entity")
    # Ids begin alike; a hash in front of them makes sorting fast.
    place = F.row_number().over(Window.partitionBy(F.xxhash64("subject_entity_id"), "subject_entity_id").orderBy(F.desc("asserted_at"), "statement_id"))
    found = rows.filter("predicate_key IN ('contains', 'orderedBy', 'totalPrice', 'preferredPriority')").select(F.col("subject_entity_id").alias("query_id"), F.lit("statement").alias("hit_type"), F.col("statement_id").alias("id"), place.alias("place")).filter("place <= 5")
    found = written(found, "ranked")
    n = F.split_part("query_id", F.lit(":"), F.lit(2)).cast("long")
    cases = found.filter("place = 1")
    orders = cases.filter("query_id LIKE 'order:%'").select("query_id", F.lit("entity").alias("hit_type"), F.concat(F.lit("part:"), n % 100 + 1).alias("id"), F.lit(6).alias("place"))
    hits = found.union(written(orders.join(names.select(F.col("entity_id").alias("id")), "id", "left_semi").select(*found.columns), "ranked-entities"))
    entity = F.when(n % 3 == 0, F.concat(F.lit("part:"), n % 100 + 1)).when(n % 3 == 1, F.concat(F.lit("customer:"), n % 100 + 1))
    values = {"entity": entity, "predicate": F.when(n % 2 == 0, "totalPrice"), "needle": F.when(n % 5 == 0, "RED"), "must_not": F.concat(F.lit("st:od:"), n)}
    wants = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in values.items()])
    expected = cases.select("query_id", F.inline(wants)).filter("value IS NOT NULL")
    return relevance.labelled(hits, expected, names, rows)


@query("WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) SELECT p_brand, p_partkey, place FROM r WHERE place <= 5")
def f03_top_per_group(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.lit("part").alias("hit_type"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return retrieval.top(hits, 5).select(F.col("query_id").alias("p_brand"), F.col("id").alias("p_partkey"), "place")


@query("""
WITH h AS (SELECT p_size AS query_id, p_partkey AS id, p_partkey % 100 / 100.0 AS lex FROM part), f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, id) AS k FROM h WHERE id % 17 = 0),
 c AS (SELECT h.*, f.id IS NOT NULL AS focus FROM h LEFT JOIN f ON f.query_id = h.query_id AND f.id = h.id AND k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY focus DESC, lex DESC, id) AS place FROM c WHERE focus OR lex >= 0.75)
SELECT query_id, id, place FROM r WHERE place <= 3""")
def f08_strong_anchors(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), k.alias("id"), (k % 100 / 100).alias("lexical"), F.lit("partial_token_match").alias("reason"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "id"))
    focus = rows.filter("id % 17 = 0").groupBy("query_id").agg(F.max_by("id", F.struct("lexical", -F.col("id"))).alias("focus_entity_id"))
    return retrieval.strong_anchors(rows.withColumn("place", place), focus).withColumnRenamed("anchor", "id")


@query("""
WITH a AS (SELECT 'customer' AS hit_type, c_name AS id, c_acctbal AS score FROM customer), b AS (SELECT 'supplier', s_name, s_acctbal FROM supplier), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT hit_type, id, score FROM u ORDER BY score DESC, hit_type, id LIMIT 40""")
def f09_merged_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("hit_type"), F.col("c_name").alias("id"), F.col("c_acctbal").alias("score"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("hit_type"), F.col("s_name").alias("id"), F.col("s_acctbal").alias("score"))
    return c.unionByName(s).orderBy(F.desc("score"), "hit_type", "id").limit(40)


@query("""
WITH e AS (SELECT count(*) AS n FROM fx_entity WHERE status = 'active'), s AS (SELECT count(*) AS n FROM fx_statement WHERE status = 'asserted') SELECT 'entity' AS hit_type, n FROM e UNION ALL SELECT 'statement', n FROM s""")
def g01_hit_shapes(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entity").filter("status = 'active'").select(F.lit("entity").alias("hit_type"), F.col("entity_id").alias("id"), "class_key")
    s = view(spark, sf_dir, "fx_statement").filter("status = 'asserted'").select(F.lit("statement").alias("hit_type"), F.col("statement_id").alias("id"), "predicate_key")
    return e.unionByName(s, allowMissingColumns=True).groupBy("hit_type").agg(F.count("id").alias("n"))


@query("SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ') AS l FROM part)")
def g06_ordered_distinct(spark, sf_dir):
    said = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(said, " ")), " ").alias("words"))


@query("""
WITH t AS (SELECT DISTINCT 1 AS branch, p_type AS key FROM part WHERE contains(lower(p_type), 'brass') UNION SELECT DISTINCT 2, p_brand FROM part WHERE contains(lower(p_brand), '1') UNION SELECT 3, n_name FROM nation WHERE lower(n_name) = 'france'),
 r AS (SELECT *, row_number() OVER (ORDER BY branch, key) AS place FROM t) SELECT branch, key, place FROM r WHERE place <= 30""")
def g07_ontology_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.filter(F.contains(F.lower("p_type"), F.lit("brass"))).select(F.lit(1).alias("branch"), F.col("p_type").alias("key")).distinct()
    b = p.filter(F.contains(F.lower("p_brand"), F.lit("1"))).select(F.lit(2), "p_brand").distinct()
    c = table(spark, sf_dir, "nation").filter("lower(n_name) = 'france'").select(F.lit(3), "n_name")
    first = a.union(b).union(c).orderBy("branch", "key").limit(30)
    return first.withColumn("place", F.row_number().over(Window.orderBy("branch", "key")))


@query()
def h15_key_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("a"), F.col("p_name").alias("b")).distinct()
    return reporting.key_similarity(p)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS instant FROM orders")
def h18_utc(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    given = F.when(F.col("o_orderkey") % 4 == 0, stamp).otherwise(F.concat(stamp, F.lit("+00:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(temporal.instant(given), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query(f"""
SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 40 AND lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) NOT IN ({', '.join(f"'{x}'" for x in governance.TRIVIAL)}) AS substantive, regexp_matches(lower(text), '{'|'.join(governance.VAGUE)}') AS vague FROM documents""")
def h26_challenges(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", governance.is_substantive(F.col("text")).alias("substantive"), governance.is_vague(F.col("text")).alias("vague"))


HINTED = """WITH p AS (SELECT p_partkey AS proposal_id, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'predicate' END AS kind,
 CASE p_partkey % 9 WHEN 0 THEN 'EmployedBy' WHEN 1 THEN 'uses' WHEN 2 THEN 'VerifiedPart' WHEN 3 THEN 'partOf' WHEN 4 THEN 'FormerRole' WHEN 5 THEN 'currentRole' ELSE 'Thing' || p_partkey END AS key, p_type AS label,
 CASE WHEN p_partkey % 7 = 0 THEN 'A historical Role of ' || p_name WHEN p_partkey % 11 = 0 THEN 'Confidence in a probable ' || p_name WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name || ' employed by a firm' END AS description FROM part),
 w AS (SELECT *, lower(key) AS k, lower(key || ' ' || label || ' ' || coalesce(description, '')) AS b FROM p) """


@query(HINTED + """
SELECT proposal_id, CASE WHEN kind = 'predicate' THEN CASE WHEN k IN ('employedby', 'hasemployer', 'hascurrentemployer', 'employerof') OR contains(b, 'employed by') OR contains(b, 'current employer') THEN 'employment_path' WHEN k IN ('currentrole', 'hascurrentrole') OR contains(b, 'current role') THEN 'role_validity'
  WHEN k IN ('usedby', 'uses') THEN 'usage_direction' WHEN k IN ('avoids', 'avoid') THEN 'negative_semantics' WHEN k IN ('partof', 'haspart') THEN 'part_whole' END
 ELSE CASE WHEN k IN ('historicalrole', 'formerrole', 'pastrole') OR (contains(b, 'historical') AND contains(b, 'role')) THEN 'temporal_role' WHEN starts_with(k, 'verified') OR starts_with(k, 'confirmed') OR (contains(b, 'verified') AND contains(b, 'skill')) THEN 'verified_qualifier'
  WHEN starts_with(k, 'probable') OR starts_with(k, 'likely') OR (contains(b, 'confidence') AND (contains(b, 'goal') OR contains(b, 'probable'))) THEN 'confidence_qualifier' WHEN k IN ('employmentrelation', 'employment') OR contains(b, 'ongoing employment') OR contains(b, 'employment relationship') THEN 'employment_class' END END AS hint FROM w""")
def h27_modelling_hints(spark, sf_dir):
    k = F.col("p_partkey")
    names = ("EmployedBy", "uses", "VerifiedPart", "partOf", "FormerRole", "currentRole")
    key = F.coalesce(F.get(F.array(*map(F.lit, names)), (k % 9).cast("int")), F.concat(F.lit("Thing"), k))
    description = F.when(k % 7 == 0, F.concat(F.lit("A historical Role of "), "p_name")).when(k % 11 == 0, F.concat(F.lit("Confidence in a probable "), "p_name")).when(k % 13 != 0, F.concat("p_name", F.lit(" employed by a firm")))
    hint = governance.modelling_hints(F.when(k % 2 == 0, "class").otherwise("predicate"), key, F.col("p_type"), description)
    return table(spark, sf_dir, "part").select(k.alias("proposal_id"), hint["hint"].alias("hint"))


REPAIRS = WALKS + """, bad AS (SELECT s.statement_id FROM fx_statement s LEFT JOIN fx_statement t ON t.statement_id = s.superseded_by_statement_id WHERE s.status = 'superseded' AND (t.statement_id IS NULL OR t.subject_entity_id <> s.subject_entity_id OR t.predicate_key <> s.predicate_key OR s.statement_id IN (SELECT id FROM loop))),
 own AS (SELECT statement_id, subject_entity_id AS subject, superseded_by_statement_id AS next, lag(statement_id) OVER w AS earlier, lead(statement_id) OVER w AS later, statement_id IN (SELECT statement_id FROM bad) AS found, CAST(split_part(statement_id, ':', 3) AS BIGINT) * 2 AS seq FROM fx_statement WHERE predicate_key = 'preferredPriority' WINDOW w AS (PARTITION BY subject_entity_id ORDER BY asserted_at, statement_id)),
 e AS (SELECT statement_id, subject, earlier AS successor_id, seq, found FROM own WHERE earlier IS NOT NULL UNION ALL SELECT statement_id, subject, later, seq + 1, found FROM own WHERE later IS NOT NULL),
 f AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq) AS k FROM e WHERE found),
 base AS (SELECT subject, map(list(statement_id), list(CASE WHEN NOT found THEN next END)) AS ptr, range(count(*)) AS hops FROM own GROUP BY subject),
 walked AS (SELECT subject, 0::BIGINT AS k, ptr, hops, []::VARCHAR[] AS done, NULL::BIGINT AS seq, false AS ok, false AS late FROM base
  UNION ALL SELECT subject, k, CASE WHEN fine THEN map_concat(ptr, MAP {statement_id: successor_id}) ELSE ptr END, hops, CASE WHEN fine THEN list_append(done, statement_id) ELSE done END, seq, fine, was
  FROM (SELECT w.subject, f.k, w.ptr, w.hops, w.done, f.seq, f.statement_id, f.successor_id, list_contains(w.done, f.statement_id) AS was, NOT was AND list_reduce(list_prepend(f.successor_id, list_transform(w.hops, lambda i: '')), lambda x, y: CASE WHEN x = f.statement_id THEN x ELSE element_at(w.ptr, x)[1] END) IS DISTINCT FROM f.statement_id AS fine FROM walked w JOIN f ON f.subject = w.subject AND f.k = w.k + 1)),
 out AS (SELECT e.statement_id, e.successor_id, e.seq, CASE WHEN NOT e.found OR w.late THEN 'NO_LONGER_APPLICABLE' WHEN w.ok THEN 'REPAIRED' ELSE 'REJECTED' END AS outcome FROM e LEFT JOIN walked w ON w.subject = e.subject AND w.seq = e.seq) """


def _repairs(spark, sf_dir):
    """For each statement of a customer's priorities two edges in turn: to the one before and the one after."""
    rows = view(spark, sf_dir, "fx_statement")
    order = Window.partitionBy("subject_entity_id").orderBy("asserted_at", "statement_id")
    seq = F.split_part("statement_id", F.lit(":"), F.lit(3)).cast("long") * 2
    own = rows.filter("predicate_key = 'preferredPriority'").select("statement_id", seq.alias("seq"), F.lag("statement_id").over(order).alias("earlier"), F.lead("statement_id").over(order).alias("later"))
    edges = own.select("statement_id", F.inline(F.array(F.struct(F.col("earlier").alias("successor_id"), F.col("seq")), F.struct(F.col("later").alias("successor_id"), (F.col("seq") + 1).alias("seq")))))
    return rows, repair.repairs(rows, edges.filter("successor_id IS NOT NULL"))


@query(REPAIRS + "SELECT statement_id, successor_id, seq, outcome FROM out")
def j11_repairs(spark, sf_dir):
    return _repairs(spark, sf_dir)[1]


@query(WALKS + """, f AS (SELECT s.statement_id, CASE WHEN s.superseded_by_statement_id IS NULL THEN 'missing_successor' WHEN t.statement_id IS NULL THEN 'dangling_successor' WHEN t.subject_entity_id <> s.subject_entity_id OR t.predicate_key <> s.predicate_key THEN 'incompatible_successor' END AS note
 FROM fx_statement s LEFT JOIN fx_statement t ON t.statement_id = s.superseded_by_statement_id WHERE s.status = 'superseded'),
 a AS (SELECT note, CASE note WHEN 'incompatible_successor' THEN 'repair' ELSE 'clarify' END AS route FROM f WHERE note IS NOT NULL UNION ALL SELECT 'supersession_cycle', 'escalate' FROM fx_statement WHERE status = 'superseded' AND statement_id IN (SELECT id FROM loop)) SELECT note, route, count(*) AS n FROM a GROUP BY 1, 2""")
def j10_routed_findings(spark, sf_dir):
    return repair.routed(audits.supersession_findings(view(spark, sf_dir, "fx_statement"))).groupBy("note", "route").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT sha256(feedback_type || severity) AS fingerprint, count(*) AS n FROM fx_feedback WHERE report_id % 2 = 0 GROUP BY 1), f AS (SELECT sha256(feedback_type || severity) AS fingerprint, count(*) AS n FROM fx_feedback WHERE report_id % 2 = 1 GROUP BY 1), u AS (SELECT * FROM o UNION ALL SELECT * FROM f)
SELECT fingerprint, CAST(sum(n) AS BIGINT) AS occurrence_count FROM u GROUP BY 1""")
def j10_open_issues(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_feedback")
    mark = F.sha2(F.concat("feedback_type", "severity"), 256)
    old = rows.filter("report_id % 2 = 0").groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("occurrence_count"))
    return repair.issues(old, rows.filter("report_id % 2 = 1"), mark)


@query("""
SELECT 'new:' || statement_id AS statement_id, statement_id AS supersedes_id, subject_entity_id, predicate_key, object_string, valid_from + INTERVAL 1 DAY AS valid_from FROM fx_statement WHERE status = 'asserted' AND predicate_key = 'preferredPriority' AND valid_from IS NOT NULL""")
def j03_correct(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_statement")
    patch = rows.filter("predicate_key = 'preferredPriority' AND valid_from IS NOT NULL").select("statement_id", F.lit(None).cast("string").alias("object_string"), F.expr("valid_from + INTERVAL 1 DAY").alias("valid_from"))
    return changes.supersede(rows, patch)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'note' ELSE NULL END AS note FROM supplier")
def j23_metadata_merge(spark, sf_dir):
    old = F.create_map(F.lit("kind"), F.lit("old"))
    new = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("kind"), F.lit("new"), F.lit("note"), F.lit("note"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = changes.merged_metadata(old, new)
    return table(spark, sf_dir, "supplier").select("s_suppkey", merged["kind"].alias("kind"), F.try_element_at(merged, F.lit("note")).alias("note"))


@query(f"WITH edge AS ({PARENTS}), r AS (SELECT child AS node, parent, row_number() OVER (PARTITION BY parent ORDER BY child) AS k FROM edge) SELECT parent AS concept, node AS support FROM r WHERE k <= 3")
def i09_connected_support(spark, sf_dir):
    edges = _edges(spark, sf_dir).select(F.col("parent").alias("concept"), F.col("child").alias("support"))
    return graph.connected_support(edges.select("concept").distinct(), edges, 3)


@query(ROOTS + """, a AS (SELECT 'customer:' || c_custkey AS anchor FROM customer WHERE c_custkey % 20 = 0),
 f AS (SELECT a.anchor, s.statement_id, row_number() OVER (PARTITION BY a.anchor ORDER BY coalesce(s.valid_from, s.asserted_at), s.asserted_at, s.statement_id) AS k FROM a JOIN fx_statement s ON s.object_entity_id = a.anchor WHERE s.value_kind = 'entity' AND s.status <> 'retracted') SELECT anchor, statement_id FROM f WHERE k <= 40""")
def i08_anchor_expansion(spark, sf_dir):
    anchors = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("anchor"))
    rows = view(spark, sf_dir, "fx_statement").filter("value_kind = 'entity' AND status <> 'retracted'")
    found = rows.join(anchors, rows.object_entity_id == anchors.anchor).withColumn("query_id", F.col("anchor"))
    order = [F.coalesce("valid_from", "asserted_at"), F.col("asserted_at"), F.col("statement_id")]
    return retrieval.capped(found, "query_id", "anchor", order).select("anchor", "statement_id")


@query()
def h13_statement_scores(spark, sf_dir):
    return _found(spark, sf_dir, _asked(spark), 100).filter("hit_type = 'statement'")


@query("""
WITH b AS (SELECT subject_entity_id, statement_id AS related_id, row_number() OVER (PARTITION BY subject_entity_id ORDER BY asserted_at DESC, statement_id DESC) AS k FROM fx_statement WHERE status = 'asserted'),
 r AS (SELECT s.statement_id, related_id, row_number() OVER (PARTITION BY s.statement_id ORDER BY k) AS place FROM fx_statement s JOIN b USING (subject_entity_id) WHERE s.statement_id <> related_id) SELECT statement_id, related_id, place FROM r WHERE place <= 5""")
def f11_related_facts(spark, sf_dir):
    return facts.related(view(spark, sf_dir, "fx_statement"))


NEAREST = """WITH p AS (SELECT p_partkey AS proposal_id, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS t FROM part WHERE p_partkey % 20 = 0), c AS (SELECT DISTINCT p_type AS concept, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS u FROM part),
 s AS (SELECT proposal_id, concept, round(len(list_intersect(t, u))::DOUBLE / len(list_distinct(list_concat(t, u))), 6) AS score FROM p, c WHERE len(list_intersect(t, u)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY score DESC, concept) AS place FROM s WHERE score >= 0.28) """


def _nearest_types(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("proposal_id"), text.words(F.concat("p_name", F.lit(" "), "p_type")).alias("tokens"))
    concepts = p.select(F.col("p_type").alias("concept")).distinct().select("concept", text.words(F.col("concept")).alias("tokens"))
    return governance.lexical_nearest(asked, concepts)


@query(NEAREST + "SELECT proposal_id, concept, score, place, CASE WHEN score >= 0.55 THEN 1 ELSE 2 END AS tier FROM r WHERE place <= 12")
def f07_lexical_nearest(spark, sf_dir):
    return _nearest_types(spark, sf_dir)


PACKED = NEAREST.replace("WITH p AS", "WITH RECURSIVE p AS") + """, cand AS (SELECT proposal_id, CASE WHEN score >= 0.55 THEN 1 ELSE 2 END AS tier, place AS id, length(concept) * 10 AS t, row_number() OVER (PARTITION BY proposal_id ORDER BY CASE WHEN score >= 0.55 THEN 1 ELSE 2 END, place) AS k FROM r WHERE place <= 12),
 w AS (SELECT proposal_id, 0::BIGINT AS k, 0::BIGINT AS used, -1::BIGINT AS closed, 0 AS n, ''::VARCHAR AS ids FROM cand WHERE k = 1
  UNION ALL SELECT c.proposal_id, c.k, CASE WHEN takes THEN used + t ELSE used END, CASE WHEN NOT takes AND open AND tier <> 0 THEN tier ELSE closed END, CASE WHEN takes THEN n + 1 ELSE n END, CASE WHEN takes THEN ids || CASE WHEN n > 0 THEN ',' ELSE '' END || id ELSE ids END
  FROM (SELECT c.*, w.used, w.closed, w.n, w.ids, w.n < 8 AND c.tier <> w.closed AS open, w.n < 8 AND c.tier <> w.closed AND (w.used + c.t <= 600 OR w.n = 0) AS takes FROM w JOIN cand c ON c.proposal_id = w.proposal_id AND c.k = w.k + 1) c)
SELECT proposal_id, used::BIGINT AS used_tokens, ids AS packed_ids FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY k DESC) AS last FROM w) WHERE last = 1"""


REVIEWED = NEAREST + """, known AS (SELECT DISTINCT p_type AS concept FROM part UNION SELECT DISTINCT p_brand FROM part), link AS (SELECT DISTINCT p_brand AS parent, p_type AS child FROM part),
 ask AS (SELECT p_partkey AS proposal_id, CASE (p_partkey // 20) % 3 WHEN 0 THEN p_type WHEN 1 THEN '  ' || lower(p_type) ELSE 'New' || p_partkey END AS key, p_brand AS parent, CASE WHEN p_partkey % 40 = 0 THEN [p_brand, 'nothing'] ELSE []::VARCHAR[] END AS pins FROM part WHERE p_partkey % 20 = 0),
 near AS (SELECT proposal_id, concept, score FROM r WHERE place <= 12),
 way AS (SELECT proposal_id, concept, 0 AS tier, 1.0::DOUBLE AS score, 'exact' AS reason FROM ask JOIN known ON lower(concept) = lower(trim(key))
  UNION ALL SELECT a.proposal_id, p_type, 0, 0.98::DOUBLE, 'alias' FROM ask a JOIN part ON lower(key) = 'new' || p_partkey WHERE p_partkey % 60 = 40
  UNION ALL SELECT proposal_id, concept, 0, 0.99::DOUBLE, 'pin' FROM (SELECT proposal_id, unnest(pins) AS concept FROM ask) WHERE concept IN (SELECT concept FROM known)
  UNION ALL SELECT proposal_id, concept, CASE WHEN score >= 0.55 THEN 0 ELSE 1 END, score, 'lexical' FROM near
  UNION ALL SELECT proposal_id, parent, 1, 0.72::DOUBLE, 'parent' FROM ask
  UNION ALL SELECT a.proposal_id, child, CASE WHEN coalesce(n.score, 0) >= 0.35 THEN 1 ELSE 2 END, 0.45::DOUBLE + 0.45::DOUBLE * coalesce(n.score, 0), 'sibling' FROM ask a JOIN link l ON l.parent = a.parent AND child <> key LEFT JOIN near n ON n.proposal_id = a.proposal_id AND n.concept = child),
 best AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, concept ORDER BY tier, reason = 'pin', score DESC, reason) AS k FROM way) SELECT proposal_id, concept, tier, round(score, 6) AS score, reason FROM best WHERE k = 1"""


@query(REVIEWED)
def j18_review_candidates(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    way = F.floor(k / 20) % 3
    key = F.when(way == 0, F.col("p_type")).when(way == 1, F.concat(F.lit("  "), F.lower("p_type"))).otherwise(F.concat(F.lit("New"), k))
    pins = F.when(k % 40 == 0, F.array("p_brand", F.lit("nothing")))
    asked = p.filter(k % 20 == 0).select(k.alias("proposal_id"), key.alias("key"), F.array("p_brand").alias("parent_keys"), pins.alias("pins"))
    concepts = p.select(F.col("p_type").alias("concept")).union(p.select("p_brand")).distinct()
    aliases = p.filter(k % 60 == 40).select(F.concat(F.lit("New"), k).alias("alias"), F.col("p_type").alias("concept"))
    links = p.select(F.col("p_brand").alias("parent"), F.col("p_type").alias("child")).distinct()
    return governance.review_candidates(asked, concepts, aliases, links, _nearest_types(spark, sf_dir))


@query(PACKED)
def j18_review_context(spark, sf_dir):
    near = _nearest_types(spark, sf_dir).select("proposal_id", "tier", F.col("place").cast("long").alias("candidate_id"), (F.length("concept") * 10).alias("tokens"))
    return governance.packed(near, "proposal_id", "tokens", 600, 8)


@query("""
WITH a AS (SELECT doc_id % 40 AS proposal_id, doc_id AS ask_id, CASE WHEN toxic = 1 THEN 'answered' ELSE 'open' END AS status FROM labels) SELECT proposal_id, ask_id, CASE WHEN status = 'open' AND ask_id < max(ask_id) FILTER (status = 'open') OVER (PARTITION BY proposal_id) THEN 'superseded' ELSE status END AS status FROM a""")
def j20_superseded_asks(spark, sf_dir):
    asks = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("proposal_id"), F.col("doc_id").alias("ask_id"), F.when(F.col("toxic") == 1, "answered").otherwise("open").alias("status"))
    return governance.superseded_asks(asks)


@query(NEAREST + "SELECT proposal_id, sha256(string_agg(concept || ':' || CASE WHEN score >= 0.55 THEN 1 ELSE 2 END, ';' ORDER BY place)) AS context_hash FROM r WHERE place <= 12 GROUP BY 1")
def h29_context_hash(spark, sf_dir):
    return governance.context_hashes(_nearest_types(spark, sf_dir), "proposal_id", "place", F.concat_ws(":", "concept", "tier"))


@query(NEAREST + """, a AS (SELECT proposal_id, list(concept ORDER BY place) AS c FROM r WHERE place <= 2 GROUP BY 1), k AS (SELECT proposal_id, 'Part' || proposal_id AS key, c FROM (SELECT DISTINCT p_partkey AS proposal_id FROM part WHERE p_partkey % 20 = 0) LEFT JOIN a USING (proposal_id))
SELECT proposal_id, coalesce('Explain how ' || key || ' differs from ' || c[1] || '.|Provide an example assertion that should be valid for ' || key || ' but not for ' || c[1] || '.|', '') || coalesce('Explain how ' || key || ' differs from ' || c[2] || '.|Provide an example assertion that should be valid for ' || key || ' but not for ' || c[2] || '.|', '')
 || 'State whether ' || key || ' represents an ability, a domain/category, a relation, or something else.' AS asks FROM k""")
def h31_default_asks(spark, sf_dir):
    key = F.concat(F.lit("Part"), "proposal_id")
    asked = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("proposal_id"))
    related = asked.join(_nearest_types(spark, sf_dir), "proposal_id", "left").select("proposal_id", key.alias("key"), "concept", "place")
    return governance.default_asks(related).select("proposal_id", F.array_join("asks", "|").alias("asks"))


PROPOSED = """WITH p AS (SELECT p_partkey AS proposal_id, CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'predicate' WHEN 2 THEN 'constraint' WHEN 3 THEN 'alias' ELSE 'class_parent' END AS kind, CASE WHEN p_partkey % 31 <> 0 THEN 'core' END AS namespace_key,
 CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN 'newKey' WHEN 3 THEN 'NewKey' WHEN 4 THEN 'contains' ELSE 'bad key' END AS key, CASE p_partkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'string' WHEN 2 THEN 'colour' ELSE 'number' END AS value_kind, CASE WHEN p_partkey % 3 <> 0 THEN 'one' END AS cardinality, CASE WHEN p_partkey % 2 = 0 THEN 'unique' END AS constraint_type,
 CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE 'fresh' END AS alias, CASE WHEN p_partkey % 4 < 2 THEN 'class' ELSE 'predicate' END AS target_type, CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN 'contains' ELSE 'Nothing' END AS target_key,
 CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS child_key, CASE WHEN p_partkey % 3 = 1 THEN p_type WHEN p_partkey % 19 = 0 THEN 'Nothing' ELSE p_brand END AS parent_key, CASE WHEN p_partkey % 17 = 0 THEN [p_brand, 'Nothing'] WHEN p_partkey % 13 = 0 THEN ['NewKey'] ELSE [p_brand] END AS parent_keys,
 CASE WHEN p_partkey % 23 = 0 THEN ['Nothing'] ELSE [p_type] END AS domain_keys, CASE WHEN p_partkey % 8 < 3 THEN [p_brand] ELSE []::VARCHAR[] END AS range_keys, CASE WHEN p_partkey % 29 = 1 THEN 1 END AS base_revision FROM part),
 concepts AS (SELECT DISTINCT 'class' AS kind, p_brand AS key FROM part UNION SELECT DISTINCT 'class', p_type FROM part UNION SELECT 'predicate', 'contains'), up AS (SELECT DISTINCT p_brand AS node, p_type AS ancestor FROM part UNION SELECT DISTINCT p_brand, p_brand FROM part UNION SELECT DISTINCT p_type, p_type FROM part), """


@query(PROPOSED + """
 has(kind, keys) AS (SELECT kind, list(key) FROM concepts GROUP BY 1), f AS (SELECT p.*, coalesce(namespace_key, '') = 'core' AS core, (SELECT keys FROM has WHERE kind = 'class') AS classes, (SELECT keys FROM has WHERE kind = 'predicate') AS predicates FROM p),
 g AS (SELECT *, core AND kind IN ('class', 'predicate') AND len(list_filter(CASE kind WHEN 'class' THEN classes ELSE predicates END, lambda x: lower(x) = lower(key))) > 0 AS spelled,
  core AND list_contains(classes, child_key) AS has_child, core AND list_contains(classes, parent_key) AS has_parent, core AND list_contains(CASE target_type WHEN 'class' THEN classes ELSE predicates END, target_key) AS has_target,
  core AND list_has_all(classes, parent_keys) AS has_parents, core AND list_has_all(classes, domain_keys) AS has_domains, len(range_keys) = 0 OR (core AND list_has_all(classes, range_keys)) AS has_ranges FROM f),
 t AS (SELECT proposal_id, CASE WHEN namespace_key IS NULL OR (kind = 'predicate' AND cardinality IS NULL) OR (kind = 'constraint' AND constraint_type IS NULL) THEN 'fail' ELSE 'pass' END AS schema, 'pass' AS authorization_,
  CASE WHEN spelled AND (kind = 'class' OR base_revision IS NULL) THEN 'reuse' ELSE 'pass' END AS existing_key,
  CASE WHEN NOT spelled AND ((kind = 'class' AND NOT regexp_full_match(key, '[A-Z][A-Za-z0-9]*')) OR (kind = 'predicate' AND NOT regexp_full_match(key, '[a-z][A-Za-z0-9]*'))) THEN 'fail' ELSE 'pass' END AS key_shape,
  CASE WHEN kind = 'alias' AND core AND alias IN (SELECT lower(p_type) FROM part) THEN 'reuse' ELSE 'pass' END AS alias,
  CASE WHEN (kind = 'class' AND NOT has_parents) OR (kind = 'class_parent' AND NOT (has_child AND has_parent)) OR (kind = 'alias' AND NOT has_target) OR (kind = 'predicate' AND value_kind = 'colour') THEN 'fail' ELSE 'pass' END AS structural,
  CASE WHEN (kind = 'class_parent' AND has_child AND has_parent AND EXISTS (SELECT 1 FROM up WHERE node = parent_key AND ancestor = child_key)) OR (kind = 'class' AND list_contains(parent_keys, key)) THEN 'fail' ELSE 'pass' END AS cycle,
  CASE WHEN kind = 'predicate' AND (NOT has_domains OR NOT has_ranges OR (value_kind = 'entity') <> (len(range_keys) > 0)) THEN 'fail' ELSE 'pass' END AS domain_range FROM g),
 u AS (SELECT proposal_id, unnest(['schema', 'authorization', 'existing_key', 'key_shape', 'alias', 'structural', 'cycle', 'domain_range', 'final_deterministic']) AS gate, unnest([schema, authorization_, existing_key, key_shape, alias, structural, cycle, domain_range, CASE WHEN 'fail' IN (schema, existing_key, key_shape, alias, structural, cycle, domain_range) THEN 'fail' ELSE 'pass' END]) AS decision FROM t)
SELECT proposal_id, gate, decision FROM u""")
def j15_proposal_gates(spark, sf_dir):
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    pick = lambda n, *values: F.coalesce(*[F.when(k % n == i, v) for i, v in enumerate(values[:-1])], values[-1])
    lit, brand, parent = F.lit, F.col("p_brand"), F.col("p_type")
    given = p.select(
        k.alias("proposal_id"), pick(5, lit("class"), lit("predicate"), lit("constraint"), lit("alias"), lit("class_parent")).alias("kind"), F.when(k % 31 != 0, "core").alias("namespace_key"),
        pick(7, brand, F.lower(brand), lit("newKey"), lit("NewKey"), lit("contains"), lit("bad key")).alias("key"), pick(4, lit("entity"), lit("string"), lit("colour"), lit("number")).alias("value_kind"),
        F.when(k % 3 != 0, "one").alias("cardinality"), F.when(k % 2 == 0, "unique").alias("constraint_type"), F.when(k % 2 == 0, F.lower(parent)).otherwise("fresh").alias("alias"), F.when(k % 4 < 2, "class").otherwise("predicate").alias("target_type"),
        pick(6, brand, lit("contains"), lit("Nothing")).alias("target_key"), F.when(k % 3 == 0, parent).otherwise(brand).alias("child_key"), F.when(k % 3 == 1, parent).when(k % 19 == 0, "Nothing").otherwise(brand).alias("parent_key"),
        F.when(k % 17 == 0, F.array(brand, lit("Nothing"))).when(k % 13 == 0, F.array(lit("NewKey"))).otherwise(F.array(brand)).alias("parent_keys"), F.when(k % 23 == 0, F.array(lit("Nothing"))).otherwise(F.array(parent)).alias("domain_keys"),
        F.when(k % 8 < 3, F.array(brand)).otherwise(F.array().cast("array<string>")).alias("range_keys"), F.when(k % 29 == 1, 1).alias("base_revision"),
    )
    core = lambda kind, key: p.select(lit(kind).alias("kind"), lit("core").alias("namespace_key"), key.alias("key")).distinct()
    concepts = core("class", brand).union(core("class", parent)).union(core("predicate", lit("contains")))
    aliases = p.select(lit("core").alias("namespace_key"), F.lower(parent).alias("alias")).distinct()
    up = graph.closure(p.select(brand.alias("child"), parent.alias("parent")).distinct(), concepts.filter("kind = 'class'").select(F.col("key").alias("node")))
    return proposals.gates(given, concepts, aliases, up)


@query("""
WITH g AS (SELECT p_partkey AS proposal_id, 'key_shape' AS gate, CASE WHEN p_size > 25 THEN 'pass' ELSE 'fail' END AS decision FROM part), n AS (SELECT p_partkey AS proposal_id, 'key_shape' AS gate, 'pass' AS decision FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'final_deterministic', 'pass' FROM part WHERE p_size % 3 = 1)
SELECT * FROM n UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.proposal_id = g.proposal_id AND n.gate = g.gate)""")
def a08_gate_upsert(spark, sf_dir):
    row = lambda where, gate, decision: table(spark, sf_dir, "part").filter(where).select(F.col("p_partkey").alias("proposal_id"), F.lit(gate).alias("gate"), decision.alias("decision"))
    old = row("true", "key_shape", F.when(F.col("p_size") > 25, "pass").otherwise("fail"))
    new = row("p_size % 3 = 0", "key_shape", F.lit("pass")).union(row("p_size % 3 = 1", "final_deterministic", F.lit("pass")))
    return changes.upsert(old, new, ["proposal_id", "gate"])


@query("""
WITH e AS (SELECT DISTINCT lower(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g'))) AS norm, class_key, min(entity_id) OVER (PARTITION BY lower(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g'))), class_key) AS have FROM fx_entity WHERE status = 'active'),
 i AS (SELECT o_orderkey % 50 AS batch_id, 'c' || o_orderkey AS client_ref, lower(CASE WHEN o_orderkey % 3 = 0 THEN 'Customer ' || o_custkey ELSE 'Order#' || o_orderkey END) AS norm, CASE WHEN o_orderkey % 3 = 0 THEN 'Organization' ELSE 'Event' END AS class_key FROM orders),
 r AS (SELECT i.*, have, row_number() OVER (PARTITION BY i.norm, i.class_key ORDER BY batch_id, client_ref) AS k FROM i LEFT JOIN e ON e.norm = i.norm AND e.class_key = i.class_key)
SELECT batch_id, client_ref, coalesce(have, 'new:' || sha256(class_key || ':' || norm)) AS entity_id, CASE WHEN have IS NULL AND k = 1 THEN 'CREATE' ELSE 'REUSE' END AS outcome FROM r""")
def a11_ingest_entities(spark, sf_dir):
    k, third = F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0
    items = table(spark, sf_dir, "orders").select((k % 50).alias("batch_id"), F.concat(F.lit("c"), k).alias("client_ref"), F.when(third, F.concat(F.lit("Customer "), "o_custkey")).otherwise(F.concat(F.lit("Order#"), k)).alias("canonical_name"), F.when(third, "Organization").otherwise("Event").alias("class_key"))
    return changes.ingest_entities(items, view(spark, sf_dir, "fx_entity"))


@query("""
WITH i AS (SELECT o_orderkey % 50 AS batch_id, o_orderkey AS item, 'c' || o_orderkey AS subject_ref, CASE WHEN o_orderkey % 7 = 0 THEN 'c-unknown' WHEN o_orderkey % 2 = 0 THEN 'customer:' || o_custkey END AS object_ref, o_orderpriority AS object_string FROM orders),
 k AS (SELECT *, object_ref IS NOT NULL AND object_ref = 'c-unknown' AS lost, 'new:order' || item AS s, CASE WHEN object_ref IS NOT NULL THEN 'entity:' || object_ref ELSE 'string:' || object_string END AS o FROM i)
SELECT batch_id, item, CASE WHEN lost THEN 'REJECTED' ELSE 'CREATE' END AS outcome, CASE WHEN NOT lost THEN 'new:' || batch_id || '/' || item END AS statement_id FROM k""")
def a11_ingest_statements(spark, sf_dir):
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    batch, ref, none = (k % 50).alias("batch_id"), F.concat(F.lit("c"), k), F.lit(None)
    items = orders.select(batch, k.alias("item"), ref.alias("subject_ref"), F.lit("about").alias("predicate_key"), F.when(k % 7 == 0, "c-unknown").when(k % 2 == 0, F.concat(F.lit("customer:"), "o_custkey")).alias("object_ref"), F.col("o_orderpriority").alias("object_string"), none.cast("timestamp").alias("valid_from"), none.cast("timestamp").alias("valid_to"))
    ends = orders.select(batch, ref.alias("client_ref"), F.concat(F.lit("new:order"), k).alias("entity_id")).union(view(spark, sf_dir, "fx_entity").select(none.cast("long"), none.cast("string"), "entity_id"))
    have = view(spark, sf_dir, "fx_statement").select("statement_id", "subject_entity_id", "predicate_key", F.concat(F.lit("string:"), "object_string").alias("object_key"), "valid_from", "valid_to", "status")
    return changes.ingest_statements(items, ends, have)


@query("""
WITH b AS (SELECT doc_id, 'doc-src:' || source AS source_id, sha256(rtrim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), chr(10)) || chr(10)) AS h FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT source_id, count(*) AS n FROM (SELECT source_id, h, lag(h) OVER (PARTITION BY source_id ORDER BY doc_id) AS before FROM b) WHERE h IS DISTINCT FROM before GROUP BY 1""")
def a10_appended_revisions(spark, sf_dir):
    """Revisions of each source when its documents with the greater half of ids are appended to the others."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_id"), F.concat(F.lit("doc-src:"), "source").alias("source_id"), F.col("text").alias("content"), F.lit("text").alias("content_format"), F.timestamp_seconds("doc_id").alias("captured_at"))
    # Both sides are cut at the same id, whenever it is worked out: an approximate one can differ.
    half = docs.agg(F.floor((F.min("ingest_id") + F.max("ingest_id")) / 2).alias("half"))
    docs = docs.crossJoin(half)
    first = content.revisions(docs.filter("ingest_id <= half"))
    added = content.append_revisions(first, docs.filter("ingest_id > half"))
    return first.select("source_id", "revision").union(added.select("source_id", "revision")).groupBy("source_id").agg(F.max("revision").cast("long").alias("n"))


CLARIFIED = """WITH c AS (SELECT o_orderkey AS request_id, 'clarify:' || o_orderkey AS id, o_orderdate AS made, o_orderdate + INTERVAL 30 MINUTE AS ends, list_sort(list_distinct(['part:' || (o_orderkey % 90 + 1), 'part:' || (o_orderkey % 70 + 2), 'part:' || (o_orderkey % 50 + 3)])) AS cand FROM orders WHERE o_orderkey % 3 <> 0),
 h AS (SELECT entity_id, status, updated_at AS moment FROM fx_entity WHERE entity_id LIKE 'part:%' UNION ALL SELECT 'part:' || p_partkey, 'deprecated', TIMESTAMP '1996-01-01' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'part:' || p_partkey, 'active', TIMESTAMP '1992-01-01' FROM part),
 a AS (SELECT o_orderkey * 3 + k AS answer_id, 'clarify:' || o_orderkey AS id, CASE (o_orderkey + k) % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'create_new' WHEN 4 THEN 'chosen_entity' ELSE 'chosen_entity' END AS res, 'part:' || CASE WHEN (o_orderkey + k) % 7 = 0 THEN 999999 ELSE o_orderkey % 90 + 1 END AS pick, o_orderdate + k * INTERVAL 14 MINUTE AS moment FROM orders CROSS JOIN range(3) r(k) WHERE o_orderkey % 2 = 0),
 l AS (SELECT a.*, c.cand, CASE WHEN c.id IS NULL THEN 'NOT_FOUND' WHEN a.moment > c.ends THEN 'EXPIRED' WHEN res = 'reject' THEN 'REJECTED' WHEN res = 'create_new' THEN 'CREATED' WHEN list_contains(cand, pick) THEN 'CHOSEN' ELSE 'INVALID' END AS look FROM a LEFT JOIN c ON c.id = a.id),
 u AS (SELECT answer_id, pick, moment, unnest(cand) AS e FROM l WHERE look = 'CHOSEN'), s AS (SELECT u.*, coalesce((SELECT max_by(h.status, h.moment) FROM h WHERE h.entity_id = u.e AND h.moment <= u.moment) = 'active', false) AS active FROM u),
 n AS (SELECT answer_id, bool_or(active AND e = pick) AS still, count(*) FILTER (active) AS k FROM s GROUP BY 1),
 m AS (SELECT l.* EXCLUDE (look), CASE WHEN look = 'CHOSEN' AND NOT still THEN CASE WHEN k > 1 THEN 'SUPERSEDED' ELSE 'RERUN' END ELSE look END AS look FROM l LEFT JOIN n USING (answer_id)),
 f AS (SELECT id, arg_min(answer_id, answer_id) AS closer, arg_min(look, answer_id) AS how FROM m WHERE look NOT IN ('NOT_FOUND', 'EXPIRED', 'INVALID') GROUP BY 1),
 o AS (SELECT answer_id, m.id AS clarification_id, CASE WHEN closer < answer_id AND look NOT IN ('NOT_FOUND', 'EXPIRED') THEN CASE WHEN how = 'SUPERSEDED' THEN 'ALREADY_SUPERSEDED' ELSE 'ALREADY_RESOLVED' END ELSE look END AS outcome, pick FROM m LEFT JOIN f ON f.id = m.id) """


def _clarified(spark, sf_dir):
    """Every third order asks nothing; every second one is answered three times, 14 minutes apart."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    part = lambda n, plus: F.concat(F.lit("part:"), k % n + plus)
    requests = orders.select(k.alias("request_id"), F.col("o_orderdate").alias("created_at"))
    listed = orders.select(k.alias("request_id"), F.explode(F.array(part(90, 1), part(70, 2), part(50, 3))).alias("entity_id"))
    made = clarifications.issue(requests, listed, orders.select(k.alias("request_id"), F.when(k % 3 != 0, "AMBIGUOUS").otherwise("MATCH").alias("outcome")))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("entity_id"), "p_partkey")
    at = lambda x: F.lit(x).cast("timestamp")
    history = view(spark, sf_dir, "fx_entity").filter("entity_id LIKE 'part:%'").select("entity_id", "status", F.col("updated_at").alias("changed_at"))
    history = history.union(p.filter("p_partkey % 4 = 1").select("entity_id", F.lit("deprecated"), at("1996-01-01"))).union(p.select("entity_id", F.lit("active"), at("1992-01-01")))
    n = F.col("n")
    answers = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderdate", F.explode(F.array(*map(F.lit, range(3)))).alias("n")).select(
        (k * 3 + n).alias("answer_id"), F.concat(F.lit("clarify:"), k).alias("clarification_id"), F.when((k + n) % 5 == 0, "reject").when((k + n) % 5 == 1, "create_new").otherwise("chosen_entity").alias("resolution"),
        F.when((k + n) % 7 == 0, "part:999999").otherwise(part(90, 1)).alias("chosen_entity_id"), (F.col("o_orderdate") + F.make_interval(mins=n * 14)).alias("answered_at"),
    )
    return made, *clarifications.answered(made, answers, history)


@query(CLARIFIED + "SELECT answer_id, clarification_id, outcome, CASE WHEN outcome = 'CHOSEN' THEN pick END AS entity_id FROM o")
def j14_answers(spark, sf_dir):
    return _clarified(spark, sf_dir)[1]


@query(CLARIFIED + """, closed AS (SELECT clarification_id, bool_or(outcome = 'SUPERSEDED') AS again FROM o WHERE outcome IN ('REJECTED', 'CREATED', 'CHOSEN', 'RERUN', 'SUPERSEDED') GROUP BY 1),
 every_ AS (SELECT id AS clarification_id, made, ends FROM c UNION ALL SELECT o.clarification_id || '+', m.moment, m.moment + INTERVAL 30 MINUTE FROM o JOIN m USING (answer_id) WHERE o.outcome = 'SUPERSEDED')
SELECT e.clarification_id, CASE WHEN again THEN 'superseded' WHEN again IS NOT NULL THEN 'resolved' WHEN ends < TIMESTAMP '1996-01-05 00:20:00' THEN 'expired' ELSE 'open' END AS state FROM every_ e LEFT JOIN closed USING (clarification_id) WHERE made >= TIMESTAMP '1996-01-05 00:20:00' - INTERVAL 7 DAY""")
def j14_clarification_states(spark, sf_dir):
    made, told, new = _clarified(spark, sf_dir)
    return clarifications.states(made.union(new), told, "1996-01-05 00:20:00")
