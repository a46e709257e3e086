"""Rules on small inputs: text, time, identity, retrieval, packing, graph, content."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factgraph.functions import identity as ids
from factgraph.functions import temporal, text
from factgraph.operators import audits, changes, clarifications, content, facts, governance, graph, identity, redaction, repair, reporting, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "query, field, score",
    [
        ("Alba", "Alba", 1.0),
        ("Alba Airbus", "Alba", 0.95),
        ("legacy start date of Alba today", "Alba", 0.40 + 0.25 / 4),
        ("red plate", "a big red plate here", 0.85),
        ("the of", "say the of it", 0.85),
        ("of, the", "nothing", 0.25),
        ("plate red", "red thing, plate thing", 0.75),
        ("plate red blue", "red thing, plate thing", 0.45 + 0.25 * 2 / 3),
        ("plate red blue", "red thing", 0.38),
        ("plate red", "none", 0.15),
        ("", "none", 0.0),
    ],
)
def test_lexical(spark, query, field, score):
    q = F.lit(query)
    assert one(spark, text.lexical(q, text.content_tokens(q), text.phrase(q), F.array(F.lit(field))))["score"] == pytest.approx(score)


@pytest.mark.parametrize("query, intent", [("previous role", "historical"), ("current role", "current"), ("before this current role", "historical"), ("history of the current role", "current"), ("when was it", "historical"), ("where is it", "neutral"), ("", "neutral"), (None, "neutral"), ("used to live", "historical"), ("unused today", "historical")])
def test_intent(spark, query, intent):
    assert one(spark, temporal.intent(F.lit(query).cast("string"))) == intent


def test_overlap_is_closed_and_open_without_bounds(spark):
    t = lambda d: F.lit(d).cast("timestamp")
    assert one(spark, temporal.overlap(t("2020-01-01"), t("2020-02-01"), t("2020-02-01"), t(None)))
    assert not one(spark, temporal.overlap(t("2020-01-01"), t("2020-02-01"), t("2020-02-02"), t(None)))
    assert one(spark, temporal.overlap(t(None), t(None), t(None), t(None)))


def test_keys(spark):
    assert one(spark, text.suggest_class_key(F.lit(" big red-plate 7"))) == "BigRedPlate7"
    assert one(spark, text.suggest_predicate_key(F.lit("Works at"))) == "worksAt"
    assert one(spark, text.suggest_predicate_key(F.lit("EmployedBy"))) == "employedBy"
    assert one(spark, text.suggest_class_key(F.lit("--"))) == "--"
    assert one(spark, text.source_system_key(F.lit(" Corp-Wiki! "))) == "corp_wiki"
    assert one(spark, text.normal(F.lit("  Straße  X\t\n y "))) == "strasse x y"
    assert one(spark, ids.locator(F.lit("r"), F.lit(3), F.lit(9), F.lit("H"))) == "rev:r#heading:H/offsets:3-9"
    assert one(spark, ids.locator(F.lit("r"), F.lit(None), F.lit(9), F.lit(None))) == "rev:r"
    assert one(spark, ids.object_key(F.lit("number"), F.lit(None), F.lit(None), F.lit("100.50").cast("decimal(10,2)"))) == "number:100.5"
    assert one(spark, ids.object_key(F.lit("number"), F.lit(None), F.lit(None), F.lit("100.00").cast("decimal(10,2)"))) == "number:100"


def test_canonical_body(spark):
    assert one(spark, text.canonical_body(F.lit("a  \r\nb\t\rc \n\n \n"))) == "a\nb\nc\n"
    assert one(spark, text.canonical_body(F.lit(" \n\n"))) == ""


def test_survivors_and_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")]
    df = spark.createDataFrame(rows, "entity_id string, merged_into_entity_id string")
    got = {r.entity_id: r.root for r in graph.survivors(df, rounds=6).collect()}
    assert [got[k] for k in "abc"] == ["a"] * 3 and got["z"] is None or got["z"] in ("x", "y")
    pointers = df.select(F.col("entity_id").alias("id"), F.col("merged_into_entity_id").alias("next"))
    assert {r.id for r in graph.endless(pointers).collect()} == {"x", "y", "z"}
    groups = {(r.survivor_id, r.member_id) for r in graph.identity_groups(df.filter("entity_id < 'd'"), direct_only=True).collect()}
    assert groups == {("a", "a"), ("a", "b")}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    nodes = spark.createDataFrame([(x,) for x in "abc"], "node string")
    assert graph.closure(edges, nodes).count() == 9


def test_packing_passes_over_pinned_only(spark):
    rows = [(1, 0, 1, 90), (1, 0, 2, 50), (1, 0, 3, 5), (1, 1, 4, 50), (1, 1, 5, 1), (1, 2, 6, 2), (2, 2, 7, 500)]
    df = spark.createDataFrame(rows, "p int, tier int, candidate_id long, t int")
    got = {r.p: r.packed_ids for r in governance.packed(df, "p", "t", 100, 10).collect()}
    assert got == {1: "1,3,6", 2: "7"}


def test_batch_creates_once(spark):
    at = dt.datetime(2020, 1, 1)
    schema = "request_id string, requested_at timestamp, subject_entity_id string, predicate_key string, object_key string, valid_from timestamp, valid_to timestamp"
    asked = spark.createDataFrame([("2", at, "s", "p", "o", None, None), ("1", at, "s", "p", "o", None, None), ("3", at, "s", "p", "x", None, None)], schema)
    have = spark.createDataFrame([("old", "asserted", "s", "p", "x", None, None)], "statement_id string, status string, subject_entity_id string, predicate_key string, object_key string, valid_from timestamp, valid_to timestamp")
    got = {r.request_id: (r.outcome, r.statement_id) for r in changes.assert_statements(have, asked.repartition(3)).collect()}
    assert got == {"1": ("CREATE", "new:1"), "2": ("REUSE", "new:1"), "3": ("REUSE", "old")}


def test_near_names_are_whole_words(spark):
    named = spark.createDataFrame([("e1", "alba", "canonical"), ("e2", "alba costa", "canonical"), ("e3", "albatic", "canonical")], "entity_id string, norm string, strength string")
    asked = spark.createDataFrame([(1, "Alba  Garcia"), (2, "Alba")], "request_id int, name string")
    assert {tuple(r) for r in identity.near_names(asked, named).collect()} == {(1, "e1"), (2, "e2")}


def test_markdown():
    html = "<html><head><title>t</title></head><body><h2>Head</h2><p>One <b>bold</b> <a href='u'>link</a></p><ul><li>a</li><li>b</li></ul><script>x</script></body></html>"
    assert content.markdown(html) == "## Head\n\nOne **bold** [link](u)\n\n- a\n- b\n"
    assert content.markdown("") == ""


def test_markdown_structures():
    html = """<html><head><title>t</title><style>x</style></head><body><h1>Hi <b>you</b></h1><p>One  two<em>!</em></p> tail <a href='u'>L</a>
<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x</li><li>y</li></ol><blockquote><p>q1</p><p>q2</p></blockquote><pre>a
  b</pre><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td> 2 </td></tr></tbody></table><div>d1</div><div>d2</div><hr>code <code>a`b</code><noscript>no</noscript></body></html>"""
    want = """# Hi **you**

One two*!*

tail [L](u)

- a
    - b
- c

1. x
2. y

> q1
>
> q2

```
a
  b
```

A | B
1 | 2

d1

d2

---

code `a\\`b`
"""
    assert content.markdown(html) == want
    assert content.markdown("<div>" * 5000 + "deep") == "deep\n" and content.markdown("<p>a</b><i>b") == "a*b*\n" and content.markdown("plain &amp; text") == "plain & text\n"


def test_embedding_providers(spark):
    texts = spark.createDataFrame([(1, "red plate"), (2, None)], "text_id int, text string")
    content.register_provider("lengths", lambda t: t.select("text_id", F.array(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("embedding")))
    got = {r.text_id: (r.model, list(r.embedding)) for r in content.embedded(texts, "lengths").collect()}
    assert got == {1: ("lengths", [9.0]), 2: ("lengths", [0.0])} and content.embedded(texts).count() == 2


def test_packed_keeps_what_matters(spark):
    import random

    rng = random.Random(2)
    rows = [(g, rng.choice((0, 0, 1, 2)), i, rng.randint(1, 60)) for g in ("a", "b", None) for i in range(80)]
    got = {r.g: (r.used_tokens, r.packed_ids) for r in governance.packed(spark.createDataFrame(rows, "g string, tier int, candidate_id long, t int").repartition(5), "g", "t", 100, 4).collect()}
    for g in ("a", "b", None):
        used, closed, taken = 0, -1, []
        for tier, i, t in sorted((tier, i, t) for x, tier, i, t in rows if x == g):
            if len(taken) >= 4 or tier == closed:
                continue
            if used + t <= 100 or not taken:
                used, taken = used + t, [*taken, i]
            elif tier:
                closed = tier
        assert got[g] == (used, ",".join(map(str, taken)))


def test_nearest_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(200, 5)).round(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(content.nearest(df, df.filter("vec_id % 20 = 0"), 3, 0.2).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        s = (u @ u[q]).round(6)
        want = sorted((-s[i], i) for i in range(200) if i != q and s[i] >= 0.2)[:3]
        assert [i for i, _ in got.get(q, [])] == [i for _, i in want]


def test_gold_cases_and_report(spark, tmp_path):
    gold = {"entities": {"alba": "e1"}, "cases": [{"id": "c1", "query": "who", "tags": ["name", "past"], "expected_entity_ids": ["alba", "e9"]}, {"id": "c2", "query": "none", "tags": [], "expected_entity_ids": []}]}
    path = tmp_path / "gold.json"
    path.write_text(json.dumps(gold, indent=1))
    got = [tuple(r) for r in reporting.gold_cases(spark, str(path)).orderBy("case_id", "expected_id").collect()]
    assert got == [("c1", "who", ["name", "past"], "e1"), ("c1", "who", ["name", "past"], "e9"), ("c2", "none", [], None)]
    reporting.write_report(spark.createDataFrame([("mrr", 0.5)], "metric string, value double"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "report")).select("metric", "value").collect()] == [("mrr", 0.5)]


def test_detectors(spark):
    reporting.register_detector("no_subject", lambda s: s.filter("subject_entity_id IS NULL").select("statement_id", F.lit("no subject").alias("note"), F.lit("high").alias("severity")))
    rows = spark.createDataFrame([("s1", None), ("s2", "e1")], "statement_id string, subject_entity_id string")
    try:
        assert [tuple(r) for r in reporting.inspect(rows).collect()] == [("s1", "no subject", "high", "no_subject")]
    finally:
        reporting.DETECTORS.clear()


def test_resolve_sources(spark):
    schema = "canonical_system string, external_id string, content_hash string"
    sources = spark.createDataFrame([("s1", "wiki", "1", "a"), ("s2", "wiki", "2", "b"), ("s3", "wiki", "2", "c"), ("s0", None, None, "b")], "source_id string, " + schema)
    asked = spark.createDataFrame([(1, "wiki", "1", "zz"), (2, "wiki", "2", "a"), (3, "wiki", "9", "b"), (4, None, None, "c"), (5, None, None, "q")], "request_id int, " + schema)
    got = {r.request_id: (r.outcome, r.source_id) for r in identity.resolve_sources(asked, sources).collect()}
    assert got == {1: ("MATCH", "s1"), 2: ("AMBIGUOUS", None), 3: ("MATCH", "s0"), 4: ("MATCH", "s3"), 5: ("CREATE", "new:q")}


def test_redaction():
    value = {"password": "x", "Title": "t", "deep": [{"api_key": 1, "ok": "y"}], "n": 3}
    assert redaction.redacted(value) == {"password": redaction.GONE, "Title": "t", "deep": [{"api_key": redaction.GONE, "ok": "y"}], "n": 3}
    assert redaction.redacted(value, texts=True)["Title"] == redaction.GONE


def test_same_answer_under_any_partitioning(spark):
    rows = [(i, f"red plate {i % 5}" if i % 3 else "blue ring") for i in range(60)]
    entities = spark.createDataFrame([(f"e{i}", name, "active", dt.datetime(2001, 1, 1)) for i, name in rows], "entity_id string, canonical_name string, status string, updated_at timestamp")
    queries = spark.createDataFrame([(1, "red plate 2"), (2, "ring")], "query_id int, query string")
    answers = [[tuple(r) for r in retrieval.top(retrieval.merged_hits(retrieval.entity_hits(entities.repartition(n), retrieval.prepared(queries), "2001-12-31")), 7).orderBy("query_id", "place").collect()] for n in (1, 7, 64)]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 14


def test_repeated_requests(spark):
    """Of several requests on one row the first counts, the others meet its outcome."""
    make = spark.createDataFrame
    old, new = make([(1, "a", 0), (2, "b", 0)], "k int, v string, at int"), make([(2, "x", 5), (2, "y", 4), (3, "z", 1)], "k int, v string, at int")
    assert sorted(map(tuple, changes.upsert(old, new, ["k"], ["at"]).collect())) == [(1, "a", 0), (2, "x", 5), (3, "z", 1)]
    facts = make([("s1", "asserted", "p", "e", "o", None), ("s2", "superseded", "p", "e", "o", None)], "statement_id string, status string, predicate_key string, subject_entity_id string, object_string string, valid_from timestamp")
    asked = make([("s1", 1), ("s1", 2), ("s2", 3), ("s9", 4)], "statement_id string, request_id int")
    assert sorted(map(tuple, changes.retract(facts, asked).collect())) == [("s1", "NO_CHANGE"), ("s1", "RETRACTED"), ("s2", "REJECTED"), ("s9", "REJECTED")]
    issues, notes = make([("i1", "open"), ("i2", "closed")], "issue_id string, status string"), make([("i1", " ", 1), ("i1", "done", 2), ("i1", "again", 3), ("i2", "x", 4)], "issue_id string, note string, request_id int")
    assert sorted(map(tuple, changes.resolve(issues, notes, "issue_id").collect())) == [("i1", "REJECTED"), ("i1", "REJECTED"), ("i1", "RESOLVED"), ("i2", "REJECTED")]
    twice = make([("s1", "new", None, 1), ("s1", "newer", None, 2)], "statement_id string, object_string string, valid_from timestamp, request_id int")
    assert [(r.statement_id, r.object_string) for r in changes.supersede(facts, twice).collect()] == [("new:s1", "new")]


def test_owners_prefixes(spark):
    df = spark.createDataFrame([("AlbaGoal",), ("Goal",)], "key string")
    args = (F.lit("class"), F.col("key"), F.lit(""), F.lit(""))
    assert [r.h for r in df.select(governance.modelling_hints(*args, owners=("alba",))["hint"].alias("h")).collect()] == ["core_leakage", None]
    assert [r.h for r in df.select(governance.modelling_hints(*args)["hint"].alias("h")).collect()] == [None, None]


def repairs_by_hand(statements, edges):
    """statements: {id: (subject, successor)}, all superseded, one predicate; edges one by one."""
    here = {i: n for i, (_, n) in statements.items()}

    def ends(i):
        for _ in range(len(here) + 1):
            i = here.get(i)
            if i is None:
                return True
        return False

    bad = {i for i, (subject, n) in statements.items() if n is None or n not in statements or statements[n][0] != subject or not ends(i)}
    under = {i for _, i, to in edges if i in bad and to in statements and to != i and statements[to][0] == statements[i][0]}
    here.update(dict.fromkeys(under))
    out, done = [], set()
    for seq, i, to in sorted(edges):
        if i not in statements:
            outcome = "REJECTED"
        elif i not in bad or i in done:
            outcome = "NO_LONGER_APPLICABLE"
        elif to not in statements or to == i or statements[to][0] != statements[i][0]:
            outcome = "REJECTED"
        else:
            at, steps = to, 0
            while at is not None and at != i and steps <= len(here):
                at, steps = here.get(at), steps + 1
            outcome = "REJECTED" if at == i else "REPAIRED"
            if outcome == "REPAIRED":
                here[i] = to
                done.add(i)
        out.append((i, to, seq, outcome))
    return sorted(out, key=str), here


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_in_order(spark, seed):
    """As if edges were taken one by one, whatever cycles they close together."""
    import random

    rng = random.Random(seed)
    ids_ = [f"s{i}" for i in range(40)]
    statements = {i: (f"e{rng.randrange(2)}", rng.choice([None, None, "gone", *ids_[:8]])) for i in ids_}
    edges = [(k, rng.choice([*ids_, "unknown"]), rng.choice(ids_)) for k in range(120)]
    df = spark.createDataFrame([(i, s, "p", "superseded", n) for i, (s, n) in statements.items()], "statement_id string, subject_entity_id string, predicate_key string, status string, superseded_by_statement_id string")
    asked = spark.createDataFrame([(i, to, k) for k, i, to in edges], "statement_id string, successor_id string, seq long")
    want, here = repairs_by_hand(statements, edges)
    got = repair.repairs(df, asked)
    assert sorted(map(tuple, got.collect()), key=str) == want
    after = repair.repaired(df, got)
    fixed = {i for i, _, _, o in want if o == "REPAIRED"}
    assert {r.statement_id: r.superseded_by_statement_id for r in after.collect() if r.statement_id in fixed} == {i: here[i] for i in fixed}
    issues = spark.createDataFrame([(f"i{i}", i, "open" if k % 5 else "dismissed") for k, i in enumerate(ids_)], "issue_id string, statement_id string, status string")
    closed = {r.statement_id: (r.status, r.resolution) for r in repair.closed_issues(issues, got, after).collect()}
    left = {r.statement_id for r in audits.supersession_findings(after).collect()}
    for k, i in enumerate(ids_):
        asked_for = any(i == e[1] for e in edges)
        want_now = ("resolved", "structural_repair" if i in fixed else "no_action") if k % 5 and i not in left and asked_for else ("open" if k % 5 else "dismissed", None)
        assert closed[i] == want_now


def test_the_latest_edge_of_a_cycle_is_rejected(spark):
    df = spark.createDataFrame([(i, "e", "p", "superseded", None) for i in "abc"], "statement_id string, subject_entity_id string, predicate_key string, status string, superseded_by_statement_id string")
    asked = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "a", 3)], "statement_id string, successor_id string, seq long")
    assert [r.outcome for r in repair.repairs(df, asked).orderBy("seq").collect()] == ["REPAIRED", "REJECTED", "REPAIRED"]


def test_merges_transfer_aliases(spark):
    """The old name leads to the survivor; what another active entity owns, or the survivor has, is not taken over."""
    entities = spark.createDataFrame([("a", "Old Name", "active", "b"), ("b", "New", "active", None), ("c", "Other", "active", None), ("d", "Lost", "deprecated", None), ("e", "Gone", "active", "d")], "entity_id string, canonical_name string, status string, merged_into_entity_id string")
    aliases = spark.createDataFrame([("a", "old  NAME", "supporting"), ("a", "Oldie", "supporting"), ("a", "shared", "authoritative"), ("c", "Shared", "supporting"), ("b", "oldie", "supporting"), ("a", "strong", "authoritative"), ("b", "Strong", "supporting")], "entity_id string, alias string, identity_strength string")
    roots = graph.survivors(entities)
    got = {(r.entity_id, r.norm): r.identity_strength for r in changes.merged_aliases(entities, aliases, roots).collect()}
    assert got == {("a", "old name"): "supporting", ("a", "oldie"): "supporting", ("a", "shared"): "authoritative", ("a", "strong"): "authoritative", ("c", "shared"): "supporting", ("b", "oldie"): "supporting", ("b", "strong"): "authoritative", ("b", "old name"): "authoritative"}
    assert {r.entity_id: (r.status, r.merged_into_entity_id) for r in changes.merged_entities(entities, roots).collect()} == {"a": ("merged", "b"), "b": ("active", None), "c": ("active", None), "d": ("deprecated", None), "e": ("merged", "d")}


@pytest.mark.parametrize("sliced, slices", [(2000, 512), (5, 7), (0, 64)])
def test_overlapping_pairs(spark, sliced, slices):
    """Every pair once, however a key is parted by time; open, equal and inverted bounds included."""
    import random

    rng, day = random.Random(6), lambda x: None if x is None else dt.datetime(2000, 1, 1) + dt.timedelta(days=x)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(30)]), rng.choice([None, *range(30)])) for i in range(160)]
    df = spark.createDataFrame([(i, k, day(x), day(y)) for i, k, x, y in rows], "statement_id int, k string, valid_from timestamp, valid_to timestamp")
    got = [(r.a.statement_id, r.b.statement_id) for r in facts.overlapping_pairs(df, ["k"], sliced=sliced, slices=slices).collect()]
    meet = lambda p, q: p is None or q is None or p <= q
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[1] and meet(a[2], b[3]) and meet(b[2], a[3])}
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)


def test_graph_evidence(spark):
    at = dt.datetime(2000, 1, 1)
    rows = [("a", "worksAt", "x", "s1", None, None), ("b", "worksAt", "x", "s2", None, None), ("a", "livesIn", "p", "s3", None, at), ("b", "livesIn", "q", "s4", at + dt.timedelta(1), None), ("b", "livesIn", "r", "s5", None, None), ("a", "knows", "z", "s6", None, None)]
    df = spark.createDataFrame(rows, "entity_id string, predicate_key string, neighbour_id string, statement_id string, valid_from timestamp, valid_to timestamp")
    got = {(r.a, r.signal, r.neighbour_id, tuple(r.statements)) for r in identity.graph_evidence(spark.createDataFrame([("a", "b")], "a string, b string"), df).collect()}
    clash = {(e, n, s) for e, n, s in (("a", "p", ("s3", "s4")), ("a", "p", ("s3", "s5")), ("b", "q", ("s3", "s4")), ("b", "r", ("s3", "s5")))}
    assert got == {("a", "shared_neighbor", "x", ("s1", "s2")), ("b", "shared_neighbor", "x", ("s1", "s2"))} | {(e, "conflicting_neighbor", n, s) for e, n, s in clash} | {(e, "temporal_conflict", n, s) for e, n, s in clash if "s5" in s}


def test_answers_to_clarifications(spark):
    """One answer counts; a choice that isn't active any more is checked again."""
    at = lambda minute: dt.datetime(2000, 1, 1, 0, minute)
    made = clarifications.issue(
        spark.createDataFrame([(i, at(0)) for i in range(4)], "request_id int, created_at timestamp"),
        spark.createDataFrame([(i, e) for i in range(4) for e in ("a", "b", "c")[: 2 if i == 1 else 3]], "request_id int, entity_id string"),
        spark.createDataFrame([(i, "AMBIGUOUS" if i < 3 else "MATCH") for i in range(4)], "request_id int, outcome string"),
    )
    history = spark.createDataFrame([(e, "active", at(0)) for e in "abc"] + [("a", "merged", at(10))], "entity_id string, status string, changed_at timestamp")
    asked = [(1, 0, "chosen_entity", "z", 1), (2, 0, "chosen_entity", "a", 9), (3, 0, "reject", None, 10), (4, 1, "chosen_entity", "a", 10), (5, 1, "create_new", None, 11), (6, 2, "chosen_entity", "a", 12), (7, 2, "reject", None, 13), (8, 3, "reject", None, 1), (9, 2, "reject", None, 40)]
    answers = spark.createDataFrame([(i, f"clarify:{c}", r, e, at(m)) for i, c, r, e, m in asked], "answer_id int, clarification_id string, resolution string, chosen_entity_id string, answered_at timestamp")
    told, new = clarifications.answered(made, answers, history)
    assert [r.outcome for r in told.orderBy("answer_id").collect()] == ["INVALID", "CHOSEN", "ALREADY_RESOLVED", "RERUN", "ALREADY_RESOLVED", "SUPERSEDED", "ALREADY_SUPERSEDED", "NOT_FOUND", "EXPIRED"]
    assert [(r.clarification_id, r.candidates, r.supersedes_id) for r in new.collect()] == [("clarify:2+", ["b", "c"], "clarify:2")]
    got = {r.clarification_id: r.state for r in clarifications.states(made.union(new), told, str(at(50))).collect()}
    assert got == {"clarify:0": "resolved", "clarify:1": "resolved", "clarify:2": "superseded", "clarify:2+": "expired"}
    assert clarifications.states(made, told, "2000-02-01").collect() == []


@pytest.mark.parametrize("rows", [100_000, 0])
def test_passages(spark, monkeypatch, rows):
    """Wherever a query stands in a text, cut words at its ends and short queries included."""
    import random

    monkeypatch.setattr(content, "ASKED_ROWS", rows)
    rng = random.Random(4)
    words = ["red", "Plate", "of", "the", "Ring", "x_y", "100%"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 15)))) for i in range(120)] + [(200, None), (201, ""), (202, "the  RED\nplate of")]
    queries = [(1, "red plate of"), (2, "ed plate of the r"), (3, "ring"), (4, "e r"), (5, "  "), (6, None), (7, "unknown word here"), (8, "RED PLATE"), (9, "of the ring of"), (10, "of the ring of"), (11, "%")]
    got = {(r.query_id, r.text_id, r["at"]) for r in content.passages(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(queries, "query_id int, query string")).collect()}
    want = {(q, i, t.lower().find(s.lower()) + 1) for q, s in queries if s and s.strip() for i, t in texts if t and s.lower() in t.lower()}
    assert got == want, (got - want, want - got)
    assert {q for q, _, _ in want} >= {1, 3, 4, 8, 11}


def test_candidates_of_many_requests_alike(spark):
    names = [(f"e{k}", ("alba", "alba costa", "mar")[k % 3], ("canonical", "authoritative")[k % 2]) for k in range(90)] + [("e0", "alba costa", "authoritative")]
    asks = [(k, ("Alba", " alba  COSTA", "none")[k % 3]) for k in range(2500)] + [(0, "mar"), (0, "Mar"), (9001, None), (9002, "")]
    named, asked = spark.createDataFrame(names, "entity_id string, norm string, strength string"), spark.createDataFrame(asks, "request_id int, name string")
    want, near = {}, set()
    for r, x in asks:
        for e, y, s in names:
            norm = " ".join((x or "").lower().split())
            if x is not None and norm == y:
                want[r, e] = min(s, want.get((r, e), s))
            if norm and (y.startswith(norm + " ") or norm.startswith(y + " ")):
                near.add((r, e))
    found = identity.by_name(asked, named)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and {(r, e): s for r, e, s in rows} == want
    rows = [tuple(r) for r in identity.near_names(asked, named).collect()]
    assert len(rows) == len(near) and set(rows) == near
    # Rows that are multiplied go nowhere any more.
    for df in (found, identity.near_names(asked, named)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.find("Generate explode(_ids") < plan.find("Exchange")


def test_references_of_many_requests_alike(spark):
    refs = [(f"e{k}", "erp", f"x{k % 7}") for k in range(40)] + [("e1", "crm", "y"), ("e1", None, "x1")]
    asks = [(k, "erp", f"x{k % 9}") for k in range(300)] + [(1, "crm", "y"), (2, None, "x1"), (3, "erp", None)]
    got = identity.by_reference(spark.createDataFrame(asks, "request_id int, source_system string, external_id string"), spark.createDataFrame(refs, "entity_id string, source_system string, external_id string"))
    rows = [tuple(r) for r in got.collect()]
    want = {(r, e) for r, *x in asks for e, *y in refs if x == y and None not in x}
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate explode(_ids") < plan.find("Exchange")


def test_all_members_of_a_group_are_compared(spark):
    members = spark.createDataFrame([(1, f"o{k}", k) for k in (9, 10, 11, 12)] + [(2, "o13", 13)], "group_id int, entity_id string, rank int")
    held = spark.createDataFrame([("o9", "p", "x"), ("o12", "p", "x"), ("o12", "p", "x"), ("o10", "p", "y"), ("o11", "q", "y"), ("o13", "p", "x")], "entity_id string, predicate_key string, neighbour_id string")
    assert [tuple(r) for r in identity.shared_neighbours(members, held).collect()] == [("o9", "o12", "p", "x")]


def test_appended_documents_are_cut_once(spark, sf_dir, monkeypatch):
    """A cut that comes out otherwise each time it is worked out, as an approximate one may."""
    import random

    from factgraph.plans import last

    want = {tuple(r) for r in last.a10_appended_revisions(spark, sf_dir).collect()}
    any_id = F.udf(lambda x: random.randrange(200), "long")
    monkeypatch.setattr(last.F, "percentile_approx", lambda c, share: F.first(any_id(c)))
    assert {tuple(r) for r in last.a10_appended_revisions(spark, sf_dir).collect()} == want


def _after(plan: str, name: str, above: str) -> bool:
    """Whether a plan has the node above all shuffles."""
    return 0 <= plan.find(above) < plan.find(name)


def test_related_rows_are_not_shuffled_once_multiplied(spark):
    at = dt.datetime(2020, 1, 1)
    rows = [(f"s{k}", f"e{k % 3}", at + dt.timedelta(days=k // 2), ("asserted", "retracted")[k % 5 == 0]) for k in range(40)]
    df = facts.related(spark.createDataFrame(rows, "statement_id string, subject_entity_id string, asserted_at timestamp, status string"), 4)
    want = set()
    for s, e, _, _ in rows:
        best = sorted(((t, r) for r, o, t, status in rows if o == e and r != s and status == "asserted"), reverse=True)[:4]
        want |= {(s, r, k) for k, (_, r) in enumerate(best, 1)}
    assert {tuple(r) for r in df.collect()} == want
    assert _after(df._jdf.queryExecution().executedPlan().toString(), "Exchange", "Generate posexplode")


def test_statements_without_successor_meet_nothing(spark):
    rows = [("a", None), ("b", "x"), ("c", "d"), ("d", None)]
    facts_ = spark.createDataFrame([(s, "e", "p", "superseded", n) for s, n in rows], "statement_id string, subject_entity_id string, predicate_key string, status string, superseded_by_statement_id string")
    found = audits.supersession_findings(facts_)
    assert sorted((r.statement_id, r.note) for r in found.collect()) == [("a", "missing_successor"), ("b", "dangling_successor"), ("d", "missing_successor")]
    assert "isnotnull(superseded_by_statement_id" in found._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter")[1]


def test_few_classes_are_not_shuffled_by(spark):
    """Rows are dealt by their entities, never by one of a few predicates or classes."""
    types = spark.createDataFrame([(f"e{k}", ("A", "B", None)[k % 3]) for k in range(9)], "entity_id string, class_key string").join(spark.range(1).select(F.lit(1)))
    closed = spark.createDataFrame([("A", "A"), ("B", "B"), ("B", "T")], "node string, ancestor string")
    allowed = spark.createDataFrame([("p", "T"), ("q", "A"), ("q", "T")], "predicate_key string, class_key string")
    said = spark.createDataFrame([(f"{p}{k}", p, f"e{k}") for p in "pqr" for k in range(9)] + [("p-", "p", None)], "statement_id string, predicate_key string, subject_entity_id string")
    df = audits.class_violations(said, types, closed, allowed, "subject_entity_id")
    assert {r.statement_id for r in df.collect()} == {f"p{k}" for k in range(9) if k % 3 != 1} | {f"q{k}" for k in (2, 5, 8)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [predicate_key" not in plan and "SortMergeJoin [class_key" not in plan


def test_near_names_only_where_nothing_is_exact(spark, monkeypatch):
    """Decisions are those of all exact and near names; names are looked up as near ones only for what
    has no exact one, and only names with a first word that is asked for are kept."""
    from factgraph.operators import identity

    names = [("e1", "large ring", "canonical"), ("e2", "large ring brand#7", "supporting"), ("e3", "large bolt", "canonical"), ("e4", "order#1", "canonical"), ("e5", "large", "authoritative"), ("e6", "", "canonical"), ("e7", "unknown", "canonical")]
    wanted = [("a", "large ring"), ("b", "large ring brand#9"), ("c", "unknown large ring"), ("d", "lar"), ("e", ""), ("f", "large ring brand#7")]
    named, asked = spark.createDataFrame(names, "entity_id string, norm string, strength string"), spark.createDataFrame(wanted, "request_id string, norm string")
    want = {tuple(r) for r in identity.decide(identity.exact_names(asked, named), identity.prefix_names(asked, named)).collect()}
    seen, near = [], identity.prefix_names

    def watched(asked, named):
        seen.append(({r.request_id for r in asked.collect()}, {r.entity_id for r in named.collect()}))
        return near(asked, named)

    monkeypatch.setattr(identity, "prefix_names", watched)
    assert {tuple(r) for r in identity.decided(asked, named).collect()} == want
    assert seen == [({"b", "c", "d"}, {"e1", "e2", "e3", "e5", "e6", "e7"})]


def test_rounds_grow_with_the_longest_way_not_with_the_rows(spark, monkeypatch):
    """Tops of cycles of many lengths, with ways into them, as walked one by one; many short ways take few rounds."""
    from factgraph.operators import graph

    nexts, seqs, at = {}, {}, 0
    for n in (1, 2, 3, 4, 6, 7, 12):
        for k in range(n):
            nexts[at + k] = at + (k + 1) % n
        for k in range(9):  # a way into the cycle
            nexts[at + n + k] = at + n + k + 1 if k < 8 else at
        at += n + 9
    for k in range(400):  # ways of two steps that end
        nexts[at + 3 * k], nexts[at + 3 * k + 1] = at + 3 * k + 1, at + 3 * k + 2
    seqs = {i: (i * 37) % 1009 if i % 3 else -1 for i in nexts}
    want = {}
    for i in nexts:
        way, j = [i], nexts[i]
        while j != i and j in nexts and len(way) <= 20:
            way.append(j)
            j = nexts[j]
        if j == i:
            want[i] = max(seqs[x] for x in way)
    rounds, keep = [], graph._checkpoint
    monkeypatch.setattr(graph, "_checkpoint", lambda df: rounds.append(1) or keep(df))
    got = graph.cycle_tops(spark.createDataFrame([(i, n, seqs[i]) for i, n in nexts.items()], "id long, next long, seq long")).collect()
    assert {r.id: r.top for r in got} == want and len(got) == len(want)
    assert len(rounds) <= 8


def test_merges_group_only_statements_near_them(spark):
    """Statements that no merge touches stay as they are, alike or not; a merge retracts what becomes alike."""
    from factgraph.operators import changes, graph

    entities = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None), ("e", "f"), ("f", "g"), ("g", "e")], "entity_id string, merged_into_entity_id string")
    rows = [("1", "a", "p", "d"), ("2", "c", "p", "d"), ("3", "d", "p", "b"), ("4", "d", "p", "a"), ("5", "d", "q", "d"), ("6", "d", "q", "d"), ("7", "e", "p", "d"), ("8", "b", "p", None)]
    fields = "statement_id string, subject_entity_id string, predicate_key string, object_entity_id string, status string, object_string string, object_number decimal(18,2), valid_from timestamp, valid_to timestamp"
    statements = spark.createDataFrame([(*r, "asserted", None, None, None, None) for r in rows] + [("9", "c", "p", "d", None, None, None, None, None)], fields)
    want = [("1", "a", "p", "d", "asserted"), ("2", "a", "p", "d", "retracted"), ("3", "d", "p", "a", "retracted"), ("4", "d", "p", "a", "asserted"), ("5", "d", "q", "d", "asserted"), ("6", "d", "q", "d", "asserted"), ("7", "e", "p", "d", "asserted"), ("8", "a", "p", None, "asserted"), ("9", "a", "p", "d", None)]
    for roots in (graph.merged(entities, 4), graph.survivors(entities, 4)):
        assert sorted(tuple(r) for r in changes.merged_statements(statements, roots).collect()) == want
    assert {r.entity_id: r.root for r in graph.survivors(entities, 4).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": None, "f": None, "g": None}
    assert sorted(r.entity_id for r in graph.merged(entities, 4).collect()) == ["b", "c", "e", "f", "g"]


def test_graph_evidence_of_entities_with_many_facts(spark, monkeypatch):
    """What is said of an entity is gathered in one row; of entities with too many facts for that it is
    joined, with the same signals, missing values and repeated facts included."""
    import random

    rng, at = random.Random(3), [None, *[dt.datetime(2001, m, 1) for m in range(1, 7)]]
    facts = [(f"e{rng.randrange(12)}", rng.choice(["p", "q", None]), rng.choice(["x", "y", "z", None]), f"s{i}", rng.choice(at), rng.choice(at)) for i in range(90)]
    facts += facts[:5]
    pairs = [(f"e{rng.randrange(13)}", f"e{rng.randrange(13)}") for _ in range(30)] + [("e1", None), ("e2", "e2")]
    make = spark.createDataFrame
    tables = make(pairs, "a string, b string"), make(facts, "entity_id string, predicate_key string, neighbour_id string, statement_id string, valid_from timestamp, valid_to timestamp")
    get = lambda: sorted(map(str, identity.graph_evidence(*tables).collect()))
    gathered = get()
    for most in (8, 0):
        monkeypatch.setattr(identity, "_GATHERED", most)
        assert get() == gathered and len(gathered) > 50
