"""Identity of entities and sources: exact and near matches, decisions, alias and source registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions.temporal import overlap
from factgraph.functions.text import normal, source_system_key
from factgraph.session import written


def names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """All normal names of active entities: entity_id, norm, strength (canonical, authoritative or supporting)."""
    active = entities.filter("status = 'active'")
    own = active.select("entity_id", normal(F.col("canonical_name")).alias("norm"), F.lit("canonical").alias("strength"))
    other = aliases.join(active.select("entity_id"), "entity_id").select("entity_id", normal(F.col("alias")).alias("norm"), F.col("identity_strength").alias("strength"))
    return own.union(other)


#: Requests alike that one row is spread over at once; parts that the candidates of requests alike are dealt into.
_TOGETHER, _SLOTS = 1000, 64
#: First words of names asked for that are broadcast; more are shuffled.
_BROADCAST = 100_000


def alike(requests: DataFrame, *also: str) -> DataFrame:
    """request_id, alike, norms and the columns ``also`` of requests (request_id, name) that have a name.

    Requests with the same normal names (and the same values of ``also``) have one ``alike``. They have
    the same candidates, so these are looked for once and spread over the requests at the end.
    """
    rows = requests.select("request_id", *also, normal(F.col("name")).alias("norm")).filter("norm IS NOT NULL")
    rows = rows.groupBy("request_id", *also).agg(F.sort_array(F.collect_set("norm")).alias("norms"))
    # A normal name holds no line feed.
    key = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in also], "norms")
    return rows.select("request_id", key.alias("alike"), "norms", *also)


def asked_names(members: DataFrame) -> DataFrame:
    """request_id (an ``alike`` of members) and norm: what is asked for, once for all requests alike."""
    return members.groupBy("alike").agg(F.first("norms").alias("norms")).select(F.col("alike").alias("request_id"), F.explode("norms").alias("norm"))


def spread(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows, whose request_id is an ``alike`` of members (request_id, alike), once for each of its requests.

    No row is shuffled after it is multiplied. Requests stand in lists of about _TOGETHER, and the
    candidates of many requests alike are dealt into slots, so neither many requests of one name nor
    many candidates of one end up in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("alike").agg(F.count("*").alias("_n"))
    slots, lists = F.least(F.col("_n"), F.lit(_SLOTS)).cast("int"), F.ceil(F.col("_n") / _TOGETHER)
    held = members.select("request_id", "alike").join(sizes, "alike").groupBy("alike", slots.alias("_slots"), F.pmod(F.xxhash64("request_id"), lists).alias("_list")).agg(F.collect_list("request_id").alias("_ids"))
    held = held.select(F.col("alike").alias("_alike"), F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)).alias("_of"), "_ids")
    names = [c for c in rows.columns if c != "request_id"]
    dealt = rows.join(sizes.withColumnRenamed("alike", "request_id"), "request_id").withColumn("_slot", F.pmod(F.xxhash64(*names), slots).cast("int"))
    dealt = dealt.select("request_id", "_slot", *names).repartition(parts, "request_id", "_slot")
    both = dealt.join(held, (F.col("request_id") == F.col("_alike")) & (F.col("_slot") == F.col("_of")))
    return both.select(F.explode("_ids").alias("_id"), *rows.columns).select(*[F.col("_id").alias(c) if c == "request_id" else c for c in rows.columns])


def exact_names(asked: DataFrame, named: DataFrame) -> DataFrame:
    """request_id, entity_id, strength of what is asked for (request_id, norm) and is an entity's name:
    the strongest of an entity's matches (authoritative, canonical, supporting)."""
    return asked.join(named, "norm").groupBy("request_id", "entity_id").agg(F.min("strength").alias("strength"))


def by_name(requests: DataFrame, named: DataFrame) -> DataFrame:
    """Requests (request_id, name) that meet a name exactly: request_id, entity_id, strength, the
    strongest of an entity's matches (authoritative, canonical, supporting)."""
    members = alike(requests)
    return spread(exact_names(asked_names(members), named), members)


def prefix_names(asked: DataFrame, named: DataFrame) -> DataFrame:
    """request_id, entity_id of what is asked for (request_id, norm) and is a proper prefix, in whole
    words, of an entity's name, or the other way round. Each side's prefixes are joined to the
    other's whole names."""

    def prefixes(norm: Column) -> Column:
        words = F.split(norm, " ")
        return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, 1, k), " "))).otherwise(F.array().cast("array<string>"))

    asked = asked.filter("norm <> ''")
    have = named.select("entity_id", "norm")
    shorter = asked.select("request_id", F.explode(prefixes(F.col("norm"))).alias("norm")).join(have, "norm")
    longer = have.select("entity_id", F.explode(prefixes(F.col("norm"))).alias("norm")).join(asked, "norm")
    return shorter.select("request_id", "entity_id").union(longer.select("request_id", "entity_id")).distinct()


def near_names(requests: DataFrame, named: DataFrame) -> DataFrame:
    """Requests whose name is a proper prefix, in whole words, of an entity's name, or the other way
    round: request_id, entity_id."""
    members = alike(requests)
    return spread(prefix_names(asked_names(members), named), members)


def by_reference(requests: DataFrame, references: DataFrame) -> DataFrame:
    """Requests that give an entity's (source_system, external_id). Requests with the same references
    are looked up once."""
    pair = F.struct("source_system", "external_id")
    given = requests.filter("source_system IS NOT NULL AND external_id IS NOT NULL").groupBy("request_id").agg(F.sort_array(F.collect_set(pair)).alias("given"))
    members = given.select("request_id", F.to_json("given").alias("alike"), "given")
    asked = members.groupBy("alike").agg(F.first("given").alias("given")).select(F.col("alike").alias("request_id"), F.inline("given"))
    return spread(asked.join(references, ["source_system", "external_id"]).select("request_id", "entity_id").distinct(), members)


def decide(exact: DataFrame, near: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    """request_id, entity_id, reasons, decision. A reference or an authoritative alias is the SAME; a
    canonical name or supporting alias is UNCERTAIN; a near name too, where nothing is exact."""
    found = exact.select("request_id", "entity_id", F.col("strength").alias("reason"))
    if referenced is not None:
        found = found.union(referenced.select("request_id", "entity_id", F.lit("reference")))
    near = near.join(found.select("request_id").distinct(), "request_id", "left_anti").select("request_id", "entity_id", F.lit("near_name").alias("reason"))
    merged = found.union(near).groupBy("request_id", "entity_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "+").alias("reasons"))
    return merged.withColumn("decision", F.when(F.col("reasons").rlike("authoritative|reference"), "SAME").otherwise("UNCERTAIN"))


def decided(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Decisions on what is asked for (request_id, norm) by exact and near names. Near names, which are
    many, are looked for only where nothing is exact. Names are read once: those that begin with a
    word that something asked for begins with are written, as no others can match."""
    word = F.substring_index("norm", " ", 1).alias("_word")
    begins = written(asked.select(word).distinct(), "first-words")
    begins = F.broadcast(begins) if begins.count() <= _BROADCAST else begins
    named = written(named.select("entity_id", "norm", "strength", word).join(begins, "_word", "left_semi").drop("_word"), "names")
    exact = exact_names(asked, named)
    met = asked.join(named.select("norm"), "norm", "left_semi").select("request_id").distinct()
    return decide(exact, prefix_names(asked.join(met, "request_id", "left_anti"), named))


def adjudicated(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates in which an outside decision replaces UNCERTAIN, and nothing else."""
    told = decisions.select("request_id", "entity_id", F.col("decision").alias("_told"))
    rows = candidates.join(told, ["request_id", "entity_id"], "left")
    return rows.withColumn("decision", F.when(F.col("decision") == "UNCERTAIN", F.coalesce("_told", "decision")).otherwise(F.col("decision"))).drop("_told")


def owned_elsewhere(aliases: DataFrame, named: DataFrame) -> DataFrame:
    """Aliases whose normal form is a name of another active entity."""
    a = aliases.select("entity_id", "alias", normal(F.col("alias")).alias("norm"))
    b = named.select(F.col("entity_id").alias("other"), "norm")
    return a.join(b, (a.norm == b.norm) & (a.entity_id != b.other), "left_semi").select("entity_id", "alias")


def strongest_aliases(aliases: DataFrame) -> DataFrame:
    """One row per entity and normal alias: authoritative if any of its rows is."""
    return aliases.groupBy("entity_id", normal(F.col("alias")).alias("norm")).agg(F.min("identity_strength").alias("identity_strength"))


#: Facts of an entity that are gathered in one row; those of entities with more are joined.
_GATHERED = 1000


def graph_evidence(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Signals of candidates (a, b) from facts (entity_id, predicate_key, neighbour_id, statement_id,
    valid_from, valid_to): a, b, signal, predicate_key, neighbour_id, statements, each evidence once.

    Both candidates of a pair are looked at from the other's side. For each fact of a, by the same
    predicate: shared_neighbor if b has that neighbour too; else, for each of b's neighbours,
    conflicting_neighbor, and temporal_conflict if both hold at one time. statements are the ids it
    rests on, sorted. What is said of one entity by many statements meets only the statements of its
    candidates, never each other. facts are read more than once, so they should be cheap.
    """
    once = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    large = written(facts.groupBy("entity_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > _GATHERED).select("entity_id"), "large-entities")
    if large.isEmpty():
        return _evidence_gathered(once, facts)
    once = written(once, "pairs")
    hit = written(reduce(DataFrame.union, [once.join(large, F.col(x) == F.col("entity_id"), "left_semi") for x in ("a", "b")]).distinct(), "large-pairs")
    rest = once.join(hit, ["a", "b"], "left_anti")
    return _evidence_gathered(rest, facts.join(large, "entity_id", "left_anti")).unionByName(_evidence_joined(hit, facts))


def _evidence_gathered(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """graph_evidence of pairs (each once, in one direction): what is said of an entity is gathered in
    one row, so that facts are dealt out once, and a pair's signals are found in its row."""
    fact = F.struct(F.col("predicate_key").alias("p"), F.col("neighbour_id").alias("n"), F.col("statement_id").alias("s"), F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))
    held = facts.filter("predicate_key IS NOT NULL").groupBy("entity_id").agg(F.collect_list(fact).alias("held"))
    side = lambda x: held.select(F.col("entity_id").alias(x), F.col("held").alias(f"_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def signals(a: str, b: str) -> Column:
        mine, theirs = F.col(f"_{a}"), F.col(f"_{b}")
        out = lambda signal, x, ids: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(signal).alias("signal"), x["p"].alias("predicate_key"), x["n"].alias("neighbour_id"), F.sort_array(ids).alias("statements"))
        same = lambda x, y: (x["p"] == y["p"]) & F.coalesce(x["n"] == y["n"], F.lit(False))
        ids = lambda x, of: F.transform(F.filter(of, lambda y: same(x, y)), lambda y: y["s"])
        known = lambda x: F.exists(theirs, lambda y: same(x, y))
        shared = F.transform(F.filter(mine, known), lambda x: out("shared_neighbor", x, F.array_distinct(F.array_compact(F.concat(ids(x, mine), ids(x, theirs))))))
        apart = F.filter(mine, lambda x: ~known(x))
        others = lambda x: F.filter(theirs, lambda y: x["p"] == y["p"])
        conflicts = F.flatten(F.transform(apart, lambda x: F.transform(others(x), lambda y: out("conflicting_neighbor", x, F.array(x["s"], y["s"])))))
        at_once = lambda x, y: overlap(x["f"], x["t"], y["f"], y["t"])
        temporal = F.flatten(F.transform(apart, lambda x: F.transform(F.filter(others(x), lambda y: at_once(x, y)), lambda y: out("temporal_conflict", x, F.array(x["s"], y["s"])))))
        return F.concat(shared, conflicts, temporal)

    return rows.select(F.inline(F.array_distinct(F.concat(signals("a", "b"), signals("b", "a")))))


def _evidence_joined(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """As _evidence_gathered, by joins, however much is said of an entity."""
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    side = lambda x: facts.select(F.col("entity_id").alias(x), "predicate_key", F.col("neighbour_id").alias(f"{x}_n"), F.col("statement_id").alias(f"{x}_s"), F.col("valid_from").alias(f"{x}_from"), F.col("valid_to").alias(f"{x}_to"))
    mine, peers = both.join(side("a"), "a"), side("b")
    same = peers.select("b", "predicate_key", F.col("b_n").alias("a_n"), "b_s")
    key = ["a", "b", "predicate_key", "a_n"]
    shared = mine.join(same, ["b", "predicate_key", "a_n"])
    refs = F.sort_array(F.array_distinct(F.concat(F.collect_set("a_s"), F.collect_set("b_s"))))
    shared = shared.groupBy(*key).agg(refs.alias("statements")).select("a", "b", F.lit("shared_neighbor").alias("signal"), "predicate_key", F.col("a_n").alias("neighbour_id"), "statements")
    apart = mine.join(same.select("b", "predicate_key", "a_n").distinct(), ["b", "predicate_key", "a_n"], "left_anti").join(peers, ["b", "predicate_key"])
    at_once = overlap(F.col("a_from"), F.col("a_to"), F.col("b_from"), F.col("b_to"))
    signals = F.array_compact(F.array(F.lit("conflicting_neighbor"), F.when(at_once, "temporal_conflict")))
    other = apart.select("a", "b", F.explode(signals).alias("signal"), "predicate_key", F.col("a_n").alias("neighbour_id"), F.sort_array(F.array("a_s", "b_s")).alias("statements"))
    return shared.union(other.distinct())


def shared_neighbours(members: DataFrame, facts: DataFrame) -> DataFrame:
    """a, b, predicate_key, neighbour_id: what every two members of a group (group_id, entity_id, rank)
    share, a being the one of smaller rank, each once. facts: entity_id, predicate_key, neighbour_id.

    Members meet where they share something only, so pairs that share nothing are never made.
    """
    held = facts.select("entity_id", "predicate_key", "neighbour_id").distinct().join(members.select("group_id", "entity_id", "rank").distinct(), "entity_id")
    side = lambda x: held.select("group_id", "predicate_key", "neighbour_id", F.col("entity_id").alias(x), F.col("rank").alias(f"_{x}"))
    both = side("a").join(side("b"), ["group_id", "predicate_key", "neighbour_id"]).filter(F.col("_a") < F.col("_b"))
    return both.select("a", "b", "predicate_key", "neighbour_id").distinct()


def canonical_systems(sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """sources with canonical_system: the registered key of the system's normal form, else that form."""
    key = source_system_key(F.col("source_system"))
    registry = aliases.select(F.col("normalized_alias").alias("_alias"), "canonical_key")
    rows = sources.withColumn("_key", key).join(registry, F.col("_key") == F.col("_alias"), "left")
    return rows.withColumn("canonical_system", F.coalesce("canonical_key", "_key")).drop("_key", "_alias", "canonical_key")


def source_matches(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Per request: MATCH, NO_MATCH or AMBIGUOUS by the number of sources with its (canonical_system,
    external_id); and the source that matches."""
    groups = sources.filter("external_id IS NOT NULL AND canonical_system IS NOT NULL").groupBy("canonical_system", "external_id").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))
    rows = requests.join(groups, ["canonical_system", "external_id"], "left")
    outcome = F.when(F.col("n").isNull(), "NO_MATCH").when(F.col("n") == 1, "MATCH").otherwise("AMBIGUOUS")
    return rows.select("request_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("source_id")).alias("source_id"))


def resolve_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """request_id, outcome, source_id of requests (request_id, canonical_system, external_id,
    content_hash) against sources with the same columns and source_id.

    The identity decides first: MATCH, or AMBIGUOUS if several sources have it. Without a source of
    that identity (or an identity), the smallest source with the same content is a MATCH, else one is
    to be made: CREATE, with an id that its identity gives, or its content.
    """
    by_id = source_matches(requests, sources).select("request_id", F.col("outcome").alias("_by"), F.col("source_id").alias("_own"))
    content = sources.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("source_id").alias("_same"))
    rows = requests.join(by_id, "request_id").join(content, "content_hash", "left")
    made = F.concat(F.lit("new:"), F.coalesce(F.when(F.col("external_id").isNotNull(), F.sha2(F.concat_ws(":", "canonical_system", "external_id"), 256)), "content_hash"))
    outcome = F.when(F.col("_by") != "NO_MATCH", F.col("_by")).when(F.col("_same").isNotNull(), "MATCH").otherwise("CREATE")
    return rows.select("request_id", outcome.alias("outcome"), F.when(outcome == "CREATE", made).otherwise(F.coalesce("_own", F.when(outcome == "MATCH", F.col("_same")))).alias("source_id"))


def evidence_package(candidates: DataFrame, most: int) -> DataFrame:
    """The first candidates of each request by id, and how many are left out."""
    counts = candidates.groupBy("request_id").agg(F.count("*").alias("_n"))
    first = candidates.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("entity_id"))).filter(F.col("place") <= most)
    return first.join(counts, "request_id").withColumn("left_out", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")
