"""Proposals: gates, their outcome, and policy over reviews."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappush, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions.text import is_class_key, normal
from factgraph.operators import set_join

Gate = Callable[[DataFrame, DataFrame], DataFrame]
#: Gates by name; each takes proposals and classes and returns (proposal_id, gate, decision).
GATES: dict[str, Gate] = {}


def register_gate(name: str) -> Callable[[Gate], Gate]:
    def add(gate: Gate) -> Gate:
        GATES[name] = gate
        return gate

    return add


@register_gate("key_shape")
def key_shape(proposals: DataFrame, classes: DataFrame) -> DataFrame:
    return proposals.select("proposal_id", F.lit("key_shape").alias("gate"), F.when(is_class_key(F.col("class_key")), "pass").otherwise("fail").alias("decision"))


@register_gate("existing_key")
def existing_key(proposals: DataFrame, classes: DataFrame) -> DataFrame:
    """A key that exists in another spelling is to be reused."""
    have = classes.select(normal(F.col("class_key")).alias("_k")).distinct()
    rows = proposals.join(have, normal(F.col("class_key")) == F.col("_k"), "left")
    return rows.select("proposal_id", F.lit("existing_key").alias("gate"), F.when(F.col("_k").isNotNull(), "reuse").otherwise("pass").alias("decision"))


@register_gate("structural")
def structural(proposals: DataFrame, classes: DataFrame) -> DataFrame:
    """The parent must exist; a class without parent is for a person to look at."""
    have = classes.select(F.col("class_key").alias("_p")).distinct()
    rows = proposals.join(have, F.col("parent_key") == F.col("_p"), "left")
    decision = F.when(F.col("parent_key").isNull(), "manual").when(F.col("_p").isNull() | (F.col("parent_key") == F.col("class_key")), "fail").otherwise("pass")
    return rows.select("proposal_id", F.lit("structural").alias("gate"), decision.alias("decision"))


def run_gates(proposals: DataFrame, classes: DataFrame) -> DataFrame:
    """All gates' results in one long table."""
    results = [gate(proposals, classes) for gate in GATES.values()]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def gate_outcomes(results: DataFrame) -> DataFrame:
    """Per proposal: rejected if a gate fails, else reuse, else manual_review, else ready; and the
    gates that did not pass."""
    n = lambda x: F.count_if(F.col("decision") == x) > 0
    outcome = F.when(n("fail"), "rejected").when(n("reuse"), "reuse").when(n("manual"), "manual_review").otherwise("ready")
    bad = F.array_join(F.sort_array(F.collect_list(F.when(F.col("decision") != "pass", F.col("gate")))), ",")
    return results.groupBy("proposal_id").agg(outcome.alias("outcome"), bad.alias("stopped_by"))


# Least confidence of an approval, and of a decision against a proposal; decisions
# against one; codes of the reasons why a person decides.
APPROVE_SURE, REJECT_SURE = 0.85, 0.85
AGAINST = ("reject", "reuse_existing", "uphold_rejection")
REASONS = {"context": "context_insufficient", "approve": "approve_below_threshold", "reject": "reject_below_threshold", "ask": "semantic_distinction_unclear"}


def review_policy(reviews: DataFrame, approve: float = APPROVE_SURE, reject: float = REJECT_SURE) -> DataFrame:
    """Reviews (model_decision, confidence) with effective_decision, policy_reason and challengeable.

    A person decides (manual_review) where the context was not sufficient, where confidence is below
    the threshold of its decision, or where existing concepts are related and either the proposal
    prefers to ask or its wording is vague. A challenge that is rejected again upholds the rejection.
    Columns that reviews may lack, and nulls in them: context_sufficient (true), related (none),
    description (empty), challenge and prefer_clarification (false). A null confidence is below any
    threshold.
    """
    has = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in reviews.columns else F.lit(default)
    decision, sure = F.col("model_decision"), F.coalesce(F.col("confidence").cast("double"), F.lit(-1.0))
    challenge, related = has("challenge", "boolean", False), F.size("related") > 0 if "related" in reviews.columns else F.lit(False)
    vague = is_vague(F.col("description")) if "description" in reviews.columns else F.lit(False)
    ask = ~challenge & related & ((has("prefer_clarification", "boolean", False) & decision.isin("approve", "reject", "reuse_existing")) | (decision.isin("reject", "reuse_existing") & F.coalesce(vague, F.lit(False))))
    reason = (
        F.when(~has("context_sufficient", "boolean", True), REASONS["context"]).when((decision == "approve") & (sure < approve), REASONS["approve"])
        .when(decision.isin(*AGAINST) & (sure < reject), REASONS["reject"]).when(ask, REASONS["ask"])
    )
    rows = reviews.withColumn("policy_reason", reason)
    final = F.when(F.col("policy_reason").isNotNull(), "manual_review").when(challenge & (decision == "reject"), "uphold_rejection").otherwise(decision)
    return rows.withColumn("effective_decision", final).withColumn("challengeable", F.col("effective_decision").isin(*AGAINST, "manual_review"))


def packed(candidates: DataFrame, group: str, tokens: str, budget: int, most: int) -> DataFrame:
    """Greedy packing of a group's candidates (candidate_id, tier) in order of tier (0 is pinned) and
    id, within a token budget and a count. A pinned one that does not fit is passed over; any other
    tier ends at its first miss. The first candidate always fits.

    Only candidates that can matter are gathered: of a tier that ends at a miss, the first most + 1;
    of the pinned ones, those before which fewer than ``most`` of at most their tokens stand (each
    of these would have been taken instead). Each partition leaves out its own others first.
    """
    rows = candidates.select(F.col(group).alias("_g"), "tier", "candidate_id", F.col(tokens).cast("long").alias("t"))
    place = F.row_number().over(Window.partitionBy("_g", "tier").orderBy("candidate_id"))
    others = rows.filter("tier <> 0").withColumn("_place", place).filter(F.col("_place") <= most + 1).drop("_place")

    def can_matter(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, least = None, []
        for part in parts:
            keep = []
            for key, t in zip(part["_g"], part["t"], strict=True):
                if key != last and not (pd.isna(key) and pd.isna(last)):
                    last, least = key, []
                # least: the smallest ones so far, the largest of them first.
                keep.append(len(least) < most or t < -least[0])
                if keep[-1]:
                    (heappush if len(least) < most else heapreplace)(least, -t)
            yield part[keep]

    pinned = rows.filter("tier = 0").sortWithinPartitions("_g", "candidate_id").mapInPandas(can_matter, rows.schema)
    items = F.sort_array(F.collect_list(F.struct("tier", "candidate_id", "t")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("closed"), F.array().cast("array<bigint>").alias("ids"))

    def step(s, x):
        fits = (s["used"] + x["t"] <= budget) | (F.size(s["ids"]) == 0)
        add = F.struct((s["used"] + x["t"]).alias("used"), s["closed"].alias("closed"), F.array_append(s["ids"], x["candidate_id"]).alias("ids"))
        close = F.struct(s["used"].alias("used"), x["tier"].cast("long").alias("closed"), s["ids"].alias("ids"))
        full = (F.size(s["ids"]) >= most) | (x["tier"] == s["closed"])
        return F.when(full, s).when(fits, add).when(x["tier"] == 0, s).otherwise(close)

    done = pinned.unionByName(others).groupBy("_g").agg(F.aggregate(items, start, step).alias("_"))
    return done.select(F.col("_g").alias(group), F.col("_.used").alias("used_tokens"), F.array_join(F.col("_.ids").cast("array<string>"), ",").alias("packed_ids"))


def context_hashes(rows: DataFrame, group: str, place: str, item: Column) -> DataFrame:
    """Per group: context_hash, the SHA-256 of its items in order of place. A context is what packing
    or a top-k left of a group, so it is short."""
    items = F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), item.cast("string").alias("item"))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.transform(items, lambda x: x["item"]), ";"), 256).alias("context_hash"))


# Reasons that challenge nothing, and wording that admits competing models.
TRIVIAL = ("please reconsider", "please reconsider.", "reconsider", "try again", "wrong", "i disagree")
VAGUE = ("some kind of", "some sort of", "kind of ability or", "or focus area", "related to agents", "related to an agent")
LEAST_REASON = 40


def is_substantive(reason: Column) -> Column:
    """Whether the reason of a challenge says something: 40 characters at least, blanks collapsed, and
    no stock phrase."""
    clean = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))
    return (F.length(clean) >= LEAST_REASON) & ~F.lower(clean).isin(*TRIVIAL)


def is_vague(description: Column) -> Column:
    """Whether a description admits models that are not equivalent."""
    return F.lower(F.coalesce(description, F.lit(""))).rlike("|".join(VAGUE))


def default_asks(related: DataFrame) -> DataFrame:
    """Per proposal of related (proposal_id, key, concept, place): asks, at most five questions to its
    author: two about each of its two nearest concepts, then what it stands for."""
    first = related.filter(F.col("concept").isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy("proposal_id").orderBy("place", "concept"))).filter("_k <= 2")
    pairs = first.groupBy("proposal_id").agg(F.sort_array(F.collect_list(F.struct("_k", "concept"))).alias("c"))
    keys = related.groupBy("proposal_id").agg(F.coalesce(F.min(F.when(F.col("key") != "", F.col("key"))), F.lit("the proposal")).alias("key"))
    differs = lambda x: F.array(
        F.format_string("Explain how %s differs from %s.", F.col("key"), x["concept"]),
        F.format_string("Provide an example assertion that should be valid for %s but not for %s.", F.col("key"), x["concept"]),
    )
    last = F.format_string("State whether %s represents an ability, a domain/category, a relation, or something else.", F.col("key"))
    rows = keys.join(pairs, "proposal_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<_k:int,concept:string>>")))
    return rows.select("proposal_id", F.slice(F.array_append(F.flatten(F.transform("c", differs)), last), 1, 5).alias("asks"))


# What proposals often model twice. Of each kind the first rule that holds counts: its
# name, folded keys, beginnings of keys, sets of phrases that the words must all have (one set
# suffices), and the concepts to look at first.
HINTS = {
    "predicate": (
        ("employment_path", ("employedby", "hasemployer", "hascurrentemployer", "employerof"), (), (("employed by",), ("current employer",)), ("holdsRole", "roleAt", "Person", "Role", "Organization", "Employment")),
        ("role_validity", ("currentrole", "hascurrentrole"), (), (("current role",),), ("holdsRole", "Role", "Agent", "Person")),
        ("usage_direction", ("usedby", "uses"), (), (), ("dependsOn", "deployedOn", "relatedTo", "System", "Agent")),
        ("negative_semantics", ("avoids", "avoid"), (), (), ("relatedTo", "Preference", "Constraint")),
        ("part_whole", ("partof", "haspart"), (), (), ("relatedTo", "dependsOn")),
    ),
    "class": (
        ("temporal_role", ("historicalrole", "formerrole", "pastrole"), (), (("historical", "role"),), ("Role", "holdsRole")),
        ("verified_qualifier", (), ("verified", "confirmed"), (("verified", "skill"),), ("Skill", "hasSkill")),
        ("confidence_qualifier", (), ("probable", "likely"), (("confidence", "goal"), ("confidence", "probable")), ("Goal", "hasGoal")),
        ("employment_class", ("employmentrelation", "employment"), (), (("ongoing employment",), ("employment relationship",)), ("Employment", "RelationshipContext", "Role", "holdsRole", "roleAt")),
        ("professional_skill", ("professionalskill",), (), (("professional", "skill", "role"),), ("Skill", "Role", "hasSkill")),
        ("core_leakage", (), (), (("personal", "goal"), ("only inside",), ("product experiment",), ("quantitative finance",), ("trading signal",)), ("Goal", "Observation", "Document")),
    ),
}


def modelling_hints(kind: Column, key: Column, label: Column, description: Column, owners: tuple[str, ...] = ()) -> Column:
    """Struct (hint, pins): the first modelling rule of HINTS that a proposal meets, and the concepts
    that its context starts with; null where none does. owners are names (in lower case) of persons
    whose own classes don't belong into the core: a class key that starts with one is a leakage."""
    empty = F.lit("")
    key, label, description = (F.coalesce(x, empty) for x in (key, label, description))
    folded, words = F.lower(key), F.lower(F.concat_ws(" ", key, label, description))
    out = F
    for name, rules in HINTS.items():
        for hint, keys, starts, phrases, pins in rules:
            met = folded.isin(*keys) if keys else F.lit(False)
            for x in (*starts, *(owners if hint == "core_leakage" else ())):
                met = met | folded.startswith(x)
            for some in phrases:
                met = met | F.forall(F.array(*map(F.lit, some)), lambda x: F.contains(words, x))
            out = out.when((kind == name) & met, F.struct(F.lit(hint).alias("hint"), F.array(*map(F.lit, pins)).alias("pins")))
    return out


def apply_classes(classes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Class revisions after accepted proposals (proposal_id, class_key, label, base_revision): a
    proposal made on another revision than the current one is stale; of several for one class the
    first applies. Returns proposal_id, outcome, revision."""
    now = classes.select("class_key", F.col("revision").alias("_now"))
    rows = accepted.join(now, "class_key", "left")
    current = F.coalesce("_now", F.lit(0))
    place = F.row_number().over(Window.partitionBy("class_key", F.col("base_revision") == current).orderBy("proposal_id"))
    fresh = (F.col("base_revision") == current) & (place == 1)
    return rows.select("proposal_id", F.when(fresh, "applied").otherwise("stale").alias("outcome"), F.when(fresh, current + 1).alias("revision"))


def review_lineage(reviews: DataFrame) -> DataFrame:
    """Each review with the one before it on the same proposal, and whether it changed the decision."""
    before = F.lag("decision").over(Window.partitionBy("proposal_id").orderBy("review_id"))
    return reviews.withColumn("previous_decision", before).withColumn("decision_changed", F.col("previous_decision").isNotNull() & (F.col("previous_decision") != F.col("decision")))


def lexical_nearest(proposals: DataFrame, concepts: DataFrame, most: int = 12, weak: float = 0.28, strong: float = 0.55) -> DataFrame:
    """The concepts (concept, tokens) whose tokens a proposal's (proposal_id, tokens) are most like by
    Jaccard similarity: at most ``most`` of at least ``weak``, in tier 1 from ``strong`` on, else 2.

    Only pairs that share one of their rarest tokens are looked at (see set_join); none is left out.
    """
    asked = proposals.select(F.col("proposal_id").alias("id"), F.col("tokens").alias("members"))
    known = concepts.select(F.col("concept").alias("id"), F.col("tokens").alias("members"))
    rows = set_join.similar(asked, known, weak).withColumnsRenamed({"a_id": "proposal_id", "b_id": "concept"})
    place = F.row_number().over(Window.partitionBy("proposal_id").orderBy(F.desc("score"), "concept"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).withColumn("tier", F.when(F.col("score") >= strong, 1).otherwise(2))


# Tiers of a review context (pinned come first), the root of all classes, scores of the
# ways in which a concept gets in, and limits between tiers.
PINNED, SUPPORTING, GENERIC, ROOT = 0, 1, 2, "Thing"
WAYS = {"exact": 1.0, "alias": 0.98, "pin": 0.99, "parent": 0.72, "root": 0.55}
STRONG_LEXICAL, STRONG_EMBEDDING, NEAR_SIBLING = 0.55, 0.75, 0.35


def review_candidates(proposals: DataFrame, concepts: DataFrame, aliases: DataFrame, links: DataFrame, near: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """Concepts that a reviewer of a proposal should see: proposal_id, concept, tier, score, reason; of
    several ways to one concept the one of the best tier, then score, then reason counts (a pin only
    where no other way is of the first tier).

    proposals: proposal_id, key, parent_keys and pins (arrays, may be null); concepts: concept; aliases:
    alias, concept; links: parent, child; near: proposal_id, concept, score (lexical); embedded:
    proposal_id, concept, score (cosine). The ways: the same key but for case and blanks, an alias,
    pins of modelling hints, wording, embedding, a proposed parent, and the parent's other children,
    by how near their wording is.
    """
    key, many = normal(F.coalesce("key", F.lit(""))), lambda c: F.coalesce(c, F.array().cast("array<string>"))
    asked = proposals.select("proposal_id", key.alias("_k")).filter("_k <> ''")
    way = lambda rows, tier, score, reason: rows.select("proposal_id", "concept", tier.alias("tier"), score.cast("double").alias("score"), F.lit(reason).alias("reason"))
    fixed = lambda rows, reason, tier=PINNED: way(rows, F.lit(tier), F.lit(WAYS[reason]), reason)
    found = [
        fixed(asked.join(concepts.select("concept", normal(F.col("concept")).alias("_k")), "_k"), "exact"),
        fixed(asked.join(aliases.select("concept", normal(F.col("alias")).alias("_k")), "_k"), "alias"),
        fixed(proposals.select("proposal_id", F.explode(many("pins")).alias("concept")).join(concepts.select("concept"), "concept", "left_semi"), "pin"),
        way(near, F.when(F.col("score") >= STRONG_LEXICAL, PINNED).otherwise(SUPPORTING), F.col("score"), "lexical"),
    ]
    if embedded is not None:
        found.append(way(embedded, F.when(F.col("score") >= STRONG_EMBEDDING, PINNED).otherwise(SUPPORTING), 0.5 + 0.5 * F.col("score"), "embedding"))
    parents = proposals.select("proposal_id", "key", F.explode(many("parent_keys")).alias("concept")).join(concepts.select("concept"), "concept", "left_semi")
    found += [fixed(parents.filter(F.col("concept") != ROOT), "parent", SUPPORTING), fixed(parents.filter(F.col("concept") == ROOT), "root", GENERIC)]
    children = parents.join(links.select(F.col("parent").alias("concept"), "child"), "concept").filter(F.col("child") != F.coalesce("key", F.lit(""))).select("proposal_id", F.col("child").alias("concept")).distinct()
    prox = F.coalesce("_prox", F.lit(0.0))
    children = children.join(near.select("proposal_id", "concept", F.col("score").alias("_prox")), ["proposal_id", "concept"], "left")
    found.append(way(children, F.when(prox >= NEAR_SIBLING, SUPPORTING).otherwise(GENERIC), 0.45 + 0.45 * prox, "sibling"))
    best = F.min(F.struct("tier", (F.col("reason") == "pin").alias("p"), (-F.col("score")).alias("s"), "reason")).alias("_")
    rows = reduce(DataFrame.unionByName, found).groupBy("proposal_id", "concept").agg(best)
    return rows.select("proposal_id", "concept", F.col("_.tier").alias("tier"), F.round(-F.col("_.s"), 6).alias("score"), F.col("_.reason").alias("reason"))


def superseded_asks(asks: DataFrame) -> DataFrame:
    """asks (proposal_id, ask_id, status): of a proposal's open ones the newest stays open, the others
    are superseded; closed ones stay as they are."""
    open_ = F.col("status") == "open"
    newest = F.max(F.when(open_, F.col("ask_id"))).over(Window.partitionBy("proposal_id"))
    return asks.withColumn("status", F.when(open_ & (F.col("ask_id") < newest), "superseded").otherwise(F.col("status")))
