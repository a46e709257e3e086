"""Toxicity scores by a counterfactual-regularised classifier.

A logistic regression on which words a text has (whole words and beginnings of longer ones). Each
sentence of a labelled text that names a group is written again with every other name of the same
kind in its place, and with a word that names none; training penalises the squared difference of the two sentences' scores (before
the logistic function), so that a group's name by itself says little, however often labelled toxic
texts mention it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import checkpoint, text_of
from factgraph.session import share_package

#: Kinds of identity terms; a term is swapped for the others of its line and for NEUTRAL. (With other
#: groups' names alone, all of them could become equally toxic.)
NEUTRAL = "people"
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("africans", "europeans", "asians", "americans"), ("african", "european", "american"),
    ("immigrants", "locals"), ("old", "young"), ("disabled", "able"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "habitants"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "vecinos"),
)
#: Labelled rows that are learned from (about so many of each label are chosen by hash, all if
#: fewer; the rest weigh in by the labels' true shares), and features that are weighed.
ROWS, FEATURES = 10000, 2048
#: Least labelled rows with a feature, least standard errors by which its share of toxic ones must
#: stand out, ridge penalty, weight of the counterfactual penalty, steps of gradient descent.
SUPPORT, STANDS_OUT, RIDGE, COUNTERFACTUAL, STEPS = 4, 4.0, 2e-4, 1.0, 600
#: Lengths of beginnings; longest word that counts as a whole.
STARTS, LONGEST = (3, 4, 5, 6), 64
#: Words whose features a worker keeps.
KEPT = 500_000

WORDS, SENTENCES = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")
SWAPS = {term: (NEUTRAL, *(x for x in kind if x != term)) for kind in IDENTITIES for term in kind}


def word_features(word: str) -> list[int]:
    """Hashes of a lower-cased word and its beginnings."""
    whole = [xxhash.xxh64_intdigest(f"={word[:LONGEST]}") >> 1]
    return whole + [xxhash.xxh64_intdigest(f"^{word[:k]}") >> 1 for k in STARTS if len(word) > k]


def text_features(text: str) -> set[int]:
    return {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}


def counterfactuals(text: str) -> set[tuple[tuple[int, ...], tuple[int, ...]]]:
    """What each swap in each sentence takes from the sentence's features and adds to them, sorted."""
    out = set()
    for sentence in set(SENTENCES.findall(text.lower())):
        words = WORDS.findall(sentence)
        named = {w for w in words if w in SWAPS}
        for term in named:
            before = {f for w in set(words) for f in word_features(w)}
            for other in SWAPS[term]:
                after = {f for w in {other if w == term else w for w in words} for f in word_features(w)}
                out.add((tuple(sorted(before - after)), tuple(sorted(after - before))))
    return {x for x in out if x[0] or x[1]}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


class ToxicityModel:
    """features (rising hashes), their weights, and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    @classmethod
    def fit(cls, features: list[int], rows: list[list[int]], labels: list[int], row_weights: list[float], swaps: list[tuple[list[int], list[int], int]], penalty: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = STEPS) -> ToxicityModel:
        """rows: places of each row's features; swaps: places that a swap takes and adds, and how often it stands.

        Accelerated gradient descent on the weighted mean logistic loss, the ridge penalty and
        ``penalty`` times the mean squared change of score over the swaps.
        """
        size = len(features) + 1  # the last is the bias
        goal, share = np.array(labels, np.float64), np.array(row_weights, np.float64)
        share = share / share.sum()

        def matrix(lists: list[list[int]], signs: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            counts = [len(x) for x in lists]
            return np.repeat(np.arange(len(lists)), counts), np.array([c for x in lists for c in x], np.int64), np.array([v for x in signs for v in x], np.float64)

        def product(m, w, n):
            return np.bincount(m[0], m[2] * w[m[1]], n)

        def back(m, x):
            return np.bincount(m[1], m[2] * x[m[0]], size)

        full = [[*r, size - 1] for r in rows]
        data = matrix(full, [[1.0] * len(r) for r in full])
        pairs = matrix([[*a, *b] for a, b, _ in swaps], [[-1.0] * len(a) + [1.0] * len(b) for a, b, _ in swaps])
        often = np.array([n for _, _, n in swaps], np.float64)
        often = often / often.sum() if len(often) else often

        def slope(w: np.ndarray) -> np.ndarray:
            g = back(data, share * (sigmoid(product(data, w, len(rows))) - goal)) + ridge * np.r_[w[:-1], 0.0]
            return g + 2 * penalty * back(pairs, often * product(pairs, w, len(swaps))) if len(swaps) else g

        # The largest curvature, by power iteration on the quadratic that bounds the loss.
        v = np.ones(size)
        top = 1.0
        for _ in range(30):
            u = 0.25 * back(data, share * product(data, v, len(rows))) + ridge * v
            if len(swaps):
                u = u + 2 * penalty * back(pairs, often * product(pairs, v, len(swaps)))
            top = float(np.linalg.norm(u) / np.linalg.norm(v))
            v = u / np.linalg.norm(u)
        w = ahead = np.zeros(size)
        t = 1.0
        for _ in range(steps):
            new = ahead - slope(ahead) / (1.05 * top)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / after * (new - w)
            w, t = new, after
        return cls(np.array(features, np.int64), w[:-1], float(w[-1]))

    def scorer(self):
        """A function from texts to scores from 0 to 1. It keeps the features of words it has met, at
        most KEPT of them."""
        weight = {f: float(w) for f, w in zip(self.features.tolist(), self.weights, strict=True) if w}
        known: dict[str, tuple[int, ...]] = {}

        def score(texts: list[str]) -> np.ndarray:
            out = np.full(len(texts), self.bias)
            for i, text in enumerate(texts):
                found: set[int] = set()
                for word in set(WORDS.findall(text.lower())):
                    mine = known.get(word)
                    if mine is None:
                        mine = tuple(f for f in word_features(word) if f in weight)
                        if len(word) <= LONGEST:
                            if len(known) >= KEPT:
                                known.clear()
                            known[word] = mine
                    if mine:
                        found.update(mine)
                out[i] += sum(weight[f] for f in sorted(found))
            return sigmoid(out)

        return score


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 5, is 0; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS, penalty: float = COUNTERFACTUAL) -> ToxicityModel:
    """Learns from labelled documents outside the held-out fold.

    About ``rows`` labels of each kind are chosen by a hash of the id (the documented bound of the
    sample) and weighed so that kinds have their true shares; where ids repeat so often that their
    documents are over twice the bound, these are thinned by a hash of id and text. Only chosen
    labels meet the documents, by broadcast, so no text is shuffled. Features are found and counted
    on the executors; the driver gets at most FEATURES hashes, the sample's places among them, and
    the distinct swaps. Null labels are no labels; a label that stands twice counts once; without
    labelled rows every score is 0, with one kind of label only the score is its smoothed share.
    """
    share_package(docs.sparkSession)
    label_id = F.col(id_col)
    known = labels.filter(~held_out(label_id)).select(label_id.alias("label_id"), (F.col(label_col) > 0).cast("int").alias("label")).filter("label IS NOT NULL").distinct()
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        n = sum(sizes.values())
        p = (sizes.get(1, 0) + 1) / (n + 2) if n else 0.0
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))) if n else -np.inf)

    def share_of(key: Column) -> Column:
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)

    name = F.col("label_id").cast("string")
    limit = F.when(F.col("label") == 1, F.lit(rows / sizes[1])).otherwise(F.lit(rows / sizes[0]))
    chosen = F.broadcast(known.filter(share_of(F.concat(F.lit("toxic:"), name)) < limit))
    both = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(chosen, F.col("id") == F.col("label_id"))
    thin = 2 * rows / max(1, both.count())
    if thin < 1:
        both = both.filter(share_of(F.concat(F.lit("thin:"), name, F.lit(":"), F.md5("text"))) < thin)
    # Written once: the passes below read no more than the sample.
    sample = checkpoint(both.select("label", "text", F.md5(F.concat(name, F.lit(":"), F.md5("text"))).alias("key")))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                swaps = [{"less": list(a), "more": list(b)} for a, b in sorted(counterfactuals(text))]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1), batch.column(0).slice(i, 1), pa.array([sorted(text_features(text))], pa.list_(pa.int64())), pa.array([swaps], swap_type)], ["key", "label", "features", "swaps"])

    swap_type = pa.list_(pa.struct([("less", pa.list_(pa.int64())), ("more", pa.list_(pa.int64()))]))
    found = sample.mapInArrow(featured, "key string, label int, features array<bigint>, swaps array<struct<less:array<bigint>,more:array<bigint>>>")
    taken = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = sum(taken.values())
    base = taken.get(1, 0) / max(share, 1)
    seen = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).filter(F.col("n") >= SUPPORT)
    apart = (F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    best = seen.select("feature", F.abs(apart).alias("z")).filter(F.col("z") >= STANDS_OUT).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    features = sorted(r.feature for r in best)
    places = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = places.value
        for batch in batches:
            lists = [[of[f] for f in x if f in of] for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["key", "label", "places"])

    rows_of = sorted((r.key, r.label, r.places) for r in found.select("key", "label", "features").mapInArrow(placed, "key string, label int, places array<int>").collect())
    swaps = found.select(F.explode("swaps").alias("s")).groupBy("s.less", "s.more").agg(F.count("*").alias("n")).orderBy("less", "more").collect()
    of = places.value
    pairs = [([of[f] for f in r.less if f in of], [of[f] for f in r.more if f in of], r.n) for r in swaps]
    weight = {label: sizes[label] / max(taken.get(label, 0), 1) for label in sizes}
    return ToxicityModel.fit(features, [r[2] for r in rows_of], [r[1] for r in rows_of], [weight[r[1]] for r in rows_of], pairs, penalty)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    The whole text is scored and nothing else; null texts are empty, and an empty text has the score
    of a text without any feature. held_out is false for a null id; repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    share_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = ToxicityModel(*shared.value).scorer()
        for batch in batches:
            values = score(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
