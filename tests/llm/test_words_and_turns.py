"""Toxicity, spelling variants and the conversation trie against plain re-computations, on given tables and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import conversation_trie, spelling_variants, toxicity

TURNS = [
    (10, None, "user", "first, by its null turn"), (10, 1, None, "ü null role"), (10, 2, "user", None), (10, 3, "assistant", "ok"), (10, 4, "user", "x" * 300000),
    (10, 5, "user", "tie a"), (10, 5, "user", "tie b"), (10, 5, "user", "tie b"), (11, 0, "user", "own"), (11, 9, "user", "own too"), (12, 0, "user", "own"), (13, 1, "", ""),
    (14, 0, "user", "own"), (None, 0, "user", "of no conversation"), (-3, 0, "user", "negative"), (0, 0, "user", "negative"), (21, 0, "user", "no base"), (22, 0, "user", "no base"),
    *[(1000 + 5 * i, 0, "user", "the same first turn") for i in range(40)], *[(1000 + 5 * i, 1, "user", f"reply {i % 3}") for i in range(40)],
    *[(5000, t, "user", f"turn {t % 7}") for t in range(300)],
]
SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((t is not None, t or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


@pytest.mark.parametrize("shards", [1, 5, 64])
@pytest.mark.parametrize("rows", ["table", "awkward", "empty", "no ids"])
def test_conversation_trie(spark, sf_dir, rows, shards):
    """Rows without a conv_id belong nowhere; without any there is no node."""
    given = {"awkward": TURNS, "empty": [], "no ids": [(None, 1, "user", "x")]}
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet") if rows == "table" else spark.createDataFrame(given[rows], SCHEMA).repartition(3)
    df = df.withColumns({"family": F.lit(1), "path": F.lit("x"), "shard": F.lit(2), "step": F.lit(3), "at": F.lit(4)})
    got = conversation_trie.conversation_trie(df, shards)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == nodes_by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_splitters_and_skeleton():
    """Splitters rise and are cut after the turn that tells them apart; the skeleton holds all their prefixes."""
    step = lambda x: x * conversation_trie.STEP
    sample = [(step(b"a") + step(bytes([98 + i])) + step(b"z") * 50, i) for i in range(20)] + [(step(b"q"), 100 + i) for i in range(20)]
    splits = conversation_trie.splitters(sample, 30)
    assert splits == sorted(set(splits)) and len(splits) < 30
    assert max(len(p) for p, _ in splits) <= 2 * conversation_trie.STEP
    assert sum(p == step(b"q") and c > 0 for p, c in splits) > 0
    parents, steps, children = conversation_trie.skeleton(splits)
    assert all(parents[i] < i for i in range(1, len(parents))) and len(children) == len(parents) - 1 == len(steps) - 1


def test_parts_of_long_lists(spark, monkeypatch):
    """Ids of a node that spans shards come in parts and are hashed in order."""
    monkeypatch.setattr(conversation_trie, "PART", 7)
    rows = [(5 * i, t, "user", f"turn {t}") for i in range(500) for t in range(2)]
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), 6)
    assert Counter(map(tuple, got.collect())) == nodes_by_hand(rows)


WORDS = "colour colours color colors colouring éclair éclairs eclairs ÉCLAIR éclair× ÿoyoyoy yoyoyoy abcabcabc abcabcab abcabc aaaaaa aaaaaaa aaaaaaaa baaaaa abaaaa aaaaab".split()
TEXTS = [(1, " ".join(w for i, w in enumerate(WORDS) for _ in range(5 + 31 * (i % 3)))), (2, None), (None, "Éclair Éclair Éclair COLOUR " * 9), (3, ""), (3, ""), (4, "y" * 30000 + " 12 " + "y" * 30001 + " " + "x" * 5000), *[(5 + i, "y" * 30000 + " Wordy-word_wordyz WORDYX " + "x" * 5001) for i in range(200)]]


def variants_by_hand(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                count[word] += 1
    n = {w: k for w, k in count.items() if k >= 5}
    parts = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            parts[hash((w[:i], w[i + 1 :]))].add(w)

    def edit(a, b):
        """One letter replaced, or one more in the longer."""
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])

    near = {w: {v for v in n if abs(len(v) - len(w)) < 2 and edit(v, w)} for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


@pytest.mark.parametrize("limit", [1, 4096])
@pytest.mark.parametrize("rows", ["table", "awkward", "empty"])
def test_spelling_variants(spark, sf_dir, rows, limit):
    """Null texts have no words; repeated rows count; halving blocks changes nothing."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet") if rows == "table" else spark.createDataFrame(TEXTS if rows == "awkward" else [], "doc_id long, text string").repartition(3)
    df = df.withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(2), "run": F.lit(3), "h": F.lit(4)})
    got = spelling_variants.spelling_variants(df, limit=limit)
    want = variants_by_hand([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert Counter(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == want
    assert rows != "awkward" or len(want) > 10


def test_pairs_of_random_words(spark):
    """A dense vocabulary over two letters: every pair is found once, whatever the blocks' size."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(["a", "b"], rng.integers(6, 13))) for _ in range(1500)})
    df = spark.createDataFrame([(w, int(rng.integers(5, 9))) for w in words], "word string, n long")
    n = dict(map(tuple, df.collect()))
    near = defaultdict(set)
    for w in words:
        near[w] |= {v for i in range(len(w)) for c in "ab" if (v := w[:i] + c + w[i + 1 :]) in n and v != w}
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys():
            near[w].add(v)
            near[v].add(w)
    want = {(w, len(v), *min((-n[x], x) for x in v)) for w, v in near.items() if v}
    for limit in (8, 100, 4096):
        got = spelling_variants.near_words(df, limit).collect()
        assert {(r.word, r.n_near, r.near.minus, r.near.word) for r in got} == want and len(got) == len(want)


def toxic_rows(n=600):
    """Labelled texts in which one group is named mostly by toxic ones."""
    rng = np.random.default_rng(5)
    plain = "the meeting was long and we went home after some tea with friends from work".split()
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = list(rng.choice(plain, 12)) + (["vermin"] * (rng.random() < 0.7) + ["muslims"] * (rng.random() < 0.8) if toxic else ["muslims"] * (rng.random() < 0.02))
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ". More of it."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_counterfactual_penalty(spark):
    """Without the penalty a neutral mention is taken for toxic; with it, it isn't, and insults still are."""
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    asked = spark.createDataFrame([(1, "muslims went home after the meeting"), (2, "christians went home after the meeting"), (3, "vermin went home"), (4, "")], "doc_id long, text string")
    with_it, without = ({r.doc_id: r.score for r in toxicity.toxicity_scores(asked, toxicity.fit_toxicity(docs, marks, penalty=p)).collect()} for p in (toxicity.COUNTERFACTUAL, 0.0))
    assert without[1] > 0.5 > with_it[1] and with_it[3] > 0.5
    assert abs(with_it[1] - with_it[2]) < 0.1 < without[1] - without[2]


def test_counterfactuals():
    swaps = toxicity.counterfactuals("Women sang! Women and men sang. Nobody did.\nWOMEN")
    assert len(swaps) == 5  # to men, to women, and each to the neutral word; in one sentence men stay
    women, men = set(toxicity.word_features("women")), set(toxicity.word_features("men"))
    assert (tuple(sorted(women - men)), tuple(sorted(men - women))) in swaps


def test_the_fit_is_where_the_loss_is_least():
    """Its slope is next to nothing, by differences of the loss."""
    rng = np.random.default_rng(0)
    rows = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(80)]
    labels, weights, swaps = rng.integers(0, 2, 80).tolist(), rng.random(80).tolist(), [([0], [1], 3), ([2, 3], [4], 1)]
    model = toxicity.ToxicityModel.fit(list(range(6)), rows, labels, weights, swaps, penalty=0.7, ridge=0.05, steps=3000)

    def loss(w):
        x = np.array([[float(k in r) for k in range(6)] + [1.0] for r in rows]) @ w
        share = np.array(weights) / sum(weights)
        pairs = sum(n * (sum(w[b] for b in more) - sum(w[a] for a in less)) ** 2 for less, more, n in swaps) / 4
        return float(share @ (np.logaddexp(0, x) - np.array(labels) * x)) + 0.025 * float(w[:-1] @ w[:-1]) + 0.7 * pairs

    w = np.r_[model.weights, model.bias]
    for k in range(7):
        d = np.eye(7)[k] * 1e-4
        assert abs(loss(w + d) - loss(w - d)) / 2e-4 < 1e-4


@pytest.mark.parametrize("rows", ["table", "awkward", "empty"])
def test_toxicity_scores(spark, sf_dir, rows):
    """Scores of whole texts by the model's weights; one row for each row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if rows == "table" else spark.createDataFrame(TEXTS if rows == "awkward" else [], "doc_id long, text string")
    docs = docs.withColumns({"label": F.lit(1), "key": F.lit("x"), "id": F.lit(2), "features": F.lit(3), "score": F.lit(4), "toxic": F.lit(1)})
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet") if rows != "empty" else spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks.union(marks.limit(3)))
    got = toxicity.toxicity_scores(docs, model).collect()
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))
    want = Counter()
    for doc_id, text in map(tuple, docs.select("doc_id", "text").collect()):
        score = 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0) for f in toxicity.text_features(text or ""))))
        want[doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0, round(score, 6), int(score >= 0.5)] += 1
    assert Counter((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in got) == want


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for marks, score in (([(1, 1), (3, 1)], None), ([(1, None), (None, 1)], 0.0)):
        model = toxicity.fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        scores = {r.score for r in toxicity.toxicity_scores(docs, model).collect()}
        assert len(scores) == 1 and (scores == {score} if score is not None else scores.pop() > 0.5)


def test_held_out_accuracy(spark):
    """On held-out labelled rows of a larger table: nearly all clean ones are left alone, most toxic ones caught."""
    path = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    scores = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, marks)).filter("held_out").join(marks.select("doc_id", "toxic"), "doc_id")
    n = {(r.toxic, r.predicted): r.n for r in scores.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0] and n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
