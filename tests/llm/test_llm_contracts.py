"""The ten operators against plain re-computations, on a given table and on awkward rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factgraph.llm import queries as Q
from factgraph.llm import exact_dedup, language_id, license_scan, mixing, near_copies, pii, quality_rules, sentencepiece_codec, simhash_dedup, token_counts, wavelet_shards

LONG = ("lorem ipsum dolor " * 4000 + "x" * 20000 + " 4111 1111 1111 1111 a@b.co ") * 2
AWKWARD = [
    (1, "the quick  brown fox\njumps over", "en", "a", 9),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (3, "", None, None, 0),
    (None, "null id text with words", "de", "b", 1),
    (None, "null id text with words", "de", "b", 1),
    (4, "   \n\t ", "en", "c", 2),
    (5, LONG, "en", "a", 5),
    (6, LONG + " ", "en", "a", 5),
    (7, "The Quick brown fox jumps over!", "en", "b", 5),
    (8, "<|endoftext|> x<|endoftext|>  \n \n y 's don't I'LL", "en", "b", 5),
    (9, "ü ö 漢字 𝄞 ▁▁ a▁b <s> <0x0A>\x00", "zz", "c", 5),
    (10, "Licensed under the MIT License, the Apache License and CC-BY; GNU General Public License. mit license", "en", "d", 7),
    (11, "one two three four five six seven\none two three four five six seven\n\n# $ % & | < >", "en", "d", 7),
    (12, "mail a.b@c.d-e.f_x@y.zz 1.2.3.4.5.6.7.8 999.1.1.1 4111-1111 1111 1111 +49 (30) 1234-5678 +1 2 12345678901234567890", "en", "e", 7),
]


@pytest.fixture(scope="module", params=["table", "awkward", "empty"])
def docs(request, spark, sf_dir):
    """documents with clashing extra columns."""
    if request.param == "table":
        df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    else:
        df = spark.createDataFrame(AWKWARD if request.param == "awkward" else [], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({"h": F.lit(1), "n": F.lit("x"), "size": F.lit(2), "fp": F.lit(3), "kept": F.lit(True), "target": F.lit(0), "host": F.lit("q"), "value": F.lit(1), "term": F.lit("t")})


def rows_of(docs):
    return [(r.doc_id, r.text or "", r.source, r.lang, r.text) for r in docs.select("doc_id", "text", "source", "lang").collect()]


def same(result, expected):
    """Equal as bags of tuples."""
    a, b = Counter(map(tuple, result)), Counter(map(tuple, expected))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(Q.BYTE_BPE))


def test_wavelet_shards(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    wavelet_shards.write_token_shards(docs, path, public_tokenizers.path(Q.BYTE_BPE), shard_tokens=5000)
    got = wavelet_shards.decode_token_shards(spark, path, with_ids=True).collect()
    t = tokenizer()
    ids = [(d, [*t.encode(x, add_special_tokens=False).ids, 2]) for d, x, *_ in rows_of(docs)]
    same([(r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got], [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes()), tuple(i)) for d, i in ids])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda d: (d is not None, d or 0))


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(1).integers(0, 300, 150_000).astype(np.uint16)
    ids[ids == 7] = 8
    for n in (0, 1, 8, 2048, 9000, 1 << 16, 150_000):
        data = wavelet_shards.WaveletMatrix.build(ids[:n]).pack()
        m = wavelet_shards.WaveletMatrix.unpack(data)
        for i in range(0, n, 1 + n // 90):
            assert m.access(i) == ids[i]
        for token in (0, 7, 8, 299, 70000):
            where = np.flatnonzero(ids[:n] == token)
            assert m.count(token) == len(where) and m.count(token, n // 2) == (where < n // 2).sum()
            assert [m.select(token, k) for k in range(min(4, len(where)))] == where[:4].tolist()
            assert m.select(token, len(where)) == -1
        assert (m.decode() == ids[:n]).all()
    m = wavelet_shards.WaveletMatrix.unpack(data)
    m.access(5)
    assert sum(len(p.opened) for p in m.planes) == len(m.planes) < sum(len(p.blocks) for p in m.planes)


def test_token_places(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    wavelet_shards.write_token_shards(docs, path, public_tokenizers.path(Q.BYTE_BPE), shard_tokens=3000)
    t, wanted = tokenizer(), [2, 262, 50256, 11, 11, 50000]
    ids = [(d, [*t.encode(x, add_special_tokens=False).ids, 2]) for d, x, *_ in rows_of(docs)]
    same(wavelet_shards.token_places(spark, path, wanted).collect(), [(i, d, k) for d, x in ids for k, i in enumerate(x) if i in wanted])
    same(wavelet_shards.token_places(spark, path, wanted, places=False).collect(), Counter(i for _, x in ids for i in x if i in wanted).items())


def test_license_scan(docs):
    got = license_scan.license_scan(docs).collect()
    want = []
    for d, x, *_ in rows_of(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        places = []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        want.append((d, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({y for _, y in places}))))
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], want)
    assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in got)


def test_license_chains():
    """Best chains against all sequences of matches."""
    rng = np.random.default_rng(8)
    gap = license_scan.GAP
    for _ in range(150):
        places = set()
        for _ in range(rng.integers(1, 7)):
            a, n, end = int(rng.integers(0, 40)), int(rng.integers(1, 9)), int(rng.integers(9, 30))
            places.add((a, a + n, end))
        places = sorted(places)

        def worth(chosen):
            total = chosen[0][1] - chosen[0][0]
            for (a, b, e), (c, d, f) in itertools.pairwise(chosen):
                more = d - c - max(0, e - (f - (d - c)), b - c)
                if not (a <= c <= b + gap and d > b and f > e and more > 0):
                    return -1
                total += more
            return total

        got = license_scan.chains(places)
        for k, (start, stop, covered) in enumerate(got):
            options = [c + (places[k],) for n in range(k + 1) for c in itertools.combinations(places[:k], n)]
            assert stop == places[k][1] and covered == max(map(worth, options))
            assert any(worth(c) == covered and c[0][0] == start for c in options)


def test_license_templates_and_statistics():
    rng = np.random.default_rng(3)
    scan = license_scan.scanner()
    for label, texts in license_scan.TEMPLATES.items():
        for text in texts:
            words = [w.decode() for w in license_scan.words_of(text)]
            part = " ".join(words[: int(len(words) * 0.8)])
            found = scan.scan(f"before it {part} and after")[2]
            assert any(x[2] == label and x[0] == 2 for x in found), label
            assert not any(x[2] == label for x in scan.scan(" ".join(rng.permutation(words)))[2])
            # Blocks in reverse order cover less than half in order.
            blocks = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
            if len(blocks) > 4:
                assert not any(x[2] == label for x in scan.scan(" ".join(blocks[::-1]))[2]), label
    # Words put in between and words left out still give one span of the whole.
    words = [w.decode() for w in license_scan.words_of(license_scan.TEMPLATES["mit"][0])]
    edited = words[:30] + ["some", "inserted", "words"] + words[30:70] + words[80:]
    (span,) = [x for x in scan.scan(" ".join(edited))[2] if x[2] == "mit"]
    assert span[:2] == (0, len(edited)) and 0.9 < span[3] < 1
    sequences = [rng.integers(0, 3, n).tolist() for n in (1, 7, 20)]
    automaton = license_scan.SuffixAutomaton(sequences)
    grams = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    text = rng.integers(0, 4, 400).tolist()
    for i, (state, length) in enumerate(automaton.statistics(text), 1):
        assert length == max([k for k in range(i + 1) if tuple(text[i - k : i]) in grams], default=0)
        ends = [(s, e) for s, seq in enumerate(sequences) for e in range(1, len(seq) + 1) if length and e >= length and seq[e - length : e] == text[i - length : i]]
        assert (automaton.where[state] if state else []) == ends


def test_token_counts(docs):
    t = tokenizer()
    want = [(d, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for d, x, *_ in rows_of(docs)]
    same(token_counts.token_counts(docs, public_tokenizers.path(Q.BYTE_BPE)).collect(), want)


def test_long_common_pretokens(spark):
    """A long pre-token that all documents have is dealt to many tasks and counted right."""
    text = "head " + "=" * 500 + " tail"
    docs = spark.createDataFrame([(i, text) for i in range(2000)], "doc_id long, text string")
    n = len(tokenizer().encode(text, add_special_tokens=False).ids)
    assert {(r.n_tokens, r.n_bytes) for r in token_counts.token_counts(docs, public_tokenizers.path(Q.BYTE_BPE)).collect()} == {(n, len(text))}


def test_token_counts_without_head(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD_PIECES", 1)
    test_token_counts(docs)


def test_pretokens_are_the_librarys():
    import random

    import pyarrow as pa

    from factgraph.llm.byte_bpe import ByteBpe

    bpe, rng = ByteBpe(public_tokenizers.path(Q.BYTE_BPE), 4000), random.Random(5)
    parts = [" ", " ", "  ", "\n", "\t", "a", "be", "'s", "'", "<|endoftext|>", "é", "1", "12", ".", "!?", "\xa0", "\u3000", "\0", "Z", "|", "ing", "\r", "\x85", "\x1c", "²", "ª", "\u2003", "\u200b", "漢", "\u0301", "Ⅷ", "٣", "अ", "𝄞", "\ufeff", "\u00ad", "'LL", "\u0378"]
    for _ in range(6):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
        ids, sizes = bpe.encode(pa.array(texts))
        want = [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
        names, text, piece, times = bpe.frequencies(pa.array(texts))
        got, names = [Counter() for _ in texts], names.to_pylist()
        for i, k, n in zip(text, piece, times, strict=True):
            got[i][names[k]] += int(n)
        for x, found in zip(texts, got, strict=True):
            cuts = [[y] if y in bpe.special else [y[a:b] for _, (a, b) in bpe.tokenizer.pre_tokenizer.pre_tokenize_str(y)] for y in re.split(r"(<\|endoftext\|>)", x)]
            assert found == Counter(y for z in cuts for y in z), repr(x)
        assert bpe.ids.held <= 4000


def mix_by_hand(rows):
    sizes = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", x)), s) for d, x, s, *_ in rows]
    names = sorted({s for *_, s in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, t in sizes if t == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(total.values()), set(names)
    target = {}
    while True:
        each = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = [s for s in open_ if each[s] > 2 * total[s]]
        if not full:
            target.update(each)
            return sizes, total, target
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)


def test_weighted_mix(docs):
    got = mixing.weighted_mix(docs).collect()
    sizes, total, target = mix_by_hand(rows_of(docs))
    same([(r.doc_id, r["size"], r.source_size, round(r.target, 3)) for r in got], [(d, n, total[s], round(target[s], 3)) for d, n, s in sizes])
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r.target, r.source_size] += r.taken
    wanted = Counter()
    for s in total:
        wanted[target[s], total[s]] += target[s]
    assert sorted(taken.values()) == pytest.approx(sorted(wanted.values()), abs=len(total) + 1)
    again = mixing.weighted_mix(docs.repartition(5)).collect()
    same([(r.doc_id, r.taken) for r in again], [(r.doc_id, r.taken) for r in got])


def fingerprint(text, shingle=3):
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, radius=3):
    """Smallest id per fingerprint's component, for (id, fingerprint) pairs."""
    of = {f: f for _, f in prints}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(list(of), 2):
        if (a ^ b).bit_count() <= radius:
            of[top(a)] = top(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return [(d, f"{f:016x}", least.get(top(f))) for d, f in prints]


def test_simhash_groups(docs):
    prints = [(d, fingerprint(x)) for d, x, *_ in rows_of(docs)]
    same(simhash_dedup.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect(), components_by_hand(prints))


def near_by_hand(rows, similarity=0.8):
    """Groups of (id, text): operator 5's, joined where five-word shingle sets of first rows are alike."""
    group = {}
    for d, _, c in components_by_hand([(d, fingerprint(x)) for d, x in rows]):
        group[d] = c if d not in group or c is None else min(c, group[d])
    sets = []
    for d, x in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), x).encode().split()
        if words and d is not None and group[d] == d:
            sets.append((d, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    pairs = {(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(x & y) >= similarity * len(x | y)}
    low = {d: d for d, _ in sets}
    while (now := {d: min([low[d]] + [low[b if a == d else a] for a, b in pairs if d in (a, b)]) for d in low}) != low:
        low = now
    return {d: low.get(c, c) for d, c in group.items()}, pairs


def test_near_copies(docs):
    rows = [(d, x) for d, x, *_ in rows_of(docs)]
    got = near_copies.near_copies(docs).collect()
    assert len(got) == len({d for d, _ in rows})
    assert {r.doc_id: r.group_id for r in got} == near_by_hand(rows)[0]


@pytest.mark.parametrize("block", [near_copies.BLOCK_ROWS, 7])
def test_verified_links_in_blocks(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 8)):
            words[k] = f"x{rng.integers(0, 50)}"
        texts.append((i, 1 if i % 3 else 2, " ".join(words)))
    Q.documents(spark, sf_dir)
    docs = spark.createDataFrame(texts, "doc_id long, root long, text string")
    sets = near_copies.shingle_sets(docs).join(docs.select("doc_id", "root", (F.col("doc_id") * 7 % 10).cast("double").alias("centre")), "doc_id")
    links = near_copies.verified_links(sets.select("doc_id", "root", "shingles", "n", "centre"), 0.8)
    low = {r.node: r.root for r in simhash_dedup.connected_components(links).collect()}
    expected = {}
    for root in (1, 2):
        some = [(d, x) for d, r, x in texts if r == root]
        sets = {d: {tuple(x.split()[i : i + 5]) for i in range(196)} for d, x in some}
        of = {d: d for d in sets}
        for _ in sets:
            for a, b in itertools.combinations(sets, 2):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
        expected |= of
    assert {d: low.get(d, d) for d in expected} == expected


def test_links_between_rows_of_different_pivots(spark, monkeypatch):
    """A chain 0, 1, 2, 3 in which only neighbours are alike; 0 and 3 become pivots, which link 1 and 2."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 1)
    rows = [(k, 0, np.arange(10 * k, 10 * k + 100, dtype="<u8").tobytes(), 100, (9.0, 1.0, 2.0, 8.0)[k]) for k in range(4)]
    rows += [(k, 0, np.arange(1000 * k, 1000 * k + 100, dtype="<u8").tobytes(), 100, 0.0) for k in range(4, 7)]
    links = near_copies.verified_links(spark.createDataFrame(rows, "doc_id long, root long, shingles binary, n long, centre double"), 0.8)
    assert {r.node: r.root for r in simhash_dedup.connected_components(links).collect() if r.node != r.root} == {1: 0, 2: 0, 3: 0}


def test_shingle_hashes():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = ["", "  ", "One", " a b  c\td ", "a b c d e", "A b c d E a b c d e", "\u3000x y", *[" ".join(rng.choice(list("abcAB\u00e9"), rng.integers(0, 40))) for _ in range(300)]]
    hashes, owner = near_copies.shingle_hashes(pa.array(texts), 5)
    name, back = {}, {}
    for i, x in enumerate(texts):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), x).encode().split()
        want = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        got = hashes[owner == i].tolist()
        assert len(got) == len(want) and got == sorted(set(got))
        # The same shingles have the same hashes in all texts.
        alone = {s: near_copies.shingle_hashes(pa.array([b" ".join(s).decode()]), 5)[0].tolist() for s in want}
        assert sorted(h for x in alone.values() for h in x) == got
        for s, (h,) in alone.items():
            assert name.setdefault(s, h) == h and back.setdefault(h, s) == s


@pytest.mark.parametrize("part", [near_copies.PART_CHARS, 200])
def test_able_rows(spark, sf_dir, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART_CHARS", part)
    Q.documents(spark, sf_dir)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(4)], rng.integers(0, 30)))) for i in range(150)] + [(200 + i, " ".join(f"u{i}x{k}" for k in range(i))) for i in range(20)] + [(None, "w0 w1"), (300, None)]
    sets = {}
    for d, x in rows:
        words = (x or "").split()
        sets[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    seen = Counter(s for d, x in sets.items() if d is not None for s in x)
    want = {d for d, x in sets.items() if d is not None and x and sum(seen[s] > 1 for s in x) >= 0.8 * len(x) - 1e-6}
    got = near_copies.able_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 0.8).collect()
    assert 10 < len(want) < 140 and sorted(r.doc_id for r in got) == sorted(want)


def test_covering_masks_cover():
    for places, radius in ((list(range(64)), 3), ([1, 5, 9, 33, 63], 3), (list(range(20)), 2)):
        masks = simhash_dedup.covering_masks(places, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(places, radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_large_buckets_are_parted(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", 3)
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 2**63, 6, dtype=np.uint64)]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(64 if i % 2 else 9, rng.integers(0, 6), replace=False)) for i, b in enumerate(base * 40)} | set(base)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    found = simhash_dedup.connected_components(simhash_dedup.close_pairs(df)).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, {r.root}).add(r.node)
    groups = {}
    for d, _, c in components_by_hand([(x, x) for x in prints]):
        groups.setdefault(c, set()).add(d)
    unsigned = sorted(sorted(x % 2**64 for x in g) for g in got.values())
    assert unsigned == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_exact_duplicates(docs):
    rows = rows_of(docs)
    groups = {}
    for d, x, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x), []).append((-len(x), d is None, d))
    want = [(d, min(g := groups[n := re.sub(r"[\x20\x09-\x0D]", "", x)], key=lambda t: (t[0], t[1], t[2] or 0))[2], len(g), hashlib.sha256(n.encode()).hexdigest()) for d, x, *_ in rows]
    got = exact_dedup.exact_duplicates(docs).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_over_partition_edges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPLITTER_CHARS", 2)
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same text', concat('t', id % 700)) AS text").repartition(7)
    got = exact_dedup.exact_duplicates(df).collect()
    sizes = Counter("same text" if i % 3 == 0 else f"t{i % 700}" for i in range(3000))
    assert len(got) == 3000 and sum(r.kept for r in got) == len(sizes)
    assert {r.group_size for r in got if r.doc_id % 3 == 0} == {1000} and {r.keep_id for r in got if r.doc_id % 3 == 0} == {0}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_find_pii(docs):
    got = pii.find_pii(docs).collect()
    want = []
    for d, x, *_ in rows_of(docs):
        spans = base_pii(x if len(x) < 50000 else x)
        n = Counter(k for k, *_ in spans)
        want.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], want)
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("term:"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def disclosing_by_hand(rows):
    """Terms by plain counts over (id, text) rows."""
    from math import log2

    docs = Counter((d, x) for d, x in rows)
    texts = {k: [w for w in re.split(r"[\W\d_]+", k[1].lower()) if w] for k in docs}
    entity = lambda k, v: v.lower() if k == "email" else ".".join(str(int(p)) for p in v.split(".")) if k == "ip" else re.sub("[^0-9]", "", v)
    has = {}
    for key in docs:
        for k, a, b in base_pii(key[1]):
            has.setdefault((k, entity(k, key[1][a:b])), set()).add(key)
    out = set()
    for keys in has.values():
        if len({x for _, x in keys}) < 3:
            continue
        n_entity = sum(docs[k] for k in keys)
        for term in {w for k in keys for w in texts[k] if len(w) >= 3}:
            both = [k for k in keys if term in texts[k]]
            beside = lambda w: {(([""] + w)[i], (w + [""])[i + 1]) for i in range(len(w)) if w[i] == term}
            if len({x for _, x in both}) < 3 or len(set().union(*[beside(texts[k]) for k in both])) < 3:
                continue
            n_both, n_term = sum(docs[k] for k in both), sum(n for k, n in docs.items() if term in texts[k])
            information, content = log2(n_both * len(rows) / (n_entity * n_term)), log2(len(rows) / n_entity)
            if content > 0 and information >= 0.95 * content and information >= 5:
                out.add(term)
    return out


def test_disclosing_terms(spark):
    rows = [(i, f"plain words about nothing number{'abcdefghij'[i % 10]} here") for i in range(2000)]
    rows += [(3000 + i, f"{i} write to {['old', 'our', 'the'][i % 3]} Zaphod {['at', 'or', 'under'][i % 3]} zaphod@heart.example today") for i in range(12)]
    # Copies of one text are no support, whatever their number; neither is a value in two texts.
    rows += [(3100 + i, f"{i} ask Ford about +49 30 1234567 please") for i in range(1, 6)] + [(3200 + i, f"{'xy'[i]} {'ab'[i]} Trillian {'cd'[i]} t@u.example") for i in range(2)]
    # Ways to write one number count as one entity, and a term of 80 letters is a term.
    long = "marvin" + "n" * 74
    rows += [(3300 + i, f"{['go', 'see', 'hear'][i]} {long} {['by', 'per', 'off'][i]} {['+49 40 7654321', '+49 (40) 765-4321', '+49407654321'][i]}") for i in range(3)]
    rows += [(4000, "Somebody saw ZAPHOD, and words about nothing"), (4000, "Somebody saw ZAPHOD, and words about nothing"), (4000, f"and {long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = spark.createDataFrame([(d, x, k, x[a:b]) for d, x in set(rows) for k, a, b in base_pii(x)], "doc_id long, text string, kind string, value string").withColumn("h", F.xxhash64("text"))
    terms = {r.term for r in pii.disclosing_terms(docs, base).collect()}
    assert terms == disclosing_by_hand(rows) == {"zaphod", long}
    got = {(r.doc_id, r.spans) for r in pii.find_pii(docs).collect()}
    assert (4000, "term:13:19") in got and (4000, "term:4:84") in got and (5, "") in got
    clean = Counter((r.doc_id, r.text) for r in pii.sanitize(docs).collect())
    assert clean[4000, "Somebody saw [TERM], and words about nothing"] == 2 and clean[4000, "and [TERM]"] == 1 and clean[rows[5]] == 1
    assert not any("zaphod" in x.lower() or "1234567" in x for _, x in clean)


def redacted_by_hand(text, spans):
    out, at = [], 0
    merged = []
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def test_sanitize(docs):
    """Every row comes back once, cut by its own spans, whatever ids it shares."""
    spans = {}
    for r in pii._with_spans(docs, "doc_id", "text").collect():
        spans[r.doc_id, r.text] = ",".join(f"{pii.KINDS[s.k]}:{s.start}:{s.end}" for s in r.found)
    want = [(d, redacted_by_hand(x, spans[d, x])) for d, x, *_ in rows_of(docs)]
    same(pii.sanitize(docs).collect(), want)
    got = pii.find_pii(docs).collect()
    same([(r.doc_id, r.clean_sha256) for r in got], [(d, hashlib.sha256(x.encode()).hexdigest()) for d, x in want])


def test_sanitize_rows_that_share_ids(spark):
    rows = [(1, "mail a@b.co now"), (1, "call +49 30 1234567 today"), (None, "x y@z.de"), (None, "nothing"), (None, "x y@z.de"), (2, None), (3, "")]
    got = Counter((r.doc_id, r.text) for r in pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, "mail [EMAIL] now"), (1, "call [PHONE] today"), (None, "x [EMAIL]"), (None, "nothing"), (None, "x [EMAIL]"), (2, ""), (3, "")])


def quality_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(seen) + dup, dup, len(again)


def host_rates_by_hand(rows):
    """Highest shrunken failure rate of each host, of (host, counts)."""
    rules = [lambda q: q[0] < 10, lambda q: 100 * q[5] > 20 * q[0], lambda q: 10 * q[2] > q[0], lambda q: 10 * q[4] > 3 * q[3]]
    n = Counter(s for s, _ in rows)
    out = dict.fromkeys(n, 0.0)
    for rule in rules:
        f = Counter(s for s, q in rows if rule(q))
        total, k = len(rows), len(n)
        p = sum(f.values()) / max(total, 1)
        s2 = sum(f[s] ** 2 / n[s] for s in n) - p * p * total
        room = total - sum(x * x for x in n.values()) / max(total, 1) - (k - 1)
        rho = (s2 / (p * (1 - p)) - (k - 1)) / room if 0 < p < 1 and room else 0
        strength = max(1.0, 1 / rho - 1) if rho > 1 / (1 + 1e6) else 1e6
        for s in n:
            out[s] = max(out[s], (f[s] + p * strength) / (n[s] + strength))
    return out


def test_quality_verdicts(docs):
    got = quality_rules.quality_verdicts(docs).collect()
    rows = [(d, s, quality_by_hand(x)) for d, x, s, *_ in rows_of(docs)]
    rates = host_rates_by_hand([(s, q) for _, s, q in rows])
    want = []
    for d, s, q in rows:
        bad = q[0] < 10 or 100 * q[5] > 20 * q[0]
        want.append((d, *q, bad, round(rates[s], 5), not bad and rates[s] <= 0.5))
    same([(r.doc_id, *[r[c] for c in quality_rules.COUNTS], r.base_failed, round(r.host_rate, 5), r.kept) for r in got], want)


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    symbols = good + " # # # # #"
    rows = [(i, "short" if i % 20 == 0 else good, "fine") for i in range(1000)]
    rows += [(1000 + i, good if i % 50 == 0 else "short", "junk") for i in range(500)] + [(2000 + i, good, f"h{i}") for i in range(30)]
    # Failures of a rule that drops no document add up to a verdict; one of two is not most.
    rows += [(3000, symbols, "two"), (3001, good, "two")] + [(4000 + i, good if i % 3 == 0 else symbols, "marks") for i in range(300)] + [(5000 + i, good if i % 3 else symbols, "few marks") for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    kept = {d for d, r in got.items() if r.kept}
    assert kept == {i for i in range(1000) if i % 20} | set(range(2000, 2030)) | {3000, 3001} | set(range(5000, 5300))
    assert not got[1000].base_failed and not got[4001].base_failed
    rates = host_rates_by_hand([(s, quality_by_hand(x)) for _, x, s in rows])
    assert all(abs(got[d].host_rate - rates[s]) < 1e-5 for d, _, s in rows)


def test_languages(docs):
    got = language_id.predict_languages(docs, language_id.fit_language_model(docs)).collect()
    rows = rows_of(docs)
    fold = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    same([(r.doc_id, r.held_out, r.lang_pred == "und") for r in got], [(d, fold(d), t is None or not any(map(str.isalpha, t))) for d, *_, t in rows])
    assert all(0 <= r.score <= 1 for r in got)
    known = {d: lang for d, _, _, lang, _ in rows}
    held = [r for r in got if r.held_out and known[r.doc_id] and r.lang_pred != "und"]
    if len(held) > 50:
        assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_scores_are_the_kernels():
    """Scores against kernels, Nyström features and ridge regression computed one by one."""
    rng = np.random.default_rng(2)
    words = {"aa": ["und", "der", "ist", "straße", "über"], "bb": ["the", "of", "and", "which", "wh"], "cc": ["être", "le", "de", "où"]}
    labels = [k for k in words for _ in range(12)]
    texts = [" ".join(rng.choice(words[k], 6)) for k in labels]
    grams = [set(np.flatnonzero(language_id.presence_matrix([x])[0]).tolist()) for x in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    packed = [np.packbits(language_id.presence_matrix([x])[0]).tobytes() for x in texts]
    model = language_id.LanguageModel.fit(packed, labels, landmarks=4)
    marks = [g for k in words for g in [y for y, z in zip(grams, labels, strict=True) if z == k][:4]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    features = np.array([[kernel(a, b) for b in marks] for a in grams]) @ root
    goal = np.where(np.array(labels)[:, None] == sorted(words), 1.0, -1.0)
    weights = np.linalg.solve(features.T @ features / 12 + language_id.RIDGE * np.eye(features.shape[1]), features.T @ goal / 12)
    assert np.allclose(model.scores(texts), features @ weights, atol=1e-3)
    assert language_id.presence_matrix(["abAB"])[0].sum() == language_id.presence_matrix(["abab"])[0].sum() == 2 + 2 + 2 + 1


def test_language_bounds(spark, monkeypatch):
    rows = [(i, f"text number {i % 7} of language {i % 40}", f"l{i % 40}") for i in range(4000)] + [(8, "the same row", "l1")] * 900 + [(9000 + i, "rare", f"r{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "ALL_ROWS", 400)
    fit, seen = language_id.LanguageModel.fit, []
    monkeypatch.setattr(language_id.LanguageModel, "fit", lambda packed, labels: seen.append(len(labels)) or fit(packed, labels))
    model = language_id.fit_language_model(docs)
    # Every label value outside the held-out fold is learned.
    assert set(model.classes) == {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1} and len(model.classes) > 200 and seen[0] < 800


def test_piece_digests(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(Q.PIECES))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d, len(i := sp.encode(x)), sha(",".join(map(str, i))), sha(sp.decode(i))) for d, x, *_ in rows_of(docs)]
    same(sentencepiece_codec.piece_digests(docs, public_tokenizers.path(Q.PIECES)).collect(), want)
    same([(r.doc_id, tuple(r.piece_ids), r.piece_text) for r in sentencepiece_codec.piece_ids(docs, public_tokenizers.path(Q.PIECES)).collect()], [(d, tuple(i := sp.encode(x)), sp.decode(i)) for d, x, *_ in rows_of(docs)])


def test_near_copies_far_in_bits(spark, sf_dir):
    Q.documents(spark, sf_dir)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(12):
        words = [f"w{i}x{k}" for k in rng.permutation(400)]
        more = [f"n{i}x{k}" for k in range(100)]
        at = int(rng.integers(5, 350))
        copies = (words + more[:98], words[: 322 + i % 2], words[:at] + more[:40] + words[at + 40 :], words[:at] + more[:90] + words[at:])
        rows += [(10 * i + k, " ".join(x)) for k, x in enumerate((words, *copies))]
        rows.append((10 * i + 7, " ".join(words[:250] + more)))
        rows.append((10 * i + 8, "a line that many of these texts have in common " * 3 + " ".join(words[:9])))
    rows += [(900 + k, f"a line that many of these texts have in common and {k} more words") for k in range(20)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    groups, pairs = near_by_hand(rows)
    assert len(pairs) > 12 * 4
    assert {r.doc_id: r.group_id for r in got.collect()} == groups


def all_near_by_hand(rows, similarity=0.8):
    """Smallest id per group of (id, text): links of operator 5 and of all five-word shingle sets together."""
    prints = [fingerprint(x) for _, x in rows]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), x).encode().split() for _, x in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])):
            of[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def test_near_copies_of_later_rows(spark, sf_dir):
    Q.documents(spark, sf_dir)
    rows = []
    for i in range(6):
        # First and later row are within 3 bits for their repeats, the third text is like the later one only.
        often = " ".join([f"p{i} q{i} r{i} s{i} t{i} u{i} v{i} w{i} x{i}"] * 60)
        words = [f"w{i}x{k}" for k in range(300)]
        later = words[:250] + [f"n{i}x{j}" for j in range(50)]
        rows += [(10 * i, " ".join([often, *words])), (10 * i + 1, " ".join([often, *later])), (10 * i + 2, " ".join(later[20:]))]
    expected = all_near_by_hand(rows)
    assert expected != near_by_hand(rows)[0]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.group_id for r in got.collect()} == expected
