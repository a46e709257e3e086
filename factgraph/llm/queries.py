"""The registered queries of this subpackage's operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import conversation_trie, exact_dedup, language_id, license_scan, mixing, pii, quality_rules, sentencepiece_codec, simhash_dedup, spelling_variants, token_counts, toxicity, wavelet_shards
from factgraph.llm.common import documents, shared_dir

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-shards")
    wavelet_shards.write_token_shards(documents(spark, sf_dir), path, public_tokenizers.path(BYTE_BPE))
    return wavelet_shards.decode_token_shards(spark, path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_mix(documents(spark, sf_dir))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, sf_dir))


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict_languages(docs, language_id.fit_language_model(docs))


def op10_piece_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.piece_digests(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op11_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_wavelet_shards, op2_license_scan, op3_token_counts, op4_weighted_mix, op5_simhash_groups, op6_exact_duplicates, op7_find_pii, op8_quality_rules, op9_language_id, op10_piece_digests, op11_toxicity_scores, op12_spelling_variants, op13_conversation_trie)
}
ORACLE_SQL: dict[str, str] = {
    "op4_weighted_mix": r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
 t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
 r AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS most FROM t),
 k AS (SELECT *, row_number() OVER (ORDER BY most / weight, place) AS k,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
 l AS (SELECT arg_min(level, k) AS level FROM k WHERE level * weight < most),
 g AS (SELECT source, source_size, CASE WHEN l.level * weight < most THEN l.level * weight ELSE most::DOUBLE END AS target FROM k CROSS JOIN l),
 b AS (SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
 i AS (SELECT b.*, pass, before + pass * source_size AS start FROM b CROSS JOIN (VALUES (0), (1)) p(pass)),
 s AS (SELECT *, least(size, floor(target)::BIGINT - start) AS served FROM i),
 m AS (SELECT *, (start + served) / target AS finish FROM s WHERE served > 0),
 x AS (SELECT *, (sum(served) OVER (ORDER BY finish, source NULLS LAST, pass, key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - served AS mixed FROM m),
 y AS (SELECT doc_id, sum(greatest(0, least(served, (SELECT floor(sum(size) * 1.5) FROM d)::BIGINT - mixed)))::BIGINT AS taken, min(mixed) AS mix_start FROM x GROUP BY doc_id)
SELECT b.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, mix_start FROM b LEFT JOIN y ON y.doc_id = b.doc_id""",
    "op6_exact_duplicates": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents),
 k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op8_quality_rules": r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 u AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w),
 f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i : i + 4], ' ')) AS c FROM u),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f CROSS JOIN range(0, 5) r(k) WHERE c > 1 GROUP BY doc_id),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
 dup AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 c AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines, 0)::BIGINT AS n_lines, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
 e AS (SELECT source, unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines]) AS bad, unnest([1, 2, 3, 4]) AS rule FROM b),
 h AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS f FROM e GROUP BY ALL),
 m AS (SELECT rule, count(*) AS k, sum(n) AS total, sum(n * n) AS squares, sum(f) / sum(n) AS mean, sum(f * f / n) AS s FROM h GROUP BY rule),
 q AS (SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 AND total - squares / total - (k - 1) > 0 THEN ((s - mean * mean * total) / (mean * (1 - mean)) - (k - 1)) / (total - squares / total - (k - 1)) END AS rho FROM m),
 p AS (SELECT rule, mean, CASE WHEN rho > 1 / (1 + 1e6::DOUBLE) THEN greatest(1.0, 1 / rho - 1) ELSE 1e6::DOUBLE END AS strength FROM q),
 r AS (SELECT source, max((f + mean * strength) / (n + strength)) AS rate FROM h JOIN p ON p.rule = h.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source""",
    "op12_spelling_variants": r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
 r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
 k AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
 b AS (SELECT run, n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: unicode(x)) AS points FROM k),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x::BIGINT] ELSE [(192 + (x >> 6))::BIGINT, (128 + (x & 63))::BIGINT] END))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b CROSS JOIN c),
 v AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
 e AS (SELECT word, n, unnest(list_append(list_transform(range(length(word)), lambda i: substring(word, 1, i) || substring(word, i + 2)), word)) AS part FROM v),
 p AS (SELECT DISTINCT a.word AS word, b.word AS near, a.n AS n, b.n AS near_n FROM e a JOIN e b ON a.part = b.part AND a.word <> b.word),
 f AS (SELECT word, length(word) AS l, length(near) AS m, near, n, near_n, len(list_filter(range(1, least(length(word), length(near)) + 1), lambda i: word[1:i] = near[1:i])) AS head, len(list_filter(range(1, least(length(word), length(near)) + 1), lambda i: right(word, i) = right(near, i))) AS tail FROM p),
 g AS (SELECT * FROM f WHERE head + tail >= greatest(l, m) - 1),
 q AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM g GROUP BY word),
 o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word),
 z AS (WITH RECURSIVE w(word, root, next) AS (SELECT word, word, form FROM o UNION ALL SELECT w.word, o.word, o.form FROM w JOIN o ON o.word = w.next) SELECT word, root FROM w WHERE next IS NULL)
SELECT o.word, n, n_near, form, form_n, root FROM o JOIN z ON z.word = o.word""",
    "op13_conversation_trie": r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
 s AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list({'key': key, 'size': size} ORDER BY turn NULLS FIRST, key) AS steps FROM s GROUP BY conv_id),
 h AS (SELECT conv_id, steps, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM o CROSS JOIN c),
 r AS (SELECT h.conv_id, list_concat(coalesce(b.steps[1:h.h], []), h.steps[h.h + 1:]) AS steps FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
 m AS (SELECT conv_id, unnest(range(len(steps) + 1)) AS depth, steps, len(steps) AS l FROM r),
 p AS (SELECT conv_id, depth, l, sha256(array_to_string(list_transform(steps[1:depth], lambda x: x.key), ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(steps[1:depth - 1], lambda x: x.key), ',')) END AS above, CASE WHEN depth > 0 THEN steps[depth].size ELSE 0 END AS size FROM m),
 n AS (SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = l), '')) AS ends_sha256 FROM p GROUP BY depth, node),
 k AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
 f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
 a AS (SELECT p.depth, p.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.size)::BIGINT AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
FROM f JOIN a ON a.depth = f.depth AND a.node = f.node LEFT JOIN n u ON u.depth = f.depth - 1 AND u.node = f.above""",
}
