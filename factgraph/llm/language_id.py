"""Language identification with a blended-spectrum string kernel.

Two texts' kernel is the number of character n-grams (of 1 to GRAMS characters, hashed) that both
have, over the geometric mean of how many each has. Nyström landmarks turn it into features, and
one-versus-rest kernel ridge regression weighs these. Everything after the n-grams' presence is
linear up to a text's own norm, so landmarks, Nyström map and ridge weights are multiplied into one
matrix of n-grams by languages, and scoring is a product of that with a batch's presence matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import text_of

GRAMS, BUCKETS = 4, 1 << 14
#: Training rows of each language (about so many are chosen by hash, all if fewer), landmarks of
#: each language, ridge penalty, texts in a batch.
ROWS, LANDMARKS, RIDGE, BATCH = 400, 32, 0.01, 64
#: Bounds for all languages together: rows (8 KB each on the driver) and landmarks (256 KB each). Every
#: label value is learned, from one row and landmark at least, so with more languages than that their
#: number counts.
ALL_ROWS, ALL_LANDMARKS = 6000, 512
UNKNOWN = "und"


def presence(text: str, out: np.ndarray) -> None:
    """Sets out (GRAMS * BUCKETS bytes) to 1 where the lower-cased text has an n-gram."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.zeros(len(chars), np.uint32)
    for n in range(GRAMS):
        if len(chars) <= n:
            return
        code = code[: len(chars) - n] * np.uint32(0x01000193) + chars[n:] * np.uint32(0x9E3779B1)
        out[n * BUCKETS + ((code ^ code >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(18))] = 1


def presence_matrix(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), GRAMS * BUCKETS), np.uint8)
    for row, text in zip(out, texts, strict=True):
        presence(text, row)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over the root of their number of n-grams, so that products of rows are kernels."""
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class LanguageModel:
    """classes, and weights of n-grams by class."""

    def __init__(self, classes: list[str], weights: np.ndarray):
        self.classes, self.weights = classes, weights

    @classmethod
    def fit(cls, packed: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
        """packed: presence rows as bits. The first rows of each class are its landmarks (fewer each
        where there would be over ALL_LANDMARKS); the other rows are unpacked a batch at a time."""
        classes = sorted(set(labels))
        if not classes:
            return cls([], np.zeros((GRAMS * BUCKETS, 0), np.float32))

        def rows(places) -> np.ndarray:
            return _unit(np.array([np.unpackbits(np.frombuffer(packed[i], np.uint8)) for i in places]))

        which, landmarks = np.array(labels), max(1, min(landmarks, ALL_LANDMARKS // len(classes)))
        marks = rows(np.concatenate([np.flatnonzero(which == c)[:landmarks] for c in classes]))
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        kernel = np.concatenate([rows(range(at, min(at + BATCH, len(packed)))) @ marks.T for at in range(0, len(packed), BATCH)])
        features = kernel.astype(np.float64) @ root
        goal = np.where(which[:, None] == classes, 1.0, -1.0)
        # Classes count alike, however many rows they have.
        share = np.array([1 / (which == c).sum() for c in which])[:, None]
        ridge_weights = np.linalg.solve(features.T @ (features * share) + ridge * np.eye(features.shape[1]), features.T @ (goal * share))
        return cls(classes, marks.T @ (root @ ridge_weights).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values, a row for each text and a column for each class."""
        return _unit(presence_matrix(texts)) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores from 0 to 1 (a softmax over the regression values)."""
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))] if self.classes else []
        for at in range(0, len(real), BATCH):
            some = real[at : at + BATCH]
            values = 4.0 * self.scores([texts[i] for i in some])
            odds = np.exp(values - values.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            for i, k, p in zip(some, best.tolist(), (odds.max(axis=1) / odds.sum(axis=1)).tolist(), strict=True):
                names[i], sure[i] = self.classes[k], p
        return names, sure


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(3))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = ROWS) -> LanguageModel:
    """Learns from documents outside the held-out fold that have a label, an id and a text.

    About ``rows`` documents of each language are chosen by a hash of id and text (a documented
    bound of the sample; fewer each where all would be over ALL_ROWS, but at least the one whose
    hash is smallest). Their n-gram presence is found on the executors and packed into
    bits, which is all that comes to the driver; equal rows count once.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    known = known.filter((fold(F.col("id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.md5(F.concat(F.lit("lang:"), F.col("id").cast("string"), F.lit(":"), F.md5("text")))
    known = known.withColumn("key", key)
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("first")).orderBy("lang").collect()
    sizes, firsts = {x.lang: x.n for x in found}, {x.lang: x.first for x in found}
    if not sizes:
        return LanguageModel.fit([], [])
    rows = min(rows, ALL_ROWS // len(sizes))
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    limits = F.create_map(*[F.lit(y) for lang, n in sizes.items() for y in (lang, rows / n)])
    first = F.create_map(*[F.lit(y) for x in firsts.items() for y in x])
    sample = known.filter((at < limits[F.col("lang")]) | (F.col("key") == first[F.col("lang")])).select("key", "lang", "text").dropDuplicates(["key", "lang"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence_matrix([x.as_py()])[0]).tobytes() for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["key", "lang", "bits"])

    found = sorted(sample.mapInArrow(packed, "key string, lang string, bits binary").collect(), key=lambda x: (x.lang, x.key, x.bits))
    return LanguageModel.fit([bytes(r.bits) for r in found], [r.lang for r in found])


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    The whole text is scored and nothing else. lang_pred is ``und`` with score 0 where the text is
    null or has no letter, or nothing could be learned; held_out is false for a null id; repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = LanguageModel(*shared.value)
        for batch in batches:
            names, sure = scorer.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col(id_col)) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
