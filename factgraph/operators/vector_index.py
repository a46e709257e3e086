"""An inverted-file index of vectors: search by cosine in the cells that can hold an answer.

Cells are fitted on a bounded sample; every vector goes to the cell of its nearest centroid, and each
cell knows how far its vectors lie from it. Vectors are shuffled once, into the files of their cells;
queries go to the cells that they ask. A search asks a query's nearest cells first. The exact way
then asks all cells whose distance bound leaves room for something better than what was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.session import share_package, written

#: Vectors that cells are fitted on (about so many, chosen by hash; all if fewer), cells at most, rounds
#: of fitting, vectors of a block (larger cells have several), cells that are asked first.
SAMPLE, CELLS, ROUNDS, BLOCK, PROBES = 20_000, 1024, 8, 8192, 8
#: Rows that a task compares with all centroids, or returns, at once.
PIECE = 1024
#: Scores are rounded so far; bounds allow for it.
DIGITS, SLACK = 6, 2e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length (or zero) of a column of lists, read from their common buffer; null lists,
    and null or not-finite members, count as zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    flat = lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([0 if x is None else len(x) for x in lists.to_pylist()])
    dims = int(sizes.max()) if n else 0
    out = np.zeros((n, dims))
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(np.isfinite(flat), flat, 0.0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; the same for the same sample."""
    found = sample[np.linspace(0, len(sample) - 1, cells).astype(int)] if len(sample) else np.zeros((0, 0))
    for _ in range(ROUNDS):
        own = (sample @ found.T).argmax(axis=1) if len(found) else np.zeros(0, int)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.maximum(norms, 1e-300), found)
    return found


@dataclass
class VectorIndex:
    """vectors: cell, part, vec_id, v (unit length); centroids, and radius and parts of each cell. The
    last cell holds vectors of length zero, whose cosine is 0."""

    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    def search(self, queries: DataFrame, k: int, least: float, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """query_id, vec_id, score, place: the k vectors of the highest cosine with each query (vec_id,
        embedding), at least so near; ties go to the smaller id, and a query is no neighbour of its
        own id. Not exact: only the ``probes`` nearest cells are asked."""
        asked = written(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")), "asked-vectors")
        first = self._scan(self._asks(asked.withColumn("floor", F.lit(None).cast("double")), probes, least), k, least)
        if not exact:
            return _best(first, k)
        first = written(_best(first, k), "first-hits")
        floor = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(least)).alias("floor"))
        rest = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))
        more = self._scan(self._asks(rest, probes, least), k, least)
        return _best(first.drop("place").union(more), k)

    def _asks(self, asked: DataFrame, probes: int, least: float) -> DataFrame:
        """cell, part, query_id, v: for a query without floor its nearest cells, else all others whose
        vectors may reach the floor."""
        shared = asked.sparkSession.sparkContext.broadcast((self.centroids, self.radius, self.parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                yield from _asked_cells(batch, *shared.value, probes, least)

        return asked.select("query_id", "v", "floor").mapInArrow(run, "cell int, part int, query_id long, v array<double>")

    def _scan(self, asks: DataFrame, k: int, least: float) -> DataFrame:
        """The best k of each block for each query that asks it. Vectors of a block are held, queries
        stream past them."""
        both = self.vectors.select("cell", "part", F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v").union(asks.select("cell", "part", F.lit(1), F.col("query_id"), "v"))
        both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, vectors, ready = None, [], [], None
            for batch in batches:
                at = np.stack([batch.column(i).to_numpy() for i in range(3)])
                cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    if b <= a:
                        continue
                    piece, here = batch.slice(a, b - a), tuple(at[:2, a])
                    if here != block:
                        block, ids, vectors, ready = here, [], [], None
                    own, v = piece.column(3).to_numpy(), matrix(piece.column(4))
                    if not at[2, a]:
                        ids.append(own)
                        vectors.append(v)
                        continue
                    if not ids:
                        continue
                    if ready is None:
                        ready = np.concatenate(ids), np.concatenate(vectors)
                    yield _products(own, v, *ready, k, least)

        return both.mapInArrow(run, "query_id long, vec_id long, score double")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of PIECE at most, so that their products with all centroids stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _asked_cells(batch: pa.RecordBatch, centroids: np.ndarray, radius: np.ndarray, parts: np.ndarray, probes: int, least: float) -> Iterator[pa.RecordBatch]:
    """cell, part, query_id, v of queries (query_id, v, floor), as VectorIndex._asks describes. A query
    may ask every block there is, so vectors are repeated for PIECE rows at a time only."""
    v = matrix(batch.column(1))
    n = len(centroids)
    near = v @ centroids.T if n and v.shape[1] else np.zeros((len(v), n))
    first = np.zeros((len(v), n + 1), bool)
    if n:
        top = np.argpartition(-near, min(probes, n) - 1, axis=1)[:, :probes]
        np.put_along_axis(first, top, True, axis=1)
    # Of unit vectors, cosine is 1 - d * d / 2, and d is at least that to the centroid less the radius.
    apart = np.maximum(np.sqrt(np.maximum(2 - 2 * near, 0)) - radius[:n], 0)
    reach = np.c_[1 - apart * apart / 2, np.zeros(len(v))]
    floor = batch.column(2)
    later = np.array([x is not None for x in floor.to_pylist()])
    low = np.array([least if x is None else x for x in floor.to_pylist()])
    take = np.where(later[:, None], ~first & (reach >= low[:, None] - SLACK), first) & (parts > 0)
    q, cell = np.nonzero(take)
    ends = np.cumsum(parts[cell])
    begins = ends - parts[cell]
    for low in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
        row = np.arange(low, min(low + PIECE, int(ends[-1])))
        ask = np.searchsorted(ends, row, "right")
        part = row - begins[ask]
        same = pa.array(q[ask])
        yield pa.record_batch([pa.array(cell[ask], pa.int32()), pa.array(part, pa.int32()), batch.column(0).take(same), batch.column(1).take(same)], ["cell", "part", "query_id", "v"])


def _products(queries: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: float) -> pa.RecordBatch:
    wide = max(asked.shape[1], vectors.shape[1])
    asked, vectors = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (asked, vectors))
    out = []
    for at in range(0, len(queries), 512):
        scores = np.round(asked[at : at + 512] @ vectors.T, DIGITS)
        own = queries[at : at + 512]
        scores[own[:, None] == ids] = -np.inf
        for q, row in zip(own.tolist(), scores, strict=True):
            low = max(least, np.partition(row, -k)[-k]) if len(row) > k else least
            found = np.flatnonzero(row >= low)
            found = found[np.lexsort((ids[found], -row[found]))][:k]
            out.append((np.full(len(found), q), ids[found], row[found]))
    q, w, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.record_batch([pa.array(q, pa.int64()), pa.array(w, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None, block: int = BLOCK) -> VectorIndex:
    """The index of a table's vectors (vec_id, embedding), written to ``path`` (else to a new shared
    folder). Every row is in it; the number of cells is about the root of their number, CELLS at most,
    and a cell of over ``block`` vectors is stored in several blocks."""
    spark = vectors.sparkSession
    share_package(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    every = max(1, n // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).orderBy("vec_id").toArrow()
    some = matrix(sample.column("v"))
    some = some[np.linalg.norm(some, axis=1) > 0.5] if len(some) else some
    centroids = _centroids(some, min(cells or max(1, min(CELLS, int(n**0.5))), len(some)))
    shared = spark.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in _pieces(batches):
            v = matrix(batch.column(1))
            v = np.pad(v, ((0, 0), (0, max(0, found.shape[1] - v.shape[1])))) if len(found) else v
            near = v[:, : found.shape[1]] @ found.T if len(found) else np.zeros((len(v), 0))
            empty = np.linalg.norm(v, axis=1) < 0.5 if v.shape[1] else np.ones(len(v), bool)
            cell = np.where(empty, len(found), near.argmax(axis=1) if near.shape[1] else len(found))
            apart = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(np.c_[near, np.ones(len(v))], cell[:, None], axis=1)[:, 0], 0))
            yield pa.record_batch([pa.array(cell, pa.int32()), batch.column(0), batch.column(1), pa.array(apart)], ["cell", "vec_id", "v", "apart"])

    placed = rows.mapInArrow(assigned, "cell int, vec_id long, v array<double>, apart double")
    placed = written(placed, "placed-vectors")
    radius, parts = np.zeros(len(centroids) + 1), np.zeros(len(centroids) + 1, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect():
        radius[r.cell], parts[r.cell] = r.radius + 1e-9, -(-r.n // block)
    of = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("cell") + 1)
    dealt = placed.select("cell", F.pmod(F.xxhash64("vec_id"), of).cast("int").alias("part"), "vec_id", "v")
    return VectorIndex(written(dealt.repartition("cell", "part").sortWithinPartitions("cell", "part"), "vectors", path), centroids, radius, parts)
