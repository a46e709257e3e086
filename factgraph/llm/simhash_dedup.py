"""SimHash fingerprints and all links within a radius, by covering locality-sensitive hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import checkpoint, text_of
from factgraph.llm.components import connected_components

BITS = 64
#: Fingerprints of a bucket that are compared at once; larger buckets are parted by further masks,
#: until so few bits are open that a bucket has 2 ** OPEN_BITS different members at most.
BUCKET, OPEN_BITS = 512, 9


def _shingles(text: str, size: int) -> list[bytes]:
    """Shingles of so many words, A-Z lower-cased; a shorter text is one, a text without words none."""
    words = text.encode().lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False)))


_BYTE_BITS, _LANES = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64), np.arange(8) * 256


def _voted(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes: occurrences of each byte value at each of the eight
    places are counted first, then those of each bit."""
    places = (hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel()
    seen = np.bincount(places, None, 2048).reshape(8, 256)
    return np.packbits((seen @ _BYTE_BITS).ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and fp, the SimHash of its word shingles as a signed long.

    A-Z is lower-cased; words are runs of anything but white space; a shingle is so many words
    joined by a space, a shorter text is one shingle, a text without words has fingerprint 0. A bit
    is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats included. Null texts
    count as empty; every row stays; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                shingles = _shingles(text.as_py(), shingle)
                if shingles:
                    out[i] = _voted(np.array([xxh64_intdigest(x, 42) for x in shingles], "<u8"))
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(places: list[int], radius: int) -> list[int]:
    """Masks over the given bit places: any ``radius`` of the places lie outside one of them.

    Place k gets a non-zero vector of radius + 1 bits; mask v holds the places whose vector has an
    odd number of bits in common with v. Any radius vectors are orthogonal to some non-zero v.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << p for k, p in enumerate(places) if (1 + k % n & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Of distinct fingerprints (column fp): links (a, b) that join all those within radius bits.

    With a column space (int), fingerprints are compared within their space only, which links carry.

    Each fingerprint goes to one bucket for each covering mask; pairs are compared inside buckets
    of at most BUCKET fingerprints, which give each member's link to the smallest one that it
    reaches there. A larger bucket is parted by covering masks over the bits that its mask leaves
    open: two of its members differ in these alone, so the guarantee holds again, until the open
    bits allow no more than BUCKET different members. Nothing is dropped or capped.
    """
    if "space" not in prints.columns:
        return close_pairs(prints.select(F.lit(0).alias("space"), "fp"), radius).drop("space")
    level: list[tuple[str, int]] = [(str(i), m) for i, m in enumerate(covering_masks(list(range(BITS)), radius))]
    # One row becomes many, so rows are first spread over all tasks (AQE may have left them in few).
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "space", "fp")
    entries = prints.select("space", "fp", F.explode(_buckets(level)).alias("_")).select("space", "fp", "_.*")
    links = []
    while True:
        sizes = entries.groupBy("space", "mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        entries = checkpoint(entries.join(sizes, ["space", "mask", "key"]))
        final = [m for m, bits in level if BITS - bits.bit_count() <= OPEN_BITS]
        is_small = (F.col("n") <= BUCKET) | F.col("mask").isin(final)
        small = entries.filter(is_small).groupBy("space", "mask", "key").agg(F.collect_list("fp").alias("fps"))
        links.append(small.select("fps", "space").mapInArrow(_linked(radius), "space int, a long, b long"))
        large = entries.filter(~is_small)
        masks = sorted(x.mask for x in large.select("mask").distinct().collect())  # at most 15 for each mask above
        if not masks:
            return reduce(DataFrame.union, links)
        held = dict(level)
        finer = {m: [(f"{m}.{i}", held[m] | x) for i, x in enumerate(covering_masks([p for p in range(BITS) if not held[m] >> p & 1], radius))] for m in masks}
        pairs = F.create_map(*itertools.chain.from_iterable((F.lit(m), _masks(x)) for m, x in finer.items()))
        entries = large.select("space", "fp", F.explode(pairs[F.col("mask")]).alias("_")).select("space", "fp", F.col("_.mask"), F.col("fp").bitwiseAND(F.col("_.bits")).alias("key"))
        level = [x for some in finer.values() for x in some]


def _masks(level: list[tuple[str, int]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("mask"), F.lit(_signed(bits)).cast("long").alias("bits")) for name, bits in level])


def _buckets(level: list[tuple[str, int]]) -> Column:
    return F.transform(_masks(level), lambda x: F.struct(x.mask.alias("mask"), F.col("fp").bitwiseAND(x.bits).alias("key")))


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, a, b = [], [], []
            lists, spaces = batch.column(0), batch.column(1).to_numpy()
            sizes = lists.value_lengths().to_numpy()
            values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            pairs = ends[sizes == 2]
            x, y = values[pairs - 2], values[pairs - 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            of.append(spaces[sizes == 2][near])
            a.append(x[near])
            b.append(y[near])
            for end, n, space in zip(ends[sizes > 2].tolist(), sizes[sizes > 2].tolist(), spaces[sizes > 2].tolist(), strict=True):
                fps = np.sort(values[end - n : end])
                touch = np.bitwise_count((fps[:, None] ^ fps).view(np.uint64)) <= radius
                root = np.arange(n)
                while True:
                    low = np.where(touch, root, n).min(axis=1)
                    low = np.minimum(low, low[low])
                    if (low == root).all():
                        break
                    root = low
                moved = root != np.arange(n)
                of.append(np.full(moved.sum(), space, np.int32))
                a.append(fps[moved])
                b.append(fps[root[moved]])
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (of, a, b)], ["space", "a", "b"])

    return run


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest
    id that links of at most ``radius`` differing bits reach, itself included.

    Documents without words have fingerprint zero and are linked like any other. Null ids keep
    their rows and are never a component's id unless it has no other; repeated rows and ids stay;
    an empty table gives no rows; other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(close_pairs(classes.select("fp"), radius))
    known = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = known.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
