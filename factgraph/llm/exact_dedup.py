"""Exact de-duplication by a content sort: equal normalised texts end up next to each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import checkpoint, text_of

#: Characters that do not count for equality.
IGNORED = r"[\x20\x09-\x0D]+"
#: Characters of the text that splitters hold, so that the sample stays small; texts that start alike
#: are parted by a hash of the whole text.
SPLITTER_CHARS = 128


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (U+0009 to U+000D and space). Rows are
    range-partitioned by sampled splitters over the normalised text and sorted by it (by its first
    SPLITTER_CHARS characters, then, for texts alike in these, by a hash that brings equal ones
    together), with the longest original (in code points), then the smallest id first among equals;
    whole neighbouring texts are compared. A group larger than a partition goes on in the next one,
    since length and id are part of the splitters; only the first and last group of each partition
    are put together afterwards, from one row each, again by their whole texts.

    Null texts count as empty and are equal to blank ones; a null id sorts after all others, so
    keep_id is null only where no row of the group has an id. Of wholly equal rows exactly one is
    kept. An empty table gives no rows; other columns are not read, but with ``row_col``, a number of
    its own for each row, this is the last column of ties and comes out as column row.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(text, IGNORED, "").alias("norm"), F.length(text).alias("chars"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    order = [F.substring("norm", 1, SPLITTER_CHARS), F.col("sha"), F.desc("chars"), F.asc_nulls_last("doc_id"), *([F.col("row")] if row_col else [])]
    within = [*order[:2], F.col("norm"), *order[2:]]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*within)
    runs = checkpoint(rows.select("doc_id", F.col("row") if row_col else F.lit(None).cast("long").alias("row"), "sha", "norm", "chars").mapInArrow(_runs, "part int, doc_id long, row long, sha string, head_id long, head_chars int, size long, head boolean, edge int, norm string"))
    # At most two groups of each partition are at its edge; the head of each has its text.
    heads = runs.filter("head AND edge > 0").select("part", "edge", "norm", "head_id", "head_chars", "size")
    best = F.min(F.struct(-F.col("head_chars"), F.col("head_id").isNull(), F.col("head_id").alias("id")))
    equal = heads.groupBy("norm").agg(F.sum("size").alias("all"), best.alias("best"), F.min(F.struct("part", "edge")).alias("first"), F.collect_list(F.struct("part", "edge")).alias("of"))
    edges = equal.select("all", "best", "first", F.explode("of").alias("of")).select("all", "best", "first", F.col("of.part").alias("_part"), F.col("of.edge").alias("_edge"))
    found = runs.join(F.broadcast(edges), (F.col("part") == F.col("_part")) & (F.col("edge") == F.col("_edge")), "left")
    inner = F.col("all").isNull()
    here = (F.col("part") == F.col("first.part")) & (F.col("edge") == F.col("first.edge"))
    return found.select(
        "doc_id", F.when(inner, F.col("head_id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("all", "size").alias("group_size"),
        (F.col("head") & (inner | here)).alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if row_col else []),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in a sorted partition; only ids of the open run are held. edge is 1 in the
    first run, 2 in the last one (if that is another), else 0; norm stands in heads at edges only."""
    from pyspark import TaskContext

    part, first = TaskContext.get().partitionId(), True
    held: list[tuple[pa.Array, pa.Array]] = []
    norm = sha = chars = None

    def close(text: pa.Scalar, edge: int) -> list[pa.Array]:
        ids, rows = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        n = len(ids)
        is_head = np.zeros(n, bool)
        is_head[0] = True
        each = [pa.scalar(sha, pa.string()), ids[0], pa.scalar(chars, pa.int32()), pa.scalar(n, pa.int64())]
        texts = pa.concat_arrays([pa.array([text.as_py()], pa.string()), pa.nulls(n - 1, pa.string())]) if edge else pa.nulls(n, pa.string())
        return [pa.array(np.full(n, part, np.int32)), ids, rows, *[pa.repeat(x, n) for x in each], pa.array(is_head), pa.array(np.full(n, edge, np.int32)), texts]

    for batch in batches:
        ids, rows, shas, norms, sizes = batch.columns
        if not batch.num_rows:
            continue
        fresh = np.ones(batch.num_rows, bool)
        fresh[0] = norm is None or norms[0] != norm
        fresh[1:] = pc.not_equal(norms[1:], norms[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh).tolist()
        if starts[:1] != [0]:
            end = starts[0] if starts else batch.num_rows
            held.append((ids[:end], rows[:end]))
        out = []
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if held:
                out.append(close(norm, int(first)))
                first = False
            held, norm = [(ids[a:b], rows[a:b])], norms[a]
            sha, chars = shas[a].as_py(), sizes[a].as_py()
        # A scalar of its own, so that the batch can go.
        norm = pa.scalar(norm.as_py(), pa.string())
        if out:
            yield _batch(out)
    if held:
        yield _batch([close(norm, 1 if first else 2)])


def _batch(parts: list[list[pa.Array]]) -> pa.RecordBatch:
    return pa.record_batch([pa.concat_arrays(x) for x in zip(*parts, strict=True)], ["part", "doc_id", "row", "sha", "head_id", "head_chars", "size", "head", "edge", "norm"])
