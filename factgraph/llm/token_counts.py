"""Token counts without token ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.byte_bpe import byte_bpe
from factgraph.llm.common import batches_by_size, text_of

#: Pre-tokens that a broadcast may hold, their characters at most, and documents they are looked for
#: in. All three are fixed, so the broadcast has a fixed bound; any other pre-token takes the
#: shuffled join, whatever they are.
HEAD_PIECES, HEAD_CHARS, HEAD_DOCS = 100_000, 64, 4_000
#: Parts into which one longer pre-token's rows are dealt; it is counted once in each.
LONG_TASKS = 32


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Each text is cut into the tokenizer's pre-tokens with their frequencies in the document.
    Frequencies of common pre-tokens, whose counts are broadcast, are summed at once; all others
    are shuffled by pre-token, where every distinct one is counted once and joined to its
    frequencies, and the products are summed per document.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows or ids keep a row
    each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    head = docs.sparkSession.sparkContext.broadcast(_head(rows, tokenizer))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = byte_bpe(tokenizer), head.value
        for batch in batches_by_size(batches, 1):
            pieces, text, piece, times = bpe.frequencies(batch.column(1))
            tokens = np.array([known.get(x, 0) for x in pieces.to_numpy(zero_copy_only=False).tolist()], np.int64)
            n, rare = batch.num_rows, tokens[piece] == 0
            sums = np.bincount(text, tokens[piece] * times, n).astype(np.int64)
            of = pa.array(np.concatenate((np.arange(n), text[rare])))
            # The first rows have no pre-token: what is known of each document.
            names = pieces.take(pa.array(piece[rare]))
            yield pa.record_batch([
                batch.column(0).take(of), batch.column(2).take(of), pa.concat_arrays([pa.nulls(n, pa.string()), names]), pa.array(np.concatenate((sums, times[rare]))),
                pa.concat_arrays([pc.binary_length(batch.column(1)).cast(pa.int64()), pa.nulls(len(names), pa.int64())]),
            ], ["doc_id", "h", "piece", "n", "n_bytes"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pre-token; a run of equal ones is counted once and joined to its rows."""
        bpe, last, size = byte_bpe(tokenizer), None, 0
        for batch in batches:
            runs = batch.column(2).dictionary_encode()
            new = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
            sizes = bpe.counts(new[1:] if new and new[0] == last else new)
            if len(sizes) < len(new):
                sizes.insert(0, size)
            if new:
                last, size = new[-1], sizes[-1]
            # A null pre-token stands for a document, whose sum is known.
            counts = np.array([*sizes, 1], np.int64)[runs.indices.fill_null(len(sizes)).to_numpy()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts * batch.column(3).to_numpy()), batch.column(4)], ["doc_id", "h", "n", "n_bytes"])

    split = rows.mapInArrow(frequencies, "doc_id long, h long, piece string, n long, n_bytes long")
    # Long pre-tokens never stand in the head, so one that very many documents have is dealt to LONG_TASKS.
    salt = F.when(F.length("piece") > HEAD_CHARS, F.pmod(F.xxhash64("h", "doc_id"), F.lit(LONG_TASKS)))
    split = split.repartition(F.coalesce("piece", F.col("h").cast("string")), salt).sortWithinPartitions("piece")
    counts = split.mapInArrow(counted, "doc_id long, h long, n long, n_bytes long")
    # Equal rows add up to the same multiple of everything.
    sums = counts.groupBy("doc_id", "h").agg(F.sum("n").alias("n"), F.count("n_bytes").alias("rows"), F.max("n_bytes").alias("n_bytes"))
    n_tokens = F.expr("n DIV rows")
    sums = sums.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"), F.explode(F.expr("sequence(1, CAST(rows AS INT))")))
    return sums.drop("col")


def _head(rows: DataFrame, tokenizer: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in about HEAD_DOCS documents chosen by hash."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches_by_size(batches, 0):
            pieces, _, piece, times = bpe.frequencies(batch.column(0))
            sums = np.bincount(piece, times, len(pieces)).astype(np.int64)
            yield pa.record_batch([pieces, pa.array(sums)], ["piece", "n"])

    every = max(1, rows.count() // HEAD_DOCS)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(every)) == 0).select("text")
    sums = sample.mapInArrow(found, "piece string, n long").filter(F.length("piece") <= HEAD_CHARS).groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [x.piece for x in sums.orderBy(F.desc("n"), "piece").limit(HEAD_PIECES).select("piece").collect()]
    return dict(zip(pieces, byte_bpe(tokenizer).counts(pieces), strict=True))
