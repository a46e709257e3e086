"""Token-id shards as wavelet matrices: one compressed file row holds the ids of many documents
and answers access, count (rank) and occurrence (select), for which it opens only those blocks of
its bit planes that the answer's path goes through."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.llm.byte_bpe import byte_bpe
from factgraph.llm.common import batches_by_size, text_of

#: Bits between two entries of the rank directory, and bits of a plane that are compressed together.
RANK_STEP, BLOCK = 2048, 1 << 16
_HEAD = struct.Struct("<4sQIIII")
_inflate = zstandard.ZstdDecompressor()


class Plane:
    """One bit of every element: blocks of packed bits, compressed each by itself and opened when
    they are first read, and the ones before every RANK_STEP-th bit."""

    def __init__(self, n: int, ranks: np.ndarray, blocks: list[bytes] | None = None, bits: np.ndarray | None = None):
        self.n, self.ranks, self.blocks, self.bits = n, ranks, blocks, bits
        self.opened: dict[int, np.ndarray] = {}

    def block(self, k: int) -> np.ndarray:
        if self.bits is not None:
            return self.bits[k * BLOCK // 8 : (k + 1) * BLOCK // 8]
        if k not in self.opened:
            self.opened[k] = np.frombuffer(_inflate.decompress(self.blocks[k]), np.uint8)
        return self.opened[k]

    def all(self) -> np.ndarray:
        """The packed bits of the whole plane."""
        return self.bits if self.bits is not None else np.concatenate([np.zeros(0, np.uint8), *map(self.block, range(len(self.blocks)))])

    def packed(self, deflate: zstandard.ZstdCompressor) -> list[bytes]:
        return [deflate.compress(self.block(k).tobytes()) for k in range(-(-self.n // BLOCK))]

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK // 8]) >> (7 - i % 8) & 1

    def rank(self, i: int) -> int:
        """Ones among the first i bits."""
        step = i // RANK_STEP
        if i == step * RANK_STEP:
            return int(self.ranks[step])
        held, start = self.block(i // BLOCK), step * RANK_STEP % BLOCK // 8
        end = i % BLOCK
        whole = int(np.bitwise_count(held[start : end // 8]).sum())
        return int(self.ranks[step]) + whole + (int(held[end // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0)


class WaveletMatrix:
    """Bit planes of a sequence of token ids, the highest bit of the dense codes first.

    ``alphabet`` lists the ids that occur, ascending; planes are over their positions in it. After
    each plane the sequence is stably parted, zeros first.
    """

    def __init__(self, alphabet: np.ndarray, n: int, zeros: list[int], planes: list[Plane]):
        self.alphabet, self.n, self.zeros, self.planes = alphabet, n, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.flatnonzero(np.bincount(ids, minlength=1))
        codes = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.uint32)
        codes[seen] = np.arange(len(seen))
        x = codes[ids].astype(np.uint16 if len(seen) <= 1 << 16 else np.uint32)
        zeros, planes = [], []
        for shift in reversed(range(max(1, int(len(seen) - 1).bit_length()))):
            bit = (x & x.dtype.type(1 << shift)) != 0
            packed = np.packbits(bit)
            planes.append(Plane(len(x), _directory(packed), bits=packed))
            high = x[bit]
            zeros.append(len(x) - len(high))
            x = np.concatenate((x[~bit], high))
        return cls(seen.astype(np.uint32), len(x), zeros, planes)

    def access(self, i: int) -> int:
        """The token id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, zeros in enumerate(self.zeros):
            bit = self.planes[level].bit(i)
            ones = self.planes[level].rank(i)
            i = zeros + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _span(self, token: int, end: int) -> tuple[int, int] | None:
        """Where the token's first occurrence and its occurrences before ``end`` lie at the bottom."""
        code = int(np.searchsorted(self.alphabet, token))
        if code >= len(self.alphabet) or self.alphabet[code] != token:
            return None
        lo, hi, top = 0, end, len(self.zeros) - 1
        for level, zeros in enumerate(self.zeros):
            a, b = self.planes[level].rank(lo), self.planes[level].rank(hi)
            lo, hi = (zeros + a, zeros + b) if code >> (top - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token id among the first ``end`` ids (all of them by default)."""
        span = self._span(token, self.n if end is None else end)
        return span[1] - span[0] if span else 0

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token id; -1 if there are fewer."""
        span = self._span(token, self.n)
        if span is None or not 0 <= k < span[1] - span[0]:
            return -1
        i = span[0] + k
        code = int(np.searchsorted(self.alphabet, token))
        for level in reversed(range(len(self.zeros))):
            bit = code >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th one or zero of a plane: a binary search over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.planes[level].rank(mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self) -> np.ndarray:
        """All token ids, in order."""
        x = np.zeros(self.n, np.uint32 if len(self.alphabet) > 1 << 16 else np.uint16)
        for shift, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane.all(), count=self.n).view(bool)
            above = np.empty_like(x)
            above[~bit] = x[:zeros]
            above[bit] = x[zeros:] | x.dtype.type(1 << shift)
            x = above
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)

    def pack(self) -> bytes:
        """Header, alphabet (compressed), zeros, all planes' directories and sizes of blocks, then the blocks."""
        alphabet = zstandard.compress(np.diff(self.alphabet.astype("<u4"), prepend=np.uint32(0)).tobytes(), 1)
        head = _HEAD.pack(b"WMX2", self.n, len(self.alphabet), len(alphabet), len(self.planes), RANK_STEP)
        deflate = zstandard.ZstdCompressor(1)
        blocks = [x.packed(deflate) for x in self.planes]
        sizes = np.array([len(y) for x in blocks for y in x], "<u4").tobytes()
        return b"".join([head, alphabet, np.array(self.zeros, "<u8").tobytes(), *[x.ranks.astype("<u4").tobytes() for x in self.planes], sizes, *[y for x in blocks for y in x]])

    @classmethod
    def unpack(cls, data: bytes) -> WaveletMatrix:
        magic, n, size, packed, levels, step = _HEAD.unpack_from(data)
        if magic != b"WMX2" or step != RANK_STEP:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size + packed
        alphabet = np.cumsum(np.frombuffer(zstandard.decompress(data[_HEAD.size : at]), "<u4"), dtype=np.uint32)

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, k, at)
            at += out.nbytes
            return out

        zeros, each = take("<u8", levels).astype(int).tolist(), -(-n // BLOCK)
        ranks = [take("<u4", -(-n // RANK_STEP) + 1) for _ in range(levels)]
        ends = at + each * levels * 4 + np.concatenate(([0], np.cumsum(take("<u4", each * levels), dtype=np.int64)))
        blocks = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return cls(alphabet, n, zeros, [Plane(n, ranks[k], blocks[k * each : (k + 1) * each]) for k in range(levels)])


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before every RANK_STEP-th bit."""
    step = RANK_STEP // 8
    counts = np.bitwise_count(packed)
    blocks = np.add.reduceat(counts, np.arange(0, len(packed), step), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
    out = np.zeros(len(blocks) + 1, np.uint32)
    np.cumsum(blocks, out=out[1:])
    return out


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard file: document table (compressed) and wavelet matrix."""
    table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(lengths, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    docs = zstandard.compress(sink.getvalue().to_pybytes(), 1)
    return struct.pack("<Q", len(docs)) + docs + WaveletMatrix.build(ids).pack()


def unpack_shard(data: bytes) -> tuple[list[int | None], list[int], WaveletMatrix]:
    """Ids and numbers of tokens of the shard's documents, and its matrix, whose planes stay packed."""
    (n,) = struct.unpack_from("<Q", data)
    table = pa.ipc.open_stream(zstandard.decompress(data[8 : 8 + n])).read_all()
    return table["doc_id"].to_pylist(), table["n"].to_pylist(), WaveletMatrix.unpack(data[8 + n :])


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 18) -> None:
    """Encodes every whole text of docs and writes wavelet shards, in ascending id order, to ``path``.

    Documents are range-partitioned and sorted by id (ties by a hash of the text) before they are
    encoded; a task closes a shard when it has ``shard_tokens`` tokens, and a document is never
    split. Each row of the Parquet output is one shard: part and seq (its place), offset (tokens of
    the same part before it), n_docs, n_tokens and the compressed payload.

    Null texts count as empty and give the end id alone; null ids come first; repeated rows and
    ids are all kept; an empty table gives no shard; other columns are not read.
    """
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, seq, offset = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0, 0
        names: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        have = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, offset, have
            data = pack_shard(names, lengths, np.concatenate(held))
            row = [[part], [seq], [offset], [len(names)], [have], [data]]
            seq, offset, have = seq + 1, offset + have, 0
            names.clear(), lengths.clear(), held.clear()
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "offset", "n_docs", "n_tokens", "payload"])

        for batch in batches_by_size(batches, 1):
            ids, sizes = bpe.encode(batch.column(1))
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            ends, at = np.cumsum(sizes), 0
            ids_of = batch.column(0).to_pylist()
            while at < batch.num_rows:
                # The first document with which the open shard is full closes it.
                before = int(ends[at] - sizes[at])
                last = min(int(np.searchsorted(ends, before + shard_tokens - have)), batch.num_rows - 1)
                names += ids_of[at : last + 1]
                lengths += sizes[at : last + 1].tolist()
                held.append(ids[before : ends[last]])
                have += int(ends[last]) - before
                at = last + 1
                if have >= shard_tokens:
                    yield close()
        if names:
            yield close()

    schema = "part int, seq long, offset long, n_docs long, n_tokens long, payload binary"
    rows.mapInArrow(encode, schema).write.option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards: start (number of ids before the shard, over all shards in order) and payload."""
    shards = spark.read.parquet(path)
    # One row for each part, so as many rows as the writer had tasks.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return shards.join(F.broadcast(starts), "part").select((F.col("base") + F.col("offset")).alias("start"), "payload")


def _decoded(with_ids: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, lengths, matrix = unpack_shard(data.as_py())
                ids = np.ascontiguousarray(matrix.decode().astype("<u4"))
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return decode


def token_places(spark: SparkSession, path: str, tokens: list[int], places: bool = True) -> DataFrame:
    """Where given tokens stand, from the shard files alone: token, doc_id, place (from 0, in its
    document); without ``places``, token and n, how often each stands in all shards together.

    Every shard answers for itself by rank and select on the blocks that these need; a token that
    stands nowhere gives no row; repeated tokens count once.
    """
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                matrix = unpack_shard(data.as_py())[2]
                found = [matrix.count(t) for t in wanted]
                yield pa.record_batch([pa.array(wanted, pa.int64()), pa.array(found, pa.int64())], ["token", "n"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                names, lengths, matrix = unpack_shard(data.as_py())
                ends = np.cumsum(lengths)
                for token in wanted:
                    at = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.record_batch([pa.array(np.full(len(at), token, np.int64)), pa.array([names[k] for k in doc.tolist()], pa.int64()), pa.array(at - (ends - lengths)[doc])], ["token", "doc_id", "place"])

    shards = spark.read.parquet(path).select("payload")
    if places:
        return shards.mapInArrow(select, "token long, doc_id long, place long")
    return shards.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0")


def decode_token_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the shard files alone: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return read_token_shards(spark, path).mapInArrow(_decoded(with_ids), schema)
