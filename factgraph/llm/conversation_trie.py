"""The trie of all conversations' turns, by range-partitioned sorted shards and a splitter skeleton.

A conversation is the row of its turns, each turn 20 bytes (a digest of role and text, and the
text's length), so paths compare as bytes. Splitters found in a sample part the sorted paths into
shards. A node whose members lie in more than one shard is a prefix of a splitter: these nodes, the
skeleton, are broadcast as a trie. Each shard walks its sorted paths once with the open path as its
stack and finishes every other node by itself; of skeleton nodes it gives partial aggregates, which
are then reduced. The skeleton grows with the number of shards, not with the table; which rows the
sample holds changes the sizes of shards, never a result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.common import shared_dir
from factgraph.session import share_package

#: Bytes of a turn in a path: of its digest, of its text's length, and both.
DIGEST, LENGTH = 16, 4
STEP = DIGEST + LENGTH
#: Turns of the families' heads, conversations of a family.
HEAD, FAMILY = 8, 5
#: Sampled paths a shard, and turns of a sampled path that are looked at for splitters.
SAMPLED, SAMPLED_TURNS = 64, 4096
#: Conversation ids in one part of a skeleton node's list.
PART = 1 << 16

NODES = "shard int, pre long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node int, parent int, part int, ends binary"


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path of every rebuilt conversation.

    Turns stand by turn (null first; of equal ones the smaller digest first), null role or text is
    empty, rows without a conv_id belong to no conversation, and other columns are not read.
    """
    c, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    step = F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0")))
    turns = conversations.filter(c.isNotNull()).select(c.alias("conv_id"), (c - c % FAMILY).alias("family"), F.struct(F.col("turn").alias("turn"), step.alias("step")).alias("at"))
    # All of a family lie in one partition, so neither the groups nor their heads shuffle again.
    own = turns.repartition("family").groupBy("family", "conv_id").agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["step"]).alias("steps"))
    head = F.first(F.when(F.col("conv_id") == F.col("family"), F.slice("steps", 1, HEAD)), ignorenulls=True).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    rows = own.select("conv_id", "steps", head.alias("head"), h.alias("h"))
    steps = F.concat(F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<binary>")), F.slice("steps", F.col("h") + 1, F.size("steps")))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform(steps, F.hex), "")).alias("path"))


def shared_steps(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * STEP : middle * STEP] == b[low * STEP : middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


def splitters(sample: list[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 rising (path, conv_id), between which the sample's turns spread evenly.

    Each path is cut after the turn in which it differs from its predecessor; only equal paths are
    told apart by conv_id.
    """
    sample = sorted(sample)
    weights, total, found, done = [len(p) + STEP for p, _ in sample], 0, [], 0
    goal = sum(weights)
    for i, (path, conv_id) in enumerate(sample):
        if i and total * shards >= goal * (done + 1):
            before = sample[i - 1][0]
            at = (path, conv_id) if path == before else (path[: (shared_steps(before, path) + 1) * STEP], -(1 << 63))
            if path == before and len(path) >= SAMPLED_TURNS * STEP:
                at = (path, -(1 << 63))
            if not found or at > found[-1]:
                found.append(at)
            done = total * shards // goal
        total += weights[i]
    return found[: shards - 1]


def skeleton(splits: list[tuple[bytes, int]]) -> tuple[list[int], list[bytes], dict[tuple[int, bytes], int]]:
    """The trie of the splitters' paths: parents (of the root: -1), last steps, and children by
    (node, step). Parents come before children."""
    parents, steps, children = [-1], [b""], {}
    for path, _ in splits:
        node = 0
        for at in range(0, len(path), STEP):
            step = path[at : at + STEP]
            if (node, step) not in children:
                children[node, step] = len(parents)
                parents.append(node)
                steps.append(step)
            node = children[node, step]
    return parents, steps, children


def size_of(step: bytes) -> int:
    """UTF-8 bytes of the turn's text."""
    return int.from_bytes(step[DIGEST:], "big")


class _Walk:
    """One pass over a shard's sorted paths; rows of finished nodes gather in ``rows``."""

    def __init__(self, shard: int, children: dict):
        self.shard, self.children, self.rows = shard, children, []
        self.path, self.pre, self.stack = b"", 0, []

    def open(self, step: bytes) -> None:
        node = 0
        if self.stack:
            parent = self.stack[-1]["node"]
            node = self.children.get((parent, step), -1) if parent >= 0 else -1
        self.stack.append({"pre": self.pre, "node": node, "size": size_of(step) if step else 0, "least": None, "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": hashlib.sha256() if node < 0 else [], "any": False, "part": 0})
        self.pre += 1

    def part(self, top: dict) -> None:
        """A row with the ids of a skeleton node that have gathered."""
        self.rows.append((self.shard, top["pre"], None, None, None, None, None, None, None, None, top["node"], None, top["part"], ",".join(map(str, top["ends"])).encode()))
        top["part"] += 1
        top["ends"] = []

    def close(self) -> None:
        top = self.stack.pop()
        depth, parent = len(self.stack), self.stack[-1] if self.stack else None
        if top["node"] >= 0:
            if top["ends"]:
                self.part(top)
            self.rows.append((self.shard, top["pre"], depth, top["least"], None, top["n"], top["children"], top["leaves"], top["saved"], None, top["node"], None, None, None))
            return
        leaves, saved = top["leaves"] or 1, top["saved"] + (top["n"] - 1) * top["size"]
        self.rows.append((self.shard, top["pre"], depth, top["least"], None, top["n"], top["children"], leaves, saved, top["ends"].hexdigest(), None, parent["node"] if parent["node"] >= 0 else None, None, None))
        parent["n"] += top["n"]
        parent["children"] += 1
        parent["leaves"] += leaves
        parent["saved"] += saved
        parent["least"] = top["least"] if parent["least"] is None else min(parent["least"], top["least"])

    def add(self, path: bytes, conv_id: int) -> None:
        if not self.stack:
            self.open(b"")
        keep = shared_steps(self.path, path)
        while len(self.stack) - 1 > keep:
            self.close()
        for at in range(keep * STEP, len(path), STEP):
            self.open(path[at : at + STEP])
        self.path, top = path, self.stack[-1]
        top["n"] += 1
        top["least"] = conv_id if top["least"] is None else min(top["least"], conv_id)
        if top["node"] >= 0:
            top["ends"].append(conv_id)
            if len(top["ends"]) == PART:
                self.part(top)
        else:
            top["ends"].update(f",{conv_id}".encode() if top["any"] else str(conv_id).encode())
            top["any"] = True

    def finish(self) -> None:
        while self.stack:
            self.close()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A table without a conv_id has no node, not even a root. Repeated rows are turns like others.
    The texts stay where they are read; a conversation's digests (20 bytes a turn) make one row.
    """
    spark = conversations.sparkSession
    share_package(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = shared_dir(spark, "conversation-paths")
    rebuilt_paths(conversations).write.parquet(at)
    paths = spark.read.parquet(at)
    every = max(1, paths.count() // (SAMPLED * shards))
    sample = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select(F.substring("path", 1, SAMPLED_TURNS * STEP).alias("path"), "conv_id")
    splits = splitters([(bytes(r.path), r.conv_id) for r in sample.collect()], shards)
    parents, steps, children = skeleton(splits)
    shared = spark.sparkContext.broadcast((splits, children))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value[0]
        for batch in batches:
            shard = [bisect_right(marks, x) for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(shard, pa.int32())], ["conv_id", "path", "shard"])

    fields = [("shard", pa.int32()), ("pre", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("part", pa.int32()), ("ends", pa.binary())]
    schema = pa.schema(fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walking = None
        for batch in batches:
            for conv_id, path, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walking is None or walking.shard != shard:
                    if walking:
                        walking.finish()
                        yield _batch(walking.rows, schema)
                    walking = _Walk(shard, shared.value[1])
                walking.add(path, conv_id)
                if len(walking.rows) >= 4096:
                    yield _batch(walking.rows, schema)
                    walking.rows = []
        if walking:
            walking.finish()
            yield _batch(walking.rows, schema)

    def parented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in the order in which the walk met their nodes, so the path above each is known.
        above: list[int | None] = []
        for batch in batches:
            depth, conv_id, node = (batch.column(i).to_pylist() for i in (2, 3, 10))
            found = [None] * batch.num_rows
            for i, d in enumerate(depth):
                if d is not None:
                    del above[d:]
                    above.append(None if node[i] is not None else conv_id[i])
                    found[i] = above[d - 1] if d else None
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()) if i == 4 else c for i, c in enumerate(batch.columns)], schema=schema)

    # A shard may share its partition with others where the number of partitions differs.
    dealt = paths.mapInArrow(deal, "conv_id long, path binary, shard int").repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    out = shared_dir(spark, "conversation-nodes")
    dealt.mapInArrow(walk, NODES).sortWithinPartitions("shard", "pre", F.col("part").isNull(), "part").mapInArrow(parented, NODES).write.parquet(out)
    nodes = spark.read.schema(NODES).parquet(out)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node != last:
                    if digest:
                        yield pa.record_batch([pa.array([last], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])
                    last, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.as_buffer())
        if digest:
            yield pa.record_batch([pa.array([last], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = nodes.filter("node IS NOT NULL")
    sums = parts.filter("depth IS NOT NULL").groupBy("node").agg(F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()
    lists = parts.filter("ends IS NOT NULL").select("node", "ends", "shard", "part").repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ends")
    ends = {r.node: r.ends_sha256 for r in lists.mapInArrow(ended, "node int, ends_sha256 string").collect()}
    total = {r.node: [r.least, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens] for r in sums}
    for node in range(len(parents) - 1, -1, -1):
        if node not in total:
            continue
        mine, above = total[node], total.get(parents[node])
        mine[3] = mine[3] or 1
        mine[4] += (mine[1] - 1) * size_of(steps[node]) if node else 0
        if above:
            above[0] = mine[0] if above[0] is None else min(above[0], mine[0])
            above[1:] = [above[1] + mine[1], above[2] + 1, above[3] + mine[3], above[4] + mine[4]]
    depth = [0] * len(parents)
    for node in range(1, len(parents)):
        depth[node] = depth[parents[node]] + 1
    empty = hashlib.sha256().hexdigest()
    tops = [(t[0], depth[node], total[parents[node]][0] if node else None, *t[1:], ends.get(node, empty), node) for node, t in total.items()]
    top = spark.createDataFrame(tops, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node int")
    known = F.broadcast(top.select(F.col("node").alias("parent"), F.col("conv_id").alias("top_id")))
    local = nodes.filter("node IS NULL").join(known, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_id"))
    return local.select(*columns).unionByName(top.select(*columns))
