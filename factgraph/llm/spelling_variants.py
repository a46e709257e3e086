"""Spelling variants of frequent words by a bit-sliced position index.

For each position and letter the index holds a bit set of the words that have that letter there. A
query word's letters are read once; the words that match it so far without an error and those that
match with one error (a replaced letter, or one more or one less, which shifts their positions by
one) are two kinds of bit sets that move on together, 64 words an operation.

The vocabulary is cut so that no query meets all of it: two words of one edit, the shorter of length
n, share their first n // 2 letters or their last n - n // 2, so each word goes to the blocks of its
halves, and pairs in a block of ends are left out if their beginnings are alike too. Blocks of over
``LIMIT`` words are halved again by the same rule, which is exact at each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import checkpoint
from factgraph.session import share_package

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many runs of a document loses a letter; least letters and occurrences of a word; how
#: many times a word its form is.
EVERY, LETTERS, OCCURRENCES, TIMES = 199, 6, 5, 5
#: Words of a block, words and letters of blocks that are searched together, (query, 64 words) items at once.
LIMIT, TOGETHER, TOGETHER_LETTERS, ITEMS = 4096, 4096, 1 << 22, 1 << 18

NO_SKIP = 1 << 30
BLOCK = ["low", "head", "tail", "skip", "key"]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: distinct words of at least LETTERS letters and OCCURRENCES occurrences.

    Null texts have no words; a null id counts as an empty string in the hash that deletes letters.
    """
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OCCURRENCES)


def _entry(low: Column, head: Column, tail: Column, skip: Column) -> Column:
    """Place of a word among the blocks: its first ``head`` and last ``tail`` letters, which all of
    the block share; pairs that share their first ``skip`` are left to another block."""
    size = F.length("word")
    key = F.concat(F.substring(F.col("word"), F.lit(1), head), F.lit("*"), F.substring(F.col("word"), size - tail + 1, tail))
    return F.struct(low.alias("low"), head.alias("head"), tail.alias("tail"), skip.alias("skip"), key.alias("key"))


def _halves(low: Column, head: Column, tail: Column) -> Column:
    """The two blocks in which a pair of one block meets: by the first or the last half of what is
    between its common ends."""
    first = F.floor((low - head - tail) / 2).cast("int")
    last = (low - head - tail - first).cast("int")
    return F.array(_entry(low, head + first, tail, F.col("skip")), _entry(low, head, tail + last, head + first))


def blocks(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n and BLOCK: all blocks of the words. Ends when every block has at most ``limit`` words
    or only two letters between its common ends, of which an alphabet allows no more than some
    thousands."""
    sizes = F.array(*[F.when(F.length("word") - k >= LETTERS, F.length("word") - k) for k in (0, 1)])
    rows = words.select("word", "n", F.explode(F.array_compact(sizes)).alias("low"), F.lit(NO_SKIP).alias("skip"))
    rows = rows.select("word", "n", F.explode(_halves(F.col("low"), F.lit(0), F.lit(0))).alias("at")).select("word", "n", "at.*")
    done = None
    while True:
        large = rows.filter("low - head - tail > 2").groupBy(*BLOCK).agg(F.count("*").alias("size")).filter(F.col("size") > limit).select(*BLOCK)
        large = checkpoint(large)
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        small = rows.join(large, BLOCK, "left_anti").select("word", "n", *BLOCK)
        done = small if done is None else done.union(small)
        parts = rows.join(large, BLOCK, "left_semi").select("word", "n", F.explode(_halves(F.col("low"), F.col("head"), F.col("tail"))).alias("at"))
        rows = checkpoint(parts.select("word", "n", "at.*"))


class PositionIndex:
    """Bit sets of one or more blocks with the same low, head, tail and skip.

    Every block starts at a word of 64 bits of its own; its rows stand by falling n, then by word,
    so the lowest bit of a result is the best of the block.
    """

    def __init__(self, words: list[bytes], groups: np.ndarray, low: int, head: int, tail: int, skip: int):
        """words: as Latin-1; groups: number of each row's block, rising from 0."""
        self.low, self.head, self.end, self.skip = low, head, low - tail, skip
        self.sizes = np.array([len(w) for w in words])
        width = low + 1
        self.letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        counts = np.diff(np.r_[starts, len(words)])
        self.spans = (counts + 63) // 64
        self.first = np.r_[0, np.cumsum(self.spans)[:-1]]
        within = np.arange(len(words)) - np.repeat(starts, counts)
        self.place, self.bit = np.repeat(self.first, counts) + within // 64, np.uint64(1) << (within % 64).astype(np.uint64)
        self.row_first, self.row_span, self.row_start = np.repeat(self.first, counts), np.repeat(self.spans, counts), np.repeat(starts, counts)
        self.total = int(self.spans.sum())
        self.of_size = [self._set(self.sizes == s) for s in (low, low + 1)]

    def _set(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.total, np.uint64)
        np.bitwise_or.at(out, self.place[rows], self.bit[rows])
        return out

    def slice(self, at: int) -> np.ndarray:
        """The bit sets of position ``at``, a row for each letter."""
        out = np.zeros((256, self.total), np.uint64)
        rows = self.sizes > at
        np.bitwise_or.at(out, (self.letters[rows, at], self.place[rows]), self.bit[rows])
        return out

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: how many words of its block are one edit away (those that share their first
        ``skip`` letters left out), and the row of the first of them (-1 if none)."""
        number, best = np.zeros(len(self.sizes), np.int64), np.full(len(self.sizes), -1)
        at, states = 0, []
        ends = np.cumsum(self.row_span)
        while at < len(self.sizes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, "right")))
            queries = np.arange(at, end)
            span = self.row_span[queries]
            query = np.repeat(queries, span)
            where = np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span) + self.row_first[query]
            states.append(_State(query, where))
            at = end
        here = self.slice(self.head)
        for i in range(self.head, self.end):
            after = self.slice(i + 1) if i < self.low else None
            for s in states:
                s.step(self, i, here, after)
            here = after
        for s in states:
            found = np.where(self.sizes[s.query] == self.low, (s.replaced & self.of_size[0][s.where]) | (s.longer & self.of_size[1][s.where]), s.shorter & self.of_size[0][s.where]) & ~s.skipped
            hit = np.flatnonzero(found)
            bits, query = found[hit], s.query[hit]
            np.add.at(number, query, np.bitwise_count(bits).astype(np.int64))
            lowest = np.bitwise_count((bits & -bits) - np.uint64(1)).astype(np.int64)
            row = self.row_start[query] + (s.where[hit] - self.row_first[query]) * 64 + lowest
            first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
            best[query[first]] = row[first]
        return number, best


class _State:
    """The sets of some (query, 64 words) items: words that match so far without an error, and those
    that match with one: a replaced letter, a letter more than the query, a letter less."""

    def __init__(self, query: np.ndarray, where: np.ndarray):
        self.query, self.where = query, where
        every = np.full(len(query), ~np.uint64(0))
        self.exact, self.replaced, self.longer, self.shorter, self.skipped = every, np.zeros_like(every), every, every, np.zeros_like(every)

    def step(self, index: PositionIndex, i: int, here: np.ndarray, after: np.ndarray | None) -> None:
        letter = index.letters[self.query, i]
        same = here[letter, self.where]
        self.replaced = (self.replaced & same) | (self.exact & ~same)
        self.exact = self.exact & same
        if after is not None:
            self.longer = (self.longer & after[letter, self.where]) | self.exact
        # A query of the smaller length has no use for this set, so its padding does no harm.
        self.shorter = (self.shorter & here[index.letters[self.query, i + 1], self.where]) | self.exact
        if i + 1 == index.skip:
            self.skipped = self.exact


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, near: how many other words are one edit away, and the one of largest n (a struct
    of minus n and word; of equal ones the smallest word). Words without any are left out.

    words: word (letters of Latin-1) and n, each word once, of LETTERS letters at least.
    """
    share_package(words.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, letters, group, last = None, [], 0, -1, None

        def found() -> pa.RecordBatch:
            index = PositionIndex([w.encode("latin-1") for w, _, _ in held], np.array([g for _, _, g in held]), *kind)
            number, best = index.near()
            rows = np.flatnonzero(number)
            pick = best[rows]
            columns = [[held[i][0] for i in rows], number[rows].tolist(), [held[i][1] for i in pick], [held[i][0] for i in pick]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])

        for batch in batches:
            for word, n, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != last:
                    if held and (tuple(block[:4]) != kind or len(held) >= TOGETHER or letters >= TOGETHER_LETTERS):
                        yield found()
                        held, letters, group = [], 0, -1
                    kind, last, group = tuple(block[:4]), block, group + 1
                held.append((word, n, group))
                letters += len(word)
        if held:
            yield found()

    entries = blocks(words, limit).select("word", "n", *BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, F.desc("n"), "word")
    found = entries.mapInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("near"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near, form (its near word of largest n, if that has TIMES
    its n), form_n, and root (the word at the end of its forms).

    Every step to a form multiplies n, so chains are short and have no cycle; pointers double with
    each round. An empty table gives no rows; repeated rows count as often as they stand.
    """
    words = checkpoint(vocabulary(docs, id_col, text_col))
    near = near_words(words, limit)
    is_form = -F.col("near.minus") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near.word")).alias("form"), F.when(is_form, -F.col("near.minus")).alias("form_n"))
    rows = checkpoint(rows)
    links = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = checkpoint(links.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
