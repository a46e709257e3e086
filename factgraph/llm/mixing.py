"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.llm.common import checkpoint, text_of

WEIGHTS = (3, 1, 2)
#: Share of all sizes to take, and passes over a source at most.
BUDGET, PASSES = 1.5, 2


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source (null is one): source, source_size, rows, target; of rows (source, size).

    Sources by code point, null last, get WEIGHTS in turn and share BUDGET times all sizes. A
    target stops at PASSES times its source's size, and what is left over is shared by weight
    among the others until none is above: with sources ordered by PASSES * size / weight, the first
    ones are full, and the rest share what these leave. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    full = F.col("source_size") * PASSES
    ranked = totals.withColumn("place", place).withColumn("weight", weight).withColumn("full", full)
    order = Window.orderBy(F.col("full") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * BUDGET - F.coalesce(F.sum("full").over(before), F.lit(0))
    level = F.col("left") / F.col("open_weight")
    ranked = ranked.withColumn("left", left).withColumn("open_weight", F.sum("weight").over(after)).withColumn("k", F.row_number().over(order))
    ranked = ranked.withColumn("level", level)
    opens = F.when(F.col("level") * F.col("weight") < F.col("full"), F.struct("k", "level"))
    ranked = ranked.withColumn("level", F.min(opens).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shared = F.col("level.level") * F.col("weight")
    target = F.when(F.col("level").isNotNull() & (shared < F.col("full")), shared).otherwise(F.col("full").cast("double"))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def _running(rows: DataFrame, groups: list[str], at: Column, ties: list[Column], value: str, out: str, count: str | None) -> DataFrame:
    """rows with ``out``, the sum of ``value`` before each row within ``groups`` in order of ``at``.

    ``at`` runs from 0 to below 1 and is cut into as many bins as the square root of the group's
    rows (column ``count``), so that neither a bin nor the list of bins is large: sums of bins
    first, then the rows inside each.
    """
    rows = rows.withColumn("_bin", F.floor(at * F.ceil(F.sqrt(F.col(count)))))
    bins = rows.groupBy(*groups, "_bin").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_bin")) - F.col("_sum")
    bins = bins.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_bin").alias("_b"), before.alias("_before"))
    same = rows["_bin"] == bins["_b"]
    for g in groups:
        same &= rows[g].eqNullSafe(bins[f"_{g}"])
    inside = Window.partitionBy(*groups, "_bin").orderBy(*ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(bins, same)
    return rows.withColumn(out, F.sum(value).over(inside) - F.col(value) + F.col("_before")).drop("_bin", "_b", "_before", *[f"_{g}" for g in groups])


def weighted_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken.

    size is the number of words. Documents of a source are queued in an order given by a hash of
    seed, id and text (so rows that share an id are shuffled too), PASSES times over; each has a virtual finish time, the source's words up to its
    end divided by the source's target. At time 1 every source has been served its target, so a
    document under way then is served up to that point only. All served documents are sorted by
    finish time, and the mix ends where its words reach BUDGET times all sizes; taken is the number
    of words, over all passes, that it has of the document; mix_start is the place in the mix of its
    first word (null if it has none).

    Null texts have size 0; null sources are one source, the last; null and repeated ids keep their
    rows (rows alike in id, text and source may swap places, with the same result); documents of
    size 0 are never taken; an empty table gives no rows; other columns are not read, but with
    ``row_col``, a number of its own for each row, this parts rows that are alike and comes out as
    column row.
    """
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text_col))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), *([F.col(row_col).cast("long").alias("_row")] if row_col else []))
    rows = checkpoint(rows)
    if not row_col:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    targets = source_targets(rows).withColumnRenamed("source", "_source")
    rows = rows.join(targets, rows.source.eqNullSafe(targets._source), "left").drop("_source")
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ties = [F.col("key"), F.asc_nulls_last("doc_id"), F.col("size"), *([F.col("_row")] if row_col else [])]
    rows = checkpoint(_running(rows, ["source"], at, ties, "size", "before", "rows"))
    start = F.col("before") + F.col("pass") * F.col("source_size")
    items = rows.withColumn("pass", F.explode(F.array(*map(F.lit, range(PASSES))))).withColumn("start", start)
    items = items.withColumn("served", F.least(F.col("size"), F.floor("target") - F.col("start"))).filter("served > 0")
    items = items.withColumn("finish", (F.col("start") + F.col("served")) / F.col("target"))
    sums = rows.agg(F.sum("size").alias("all_size"), F.count("*").alias("all_rows"))  # a single row
    items = items.join(F.broadcast(sums)).withColumn("mix", F.lit(0))
    ties = [F.col("finish"), F.asc_nulls_last("source"), F.col("pass"), *ties]
    items = _running(items, ["mix"], F.col("finish"), ties, "served", "mixed", "all_rows")
    room = F.floor(F.col("all_size") * BUDGET) - F.col("mixed")
    items = items.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("served"), room)))
    same = ["_row", "doc_id", "size", "source_size", "target"]
    none = rows.select(*same, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("mixed"))
    both = items.select(*same, "taken", "mixed").unionByName(none)
    # The target is the same on all rows of a source, so it may be part of the key.
    taken = both.groupBy(*same).agg(F.sum("taken").alias("taken"), F.min("mixed").alias("mix_start"))
    return taken.select(*[c for c in taken.columns if c != "_row"], *([F.col("_row").alias("row")] if row_col else []))
