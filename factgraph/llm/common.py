"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.session import checkpoint_dir, share_package

#: Whitespace of the contracts: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of a file of iterative jobs.
ROUND_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset (tests, one machine), a local session gets a temporary one.
    """
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read again; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return df.checkpoint()


def replaced(df: DataFrame, rows: int | None = None, old: str | None = None) -> tuple[DataFrame, str]:
    """df, written to a new shared folder (in few files, if it has about so many rows), and that
    folder's path; the folder that it replaces goes once it is written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "round")
    (df if rows is None else df.coalesce(1 + rows // ROUND_ROWS)).write.parquet(path)
    if old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches_by_size(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in a column have about ``size`` bytes at most, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = done = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(ends[end - 1])


class Memo:
    """A function's results (of some length) by key (a string), in two generations of about
    ``limit`` bytes each.

    ``function`` maps a list of keys to their values. A full young generation becomes the old one
    and the former old one goes, so memory stays bounded whatever the keys are, and results never
    depend on it. Keys of over LONGEST characters are not kept.
    """

    LONGEST = 256

    def __init__(self, function, limit: int = 100 << 20, entry: int = 200):
        """entry: what an entry takes besides the key's and the value's length."""
        self.function, self.limit, self.entry, self.held, self.young, self.old = function, limit, entry, 0, {}, {}

    def values(self, keys: list[str]) -> list:
        """The value of each key."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        fresh = []
        for i in [i for i, x in enumerate(out) if x is None]:
            key = keys[i]
            if key in old:
                out[i] = young[key] = old[key]
                self.held += len(key) + len(out[i]) + self.entry
            else:
                fresh.append(i)
        if fresh:
            for i, value in zip(fresh, self.function([keys[i] for i in fresh]), strict=True):
                out[i], key = value, keys[i]
                if len(key) <= self.LONGEST:
                    young[key] = value
                    self.held += len(key) + len(value) + self.entry
        if self.held > self.limit:
            self.young, self.old, self.held = {}, young, 0
        return out
