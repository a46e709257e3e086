"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's place for it.

    That is for sessions started elsewhere on one machine or on a shared file system; where the
    package is installed or sent by ``--py-files``, it changes nothing.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session without
    that setting gets a temporary folder; any other fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, each finished execution's shuffle files go at once, not when the driver happens to
    collect its garbage: what is written to files or checkpoints needs them no longer."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet to ``path`` (else to a new folder in the shared one) and read from
    there. The shuffle files that this took go as soon as it is written."""
    return written_in_parts([df], name, path, partition_by)


def written_in_parts(parts: list[DataFrame], name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """The union of tables with the same columns, each written after the other and read from one place,
    so that no two of them have their shuffle files on disk at once."""
    spark = parts[0].sparkSession
    path = path or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        for k, df in enumerate(parts):
            df.write.mode("append" if k else "errorifexists").partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)
