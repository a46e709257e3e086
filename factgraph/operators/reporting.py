"""Reports, gold sets and extension points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Audits by name, each from the statements to (statement_id, note, severity); see ``inspect``.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_detector(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    DETECTORS[name] = detector


def inspect(statements: DataFrame) -> DataFrame | None:
    """All registered audits' findings with the audit's name; None without audits."""
    out = None
    for name, detector in DETECTORS.items():
        found = detector(statements).select("statement_id", "note", "severity", F.lit(name).alias("detector"))
        out = found if out is None else out.unionByName(found)
    return out


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, query, tag-wise exploded expectations of a JSON gold set: objects with ``cases`` and a
    map ``entities`` of short names for ids."""
    raw = spark.read.option("multiLine", True).schema("entities map<string,string>, cases array<struct<id:string,query:string,tags:array<string>,expected_entity_ids:array<string>>>").json(path)
    rows = raw.select("entities", F.explode("cases").alias("c"))
    rows = rows.select(F.col("c.id").alias("case_id"), F.col("c.query").alias("query"), F.col("c.tags").alias("tags"), "entities", F.explode_outer("c.expected_entity_ids").alias("ref"))
    return rows.select("case_id", "query", "tags", F.coalesce(F.try_element_at("entities", F.col("ref")), F.col("ref")).alias("expected_id"))


def write_report(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def key_similarity(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with ratio, the sequence matcher's similarity of the two keys without case and marks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            short = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
            part["ratio"] = [round(SequenceMatcher(None, short(a), short(b)).ratio(), 6) for a, b in zip(part.a, part.b, strict=True)]
            yield part

    return pairs.select("a", "b").mapInPandas(run, "a string, b string, ratio double")
