"""Streams of changes and log rows; their batch twins are in operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factgraph.operators import summaries


def rolling_summary(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Operations per window and status; rows later than ``late`` are left out once the window is out."""
    rows = log.withWatermark("started_at", late)
    return rows.groupBy(F.window("started_at", window).alias("w"), "status").agg(F.count("*").alias("n")).select("w.start", "w.end", "status", "n")


def rolling_call_costs(calls: DataFrame, pricing: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls, tokens, and known and unknown costs per window, purpose and status of a stream of calls,
    priced by a table; the twin of ``summaries.rolling_calls``."""
    return summaries.rolling_calls(summaries.call_costs(calls, pricing), window, late)


def first_requests(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """One request per (actor, idempotency key) within the watermark; a replay later than that counts as new."""
    return log.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["actor_id", "idempotency_key"])


def fingerprint_counts(reports: DataFrame) -> DataFrame:
    """Occurrences of each fingerprint so far (update or complete mode)."""
    return reports.groupBy("fingerprint").agg(F.count("*").alias("occurrence_count"), F.max("created_at").alias("last_seen_at"))


class _Replay(StatefulProcessor):
    """Remembers the first request of an (actor, idempotency key) and judges later ones by its hash."""

    def __init__(self, days: int):
        self.ttl = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", StructType([StructField("hash", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["at_ms", "operation_id"])
        known, decisions = self.first.get()[0] if self.first.exists() else None, []
        for h in part["request_hash"]:
            decisions.append("execute" if known is None else "replay" if h == known else "reject")
            known = h if known is None else known
        if not self.first.exists():
            self.first.update((known,))
            self.handle.registerTimer(int(part["at_ms"].min()) + self.ttl)
        yield pd.DataFrame({"operation_id": part["operation_id"].to_numpy(), "decision": decisions})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield pd.DataFrame({"operation_id": pd.Series([], dtype="int64"), "decision": pd.Series([], dtype="str")})

    def close(self) -> None:
        pass


def replay_decisions(log: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """operation_id and decision (execute, replay, or reject for another hash) of a stream of
    (operation_id, actor_id, idempotency_key, request_hash, started_at); keys are forgotten after
    ``days``. The twin of ``changes.replays``."""
    rows = log.withWatermark("started_at", late).select("operation_id", "actor_id", "idempotency_key", "request_hash", "started_at", F.unix_millis("started_at").alias("at_ms"))
    schema = StructType([StructField("operation_id", LongType()), StructField("decision", StringType())])
    return rows.groupBy("actor_id", "idempotency_key").transformWithStateInPandas(_Replay(days), schema, "Append", "EventTime")


class _Expiry(StatefulProcessor):
    """Reports a clarification as open when it is asked, as expired when its time is over, and as gone
    when it is removed."""

    def __init__(self, minutes: int, days: int):
        self.minutes, self.days = minutes, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", StructType([StructField("at", LongType()), StructField("expired", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = min(int(part.asked_ms.min()) for part in rows)
        if not self.asked.exists():
            self.asked.update((first, 0))
            self.handle.registerTimer(first + self.minutes * 60_000)
            yield pd.DataFrame({"request_id": [str(key[0])], "state": ["open"]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        first, expired = self.asked.get()
        if expired:
            self.asked.clear()
        else:
            self.asked.update((first, 1))
            self.handle.registerTimer(first + self.days * 86_400_000)
        yield pd.DataFrame({"request_id": [str(key[0])], "state": ["gone" if expired else "expired"]})

    def close(self) -> None:
        pass


def clarification_states(requests: DataFrame, minutes: int = 30, days: int = 7) -> DataFrame:
    """request_id and state (open, later expired, then gone) of a stream of (request_id, created_at).
    The twin of ``changes.expired``."""
    rows = requests.withWatermark("created_at", "1 minute").select(F.col("request_id").cast("string").alias("request_id"), "created_at", F.unix_millis("created_at").alias("asked_ms"))
    schema = StructType([StructField("request_id", StringType()), StructField("state", StringType())])
    return rows.groupBy("request_id").transformWithStateInPandas(_Expiry(minutes, days), schema, "Append", "EventTime")
