"""Audit payloads (JSON objects) without secrets or, on request, free text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of keys that mark secrets, and keys of free text.
SECRET = ("password", "secret", "token", "authorization", "api_key", "apikey", "credential", "private_key")
TEXT = ("excerpt", "object_string", "description", "title")
GONE = "[REDACTED]"


def hides(name: str, value: Any, texts: bool) -> bool:
    """Whether the value under this (folded) key goes."""
    return any(x in name for x in SECRET) or (texts and name in TEXT and isinstance(value, str))


def redacted(value: Any, key: str = "", texts: bool = False) -> Any:
    """A copy of parsed JSON without what ``hides`` names. Open places are kept on a stack, so depth
    costs no recursion; items of a list stand under the list's key."""
    out = [value]
    places: list[tuple[Any, Any, str]] = [(out, 0, key.casefold())]
    while places:
        held, at, name = places.pop()
        found = held[at]
        if hides(name, found, texts):
            held[at] = GONE
        elif isinstance(found, dict):
            held[at] = dict(found)
            places += [(held[at], k, k.casefold()) for k in found]
        elif isinstance(found, list):
            held[at] = list(found)
            places += [(held[at], k, name) for k in range(len(found))]
    return out[0]


def redact(df: DataFrame, column: str, mode: str) -> DataFrame:
    """df with the JSON objects of ``column`` redacted: ``full`` takes secrets only, ``redacted`` free
    text too, ``none`` everything. What is no JSON object becomes null."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None and mode != "none" else None
        except ValueError:
            value = None
        return json.dumps(redacted(value, texts=mode == "redacted"), separators=(",", ":"), ensure_ascii=False) if isinstance(value, dict) else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part[column] = [one(x) for x in part[column]]
            yield part

    return df.mapInPandas(run, df.schema)


def public(payload: Column) -> Column:
    """A payload (map) without internal keys, which begin with an underscore."""
    return F.map_filter(payload, lambda k, v: ~k.startswith("_"))
