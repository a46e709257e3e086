"""Keys, hashes and locators that identify things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgraph.functions.text import normal


def object_key(kind: Column, entity: Column, string: Column, number: Column) -> Column:
    """Identity of a statement's object: kind and normal value."""
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(kind == "entity", F.concat(F.lit("entity:"), entity))
        .when(kind == "string", F.concat(F.lit("string:"), normal(string)))
        .when(kind == "number", F.concat(F.lit("number:"), plain))
    )


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; a missing part is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def locator(revision: Column, start: Column, end: Column, heading: Column) -> Column:
    """rev:<id>, with #heading:... and offsets:... where given."""
    offsets = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("offsets:"), start.cast("string"), F.lit("-"), end.cast("string")))
    named = F.when(heading != "", F.concat(F.lit("heading:"), heading))
    more = F.concat_ws("/", named, offsets)
    return F.concat(F.lit("rev:"), revision.cast("string"), F.when(more == "", "").otherwise(F.concat(F.lit("#"), more)))


def confidence(value: Column) -> Column:
    """Four decimal places, half to even; null outside 0 to 1."""
    rounded = F.bround(value, 4)
    return F.when(rounded.between(0, 1), rounded)
