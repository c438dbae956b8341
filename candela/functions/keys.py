"""Deterministic keys, fingerprints and pair orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "~"


def marked(column: Column) -> Column:
    """A value as text, null as a mark no value has alone."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(NULL_MARK))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over the columns with explicit nulls."""
    return F.sha2(marked_text(*columns), 256)


def marked_text(*columns: Column) -> Column:
    """The text whose digest is the columns' fingerprint; shorter than that for short values, and equal just when it is."""
    return F.concat_ws("|", *[marked(c) for c in columns])


def semantic_key(subject: Column, relation: Column, obj: Column, valid_from: Column, valid_to: Column) -> Column:
    """the identity of a fact, whatever source states it."""
    return fingerprint(subject, relation, obj, valid_from, valid_to)


def packed(column: Column) -> Column:
    """A text as bytes, a digest in half its room; equal just when the texts are."""
    text = column.cast("string")
    return F.when(text.rlike("^[0-9a-f]{64}\\z"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(column: Column) -> Column:
    """The text that was packed."""
    rest = F.substring(column, 2, 2**31 - 1)
    return F.when(F.substring(column, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """two ids in order of their text."""
    return F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string"))
