"""Text expressions with the Unicode behaviour that the rules assume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def delete_all(c: Column, patterns: Sequence[str], by: str = "") -> Column:
    """Each pattern in turn, on what the ones before left."""
    for p in patterns:
        c = F.regexp_replace(c, p, by)
    return c


def masked_delete(c: Column, patterns: Sequence[str], by: str = " ") -> Column:
    """Each pattern in turn, but only where the untouched text matches it."""
    if not patterns:
        return c
    return F.aggregate(F.array(*map(F.lit, patterns)), c, lambda acc, p: F.when(F.regexp_like(c, p), F.regexp_replace(acc, p, F.lit(by))).otherwise(acc))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def members(c: Column) -> Column:
    """Values of a list written with ', '."""
    return F.split(c, ", ", -1)


def distinct_members(c: Column) -> Column:
    """A ', ' list without repeats, in order of first occurrence; null stays null."""
    return F.array_join(F.array_distinct(members(c)), ", ")
