"""Predicates and coercions on single columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def as_text(value: Column) -> Column:
    """Null is the empty text, anything else its text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def fits(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike("(?i)" + pattern), F.lit(False))


def holds(value: Column, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(value), F.lit(part.lower())), F.lit(False))


def one_of(value: Column, values: Sequence) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False))


def year_range(text: str) -> tuple[date, date]:
    """`2020` or `2017-2022` as first and last day."""
    first, _, last = text.partition("-")
    return date(int(first), 1, 1), date(int(last or first), 12, 31)


def visible(owner: Column, project: Column, user: int, shared: Sequence[int]) -> Column:
    """Own projects and shared ones."""
    return (owner == user) | (project.isin(*shared) if shared else F.lit(False))
