"""Array columns that are worked on within their row, each in time that is linear in its length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once per row.

    An expression that a lambda names is evaluated anew for each element; a lambda's own
    variable is not.
    """
    return F.transform(F.array(value), body)[0]


def positions(n: Column) -> Column:
    """array(0, ..., n - 1); empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def counted(values: Column, value: str = "term", count: str = "tf") -> Column:
    """array<struct<value, count>> of the distinct values, sorted."""

    def of_sorted(s: Column) -> Column:
        first = F.filter(positions(F.size(s)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias(value), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("long").alias(count))))

    return let(F.array_sort(F.coalesce(values, F.array().cast("array<string>"))), of_sorted)


def placed(values: Column, value: str = "term", places: str = "places") -> Column:
    """array<struct<value, places>> of the distinct values, sorted, with the positions from 0 of each."""

    def of_sorted(s: Column) -> Column:
        first = F.filter(positions(F.size(s)), lambda i: (i == 0) | (F.get(s, i)["v"] != F.get(s, i - 1)["v"]))
        end = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(s))
        own = lambda p, e: F.transform(F.slice(s, p + 1, e - p), lambda x: x["i"])
        return let(first, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p)["v"].alias(value), own(p, end(at, j)).alias(places))))

    return let(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), of_sorted)
