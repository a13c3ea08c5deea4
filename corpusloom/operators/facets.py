"""Faceted set algebra: union groups (OR within a facet, AND across facets), minus exclude groups.

A filter payload maps group names to facets to values: names that contain `filter-union` are
united, names that contain `filter-exclude` are taken out. A facet that nothing matches is ignored
inside its group instead of emptying it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import AFTER, BEFORE, multi_values

Facet = Callable[[str], Column]
NO_RESULT = "NO RESULT"
NOISE_TOPIC = "unclassified papers"


def parse_payload(posted: Mapping[str, str]) -> dict[str, dict[str, list[str]]]:
    """Groups of a form: keys that contain `filter`, values that are JSON objects and not empty."""
    out = {}
    for key, value in posted.items():
        if "filter" not in key:
            continue
        try:
            group = json.loads(value)
        except (TypeError, ValueError):
            continue
        if isinstance(group, dict) and group:
            out[key] = group
    return out


def payload_from_client(chosen: Sequence[tuple[str, str, str, int]]) -> dict[str, dict[str, list[str]]]:
    """Groups from (mode, field, value, group number) in the order chosen."""
    out: dict[str, dict[str, list[str]]] = {}
    for mode, field, value, group in chosen:
        out.setdefault(f"filter-{mode}-{group}", {}).setdefault(field, []).append(value)
    return out


def pattern(column: str) -> Facet:
    """Values are patterns, whatever their case; not escaped, so `LPAC.20` also fits `LPAC-20`."""
    return lambda v: F.coalesce(F.col(column).rlike("(?i)" + v), F.lit(False))


def equals(column: str) -> Facet:
    return lambda v: F.coalesce(F.col(column) == v, F.lit(False))


def result(column: str) -> Facet:
    return lambda v: F.coalesce(F.col(column) == ("" if v == NO_RESULT else v), F.lit(False))


def years(column: str) -> Facet:
    """`2020` or `2017-2022`, both years included."""

    def predicate(v: str) -> Column:
        first, _, last = v.partition("-")
        lo, hi = int(first), int(last or first)
        return F.coalesce(F.col(column).between(F.make_date(F.lit(lo), F.lit(1), F.lit(1)), F.make_date(F.lit(hi), F.lit(12), F.lit(31))), F.lit(False))

    return predicate


def topic(column: str) -> Facet:
    """The noise topic by name; others by what follows the last `: `, whatever its case."""

    def predicate(v: str) -> Column:
        found = F.col(column) == v if v == NOISE_TOPIC else F.lower(F.col(column)).contains(v.rsplit(": ", 1)[-1].lower())
        return F.coalesce(found, F.lit(False))

    return predicate


def filtered(docs: DataFrame, filters: Mapping[str, Mapping[str, Sequence[str]]], facets: Mapping[str, Facet], key: str = "doc_id", base: Column | None = None, clustered: Column | None = None, free: Sequence[str] = ("Topic",)) -> DataFrame:
    """The rows of `docs` that the payload selects. Without a union group the rows of `base` (all) count.

    Where only clustered documents count, give `clustered`, a condition: all facets but the `free` ones are bound to it.

    Whether a facet matches anything is one aggregate over the documents; the rest is a filter.
    """
    rows = docs
    union, gone = [], []
    names: list[str] = []
    for group, chosen in filters.items():
        flags = []
        for facet, values in chosen.items():
            name = f"_f{len(names)}"
            names.append(name)
            hit = reduce(Column.__or__, [facets[facet](v) for v in values], F.lit(False))
            rows = rows.withColumn(name, hit if clustered is None or facet in free else hit & F.coalesce(clustered, F.lit(False)))
            flags.append(name)
        if "filter-union" in group:
            union.append(flags)
        elif "filter-exclude" in group:
            gone += flags
    any_of = lambda cols, start: reduce(Column.__or__, cols, F.lit(start))
    if union:
        wanted = [n for flags in union for n in flags]
        alive = rows.agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(f"{n}_any") for n in wanted])
        rows = rows.crossJoin(F.broadcast(alive))
        groups = []
        for flags in union:
            met = reduce(Column.__and__, [F.col(n) | ~F.col(f"{n}_any") for n in flags], F.lit(True))
            groups.append(met & any_of([F.col(f"{n}_any") for n in flags], False))
        rows = rows.filter(any_of(groups, False)).drop(*[f"{n}_any" for n in wanted])
    elif base is not None:
        rows = rows.filter(base)
    if gone:
        rows = rows.filter(~any_of([F.col(n) for n in gone], False))
    return rows.drop(*names)


def with_clusters_only(docs: DataFrame, elements: DataFrame, least: int, finished: bool) -> DataFrame:
    """Base rows without a union: all while there are few or clustering runs, else those with a cluster."""
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    clustered = elements.select("doc_id").distinct().withColumn("_in", F.lit(True))
    rows = docs.join(clustered, "doc_id", "left").crossJoin(F.broadcast(n))
    return rows.filter((F.col("_n") < least) | F.lit(not finished) | F.col("_in")).drop("_in", "_n")


def options(docs: DataFrame, column: str) -> DataFrame:
    """Distinct values of a `;`-list column, sorted."""
    rows = docs.filter(F.coalesce(F.trim(column), F.lit("")) != "")
    return rows.select(F.explode(multi_values(F.col(column))).alias("value")).distinct().orderBy("value")


def rendered(filters: Mapping[str, Mapping[str, Sequence[str]]], emphasis: tuple[str, str] = ("<b>", "</b>")) -> tuple[str, str]:
    """The union groups and the exclude groups of a payload in words, as they are shown.

    Values are named by their facet; topics by their number, with their words as a tooltip.
    Groups are `(a AND b) OR (c)`, what is excluded `(x OR y)`, for each exclude group.
    """
    tips: dict[str, str] = {}

    def named(facet: str, value: str) -> str:
        if facet != "Topic":
            return f"{facet}: {value}"
        number, _, words = value.partition(": ")
        name = value if value == NOISE_TOPIC else f"Topic {number}"
        tips[name] = value if value == NOISE_TOPIC else words.split(": ")[0]
        return name

    def groups(kind: str, word: str) -> list[str]:
        own = [g for name, g in filters.items() if kind in name and not (kind == "exclude" and "union" in name)]
        return ["(" + _said(word, emphasis).join(named(f, v) for f, vs in g.items() for v in vs) + ")" for g in own]

    union, gone = _said("OR", emphasis).join(groups("union", "AND")), _said("OR", emphasis).join(groups("exclude", "OR"))
    return with_tips(union, tips), with_tips(gone, tips)


def _said(word: str, emphasis: tuple[str, str]) -> str:
    return f"{emphasis[0]} {word} {emphasis[1]}"


#: Fixed value: the span that a word with a tooltip is put in.
TIP = '<span data-toggle="tooltip" data-placement="bottom" title="{tip}">{word}</span>'


def with_tips(text: str, tips: Mapping[str, str]) -> str:
    """Words, whatever their case, with a tooltip each: one pass over the text, longer words first."""
    known = {word.lower(): tip for word, tip in tips.items()}
    if not known:
        return text
    words = "|".join(re.escape(w) for w in sorted(known, key=len, reverse=True))
    cut = re.split(f"{BEFORE}({words}){AFTER}", text, flags=re.I)
    cut[1::2] = [TIP.format(tip=known[w.lower()], word=w) for w in cut[1::2]]
    return "".join(cut)
