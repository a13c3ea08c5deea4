"""Lookups between documents, clusters, scores and versions; all are joins on keys."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from corpusloom.functions.text import coarse_sentences
from corpusloom.operators import neighbours
from corpusloom.operators.ranking import numbered
from corpusloom.sources.staging import stored


def with_scores(items: DataFrame, scores: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """All items with their score; a missing one is minus infinity."""
    return items.join(scores.select(key, score), key, "left").withColumn(score, F.coalesce(F.col(score), F.lit(float("-inf"))))


def topic_scores(elements: DataFrame, clusters: DataFrame, probabilities: DataFrame) -> DataFrame:
    """doc_id, topic, percent for documents with a membership probability."""
    return elements.join(clusters, "cluster_id").join(probabilities, "doc_id").select("doc_id", "topic", (100 * F.col("prob")).alias("percent"))


def existing(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_semi")


def missing(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_anti")


def conflicts(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    """Keys of both frames whose field differs; two missing values differ too."""
    both = a.select(key, F.col(field).alias("left_value")).join(b.select(key, F.col(field).alias("right_value")), key)
    return both.filter(F.coalesce(F.col("left_value") != F.col("right_value"), F.lit(True)))


def resolved_references(rows: DataFrame, key: str, value: str, documents: DataFrame) -> DataFrame:
    """(key, doc_id, procedure_type, place): the numbers in a text that are document ids, in order."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(value), F.lit(r"(\d+)"), F.lit(1))).alias("place", "id"))
    return found.withColumn("doc_id", F.expr("try_cast(id as bigint)")).join(documents.select("doc_id", "procedure_type"), "doc_id").select(key, "doc_id", "procedure_type", "place")


def rekeyed(vectors: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """Vectors whose decision_type has a record_key (that of greatest `order`), with a new chunk_id."""
    last = names.groupBy("decision_type").agg(F.max_by("record_key", order).alias("record_key"))
    return vectors.join(last, "decision_type").withColumn("chunk_id", F.concat_ws("|", "record_key", "section", F.col("position").cast("string")))


def carried_scores(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores of a new version: those of the old by (old_id, new_id) pairs, and its own; none if either side is empty."""
    moved = pairs.join(old, pairs["old_id"] == old["doc_id"]).select(F.col("new_id").alias("doc_id"), "score")
    both = moved.select("doc_id", "score", F.lit(0).alias("side")).unionByName(new.select("doc_id", "score", F.lit(1).alias("side")))
    sides = old.limit(1).select(F.lit(0).alias("side")).union(new.limit(1).select(F.lit(1).alias("side"))).agg(F.count(F.lit(1)).alias("sides"))
    return both.crossJoin(F.broadcast(sides)).filter("sides = 2").select("doc_id", "score")


def nearest_points(points: DataFrame, selected: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(doc_id, neighbour, d2, place): for each selected document its k nearest others on the map, by distance, then number.

    Documents without a place on the map are no one's neighbours and have none.
    """
    placed = points.filter("pos_x is not null and pos_y is not null").select(F.col(key).alias("id"), F.array("pos_x", "pos_y").alias("p"))
    found = neighbours.nearest(neighbours.space_of(placed, 2), k, selected.select(F.col(key).alias("id")))
    return found.select(F.col("id").alias("doc_id"), "neighbour", "d2", "place")


def _common(a: str, b: str) -> int:
    """Characters of the longest common subsequence, with a bit for each character of `b`."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(b)) - 1
    row = whole
    for c in a:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


def _sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")), " ")


@F.pandas_udf(DoubleType())
def _ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([200.0 * _common(a, b) / n if (n := len(a) + len(b)) else 0.0 for a, b in zip(x, y, strict=True)])


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Likeness in percent of two texts with sorted words: 100 less the share of characters to put in or take out. Case counts."""
    return _ratio(_sorted_words(a), _sorted_words(b))


def fuzzy_sentences(sentences: DataFrame, targets: DataFrame, least: float = 65.0) -> DataFrame:
    """(doc_id, place, sentence, marked): marked if a target of the document is alike enough.

    Words are sorted once for each side; pairs whose lengths alone rule it out are not compared.
    """
    one = sentences.select("doc_id", "place", "sentence", _sorted_words(F.col("sentence")).alias("x"))
    two = targets.select("doc_id", _sorted_words(F.col("target")).alias("y")).distinct()
    size, other = F.length("x"), F.length("y")
    near = one.join(two, "doc_id").filter(200.0 * F.least(size, other) >= F.lit(least) * (size + other))
    hits = near.filter(_ratio("x", "y") >= least).select("doc_id", "place").distinct().withColumn("marked", F.lit(True))
    return one.select("doc_id", "place", "sentence").join(hits, ["doc_id", "place"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def highlighted_sentences(documents: DataFrame, targets: DataFrame, text: str = "text", colour: str = "#FFFF77", least: float = 65.0) -> DataFrame:
    """(doc_id, marked_text): coarse sentences joined by a blank, those like a target in a span."""
    parts = documents.select("doc_id", F.posexplode(coarse_sentences(F.col(text))).alias("place", "sentence"))
    shown = F.when(F.col("marked"), F.concat(F.lit(f'<span style="background-color: {colour}">'), "sentence", F.lit("</span>"))).otherwise(F.col("sentence"))
    rows = fuzzy_sentences(parts, targets, least).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("s")))).alias("parts"))
    joined = rows.select("doc_id", F.array_join(F.transform("parts", lambda x: x["s"]), " ").alias("marked_text"))
    return documents.select("doc_id").join(joined, "doc_id", "left").withColumn("marked_text", F.coalesce("marked_text", F.lit("")))


def zipped(one: DataFrame, two: DataFrame, by_one: str, by_two: str) -> DataFrame:
    """Rows of both at equal places of their orders (by keys that are unique); the longer one's rest is left out.

    The columns of `two` must have other names than those of `one`.
    """
    return numbered(one, by_one).join(numbered(two, by_two), "place").drop("place")


def first_by_type(documents: DataFrame) -> DataFrame:
    """(procedure_type, doc_id): the first document of each type."""
    return documents.groupBy("procedure_type").agg(F.min("doc_id").alias("doc_id"))
