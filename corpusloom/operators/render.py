"""Rows as they are shown: excerpts with highlights, topic options, scatter data, citations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import highlighted, highlighted_by_row, topic_label
from corpusloom.operators.clustering import NOISE_COLOUR
from corpusloom.operators.stats import centroids


def rendered_rows(choice: DataFrame, docs: DataFrame, topics: DataFrame, words: Sequence[str], scores: DataFrame | None = None, length: int = 800, marked: int = 10) -> DataFrame:
    """Visible rows with an excerpt, topic label, colour and scores.

    topics: (doc_id, topic, order, colour). In the excerpt the query's words are marked, then the
    first `marked` words of the document's topic in its colour, but for the noise topic. A document
    without topic has no row, nor has one whose topic has neither words nor the noise's name.
    """
    rows = choice.filter("to_display").join(docs.select("doc_id", "text"), "doc_id").join(topics.select("doc_id", "topic", "order", "colour"), "doc_id")
    rows = rows.filter((F.col("topic") != "") | (F.col("order") < 0))
    if scores is not None:
        rows = rows.join(scores.select("doc_id", "score"), "doc_id", "left")
    own = F.when(F.col("order") >= 0, F.slice(F.split("topic", ", "), 1, marked)).otherwise(F.array().cast("array<string>"))
    excerpt = highlighted_by_row(highlighted(F.substring("text", 1, length), words, "query"), own, F.col("colour"))
    return rows.withColumn("excerpt", excerpt).withColumn("label", topic_label(F.col("topic"), F.col("order"))).drop("text")


def topic_options(clusters: DataFrame, words: int = 10) -> DataFrame:
    """(value, title): noise keeps its name, others are `n: first words`; noise comes last."""
    first = F.array_join(F.slice(F.split("topic", ", "), 1, words), ", ")
    value = F.when(F.col("order") < 0, F.col("topic")).otherwise(F.concat(F.col("order").cast("string"), F.lit(": "), first))
    return clusters.select(value.alias("value"), F.col("topic").alias("title"), "order").orderBy(F.col("order") < 0, "order").drop("order")


def coloured(clusters: DataFrame) -> DataFrame:
    """Clusters (topic, order, ...) with `colour`: hues evenly around the wheel by order, grey for the noise topic."""
    n = clusters.agg(F.count_if(F.col("order") >= 0).alias("_n"))
    hue = (F.col("order") - 1) / F.greatest("_n", F.lit(1))
    # A saturated colour of even lightness: each channel is a wave, a third of the wheel apart.
    channel = lambda shift: F.lpad(F.lower(F.hex(F.round(F.lit(127.5) + 83 * F.cos((hue - F.lit(shift)) * F.lit(2 * math.pi))).cast("int"))), 2, "0")
    colour = F.when(F.col("order") < 0, F.lit(NOISE_COLOUR)).otherwise(F.concat(F.lit("#"), channel(0.0), channel(1 / 3), channel(2 / 3)))
    return clusters.crossJoin(F.broadcast(n)).withColumn("colour", colour).drop("_n")


def scatter(elements: DataFrame, docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """A point, its document and its cluster's topic and colour. clusters: (cluster_id, topic, order)."""
    named = coloured(clusters).select("cluster_id", "topic", "colour")
    return elements.join(named, "cluster_id").join(docs.select("doc_id", "source", "lang"), "doc_id")


def centre_labels(elements: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, mean_x, mean_y, label, colour): what is written at a cluster's centre, without noise."""
    named = coloured(clusters).filter("order >= 0").select("cluster_id", "order", "colour")
    return centroids(elements).join(named, "cluster_id").select("cluster_id", "mean_x", "mean_y", F.concat(F.lit("Topic "), F.col("order").cast("string")).alias("label"), "colour")


def citation_text(header: Column, sections: Mapping[str, Column], quote: Column) -> Column:
    """Header, `label : text` lines and the quotation; blank parts are left out."""
    line = lambda label, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{label} : "), c))
    quoted = F.when(F.coalesce(F.trim(quote), F.lit("")) != "", F.concat(F.lit("« "), quote, F.lit(" »")))
    return F.concat_ws("\n", F.when(F.coalesce(F.trim(header), F.lit("")) != "", header), *[line(k, v) for k, v in sections.items()], quoted)


def chunk_prompt(chunks: Column) -> Column:
    """All chunks with their numbers, for a model that sorts them."""
    return F.array_join(F.transform(chunks, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")
