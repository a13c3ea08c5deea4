"""Counts and summaries; every share is guarded against an empty whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.phrases import pair_counts
from corpusloom.sources.staging import stored

NOISE = -1


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent, rounded half to even; 0 of an empty whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def cluster_counts(clusters: DataFrame, elements: DataFrame) -> DataFrame:
    """Documents of each cluster; an empty cluster has 0."""
    return clusters.join(elements, "cluster_id", "left").groupBy("cluster_id").agg(F.count("doc_id").alias("n"))


def centroids(elements: DataFrame) -> DataFrame:
    return elements.groupBy("cluster_id").agg(F.avg("pos_x").alias("mean_x"), F.avg("pos_y").alias("mean_y"), F.count("doc_id").alias("n"))


def selection_counts(choice: DataFrame) -> DataFrame:
    """chosen, initial, neighbours (visible, not initial), visible, in one pass."""
    shown = F.col("to_display")
    return choice.agg(
        F.count_if(F.col("is_check")).alias("chosen"),
        F.count_if(F.col("is_initial")).alias("initial"),
        F.count_if(shown & ~F.col("is_initial")).alias("neighbours"),
        F.count_if(shown).alias("visible"),
    )


def term_counts(rows: DataFrame, key: str, values: Column, limit: int = 1000) -> DataFrame:
    """Documents, not items, for each value of an array; the most frequent first."""
    items = rows.select(key, F.explode(values).alias("value")).distinct()
    return items.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def distinct_keys(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.countDistinct(F.nullif(F.col(column), F.lit(""))).alias("n"))


def token_lengths(rows: DataFrame, text: str, tokens: Column) -> DataFrame:
    """Longest and number of texts that are not blank; `tokens` counts a text's tokens."""
    return rows.filter(F.coalesce(F.trim(text), F.lit("")) != "").agg(F.max(tokens).alias("longest"), F.count(F.lit(1)).alias("n"))


def median(rows: DataFrame, value: str) -> DataFrame:
    """One row with the exact `median` of the values that are not null; null if there are none.

    Equal values are one row; those are dealt by range and numbered by running counts, range by
    range, so no task holds all of them.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    dealt = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("part").agg(F.sum("c").alias("size"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    placed = dealt.join(F.broadcast(parts), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return placed.agg(((at(low) + at(high)) / 2).alias("median"))


def score_summary(rows: DataFrame, score: str, threshold: float, digits: int = 3) -> DataFrame:
    """mean, median, sample deviation (0 for one row), percent at or above a threshold."""
    s = F.col(score)
    plain = rows.agg(
        F.bround(F.avg(s), digits).alias("mean"),
        F.bround(F.coalesce(F.stddev_samp(s), F.lit(0.0)), digits).alias("deviation"),
        F.bround(100 * F.avg((s >= threshold).cast("int")), 2).alias("percent"),
    )
    return plain.crossJoin(median(rows, score)).select("mean", F.bround("median", digits).alias("median"), "deviation", "percent")


POLAR = ("oui", "non", "peut_etre", "mixte")


def polar_answers(rows: DataFrame, label: str, labels: tuple[str, ...] = POLAR) -> DataFrame:
    """Counts and percent of fixed labels; other labels count in the whole."""
    whole = F.count(F.lit(1))
    count = lambda x: F.count_if(F.col(label) == x)
    return rows.agg(*[count(x).alias(f"n_{x}") for x in labels], *[share(count(x), whole).alias(f"p_{x}") for x in labels], whole.alias("total"))


def consideration_support(rows: DataFrame) -> DataFrame:
    """From (doc_id, consideration, supported): (consideration, frequency, doc_id), a row for each supporting
    document, and one without for a consideration that none supports."""
    frequency = rows.groupBy("consideration").agg(F.count_if("supported").alias("frequency"))
    support = rows.filter("supported").select("consideration", "doc_id").distinct()
    return frequency.join(support, "consideration", "left")


def valid_scores(rows: DataFrame, score: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(score).isNotNull() & (F.col(score) != 0)).alias("n"))


def valid_sections(rows: DataFrame, answer: str, sections: tuple[str, ...]) -> DataFrame:
    """Answers that are JSON objects with something in one of the sections."""
    parsed = F.try_parse_json(F.col(answer))
    filled = F.lit(False)
    for s in sections:
        value = F.try_variant_get(parsed, f"$.{s}", "string")
        filled = filled | (F.coalesce(value, F.lit("")).isin("", "[]", "{}", "null") == F.lit(False))
    return rows.agg(F.count_if(F.coalesce(filled, F.lit(False))).alias("n"))


def progress(done: Column, whole: Column) -> Column:
    """Whole percent, cut off; 0 if there is nothing to do."""
    return F.when(whole > 0, (100.0 * done / whole).cast("int")).otherwise(F.lit(0))


def processed_documents(documents: Column, clustered: Column, least: Column, unclustered_source: Column) -> Column:
    return F.when((documents < least) | unclustered_source, documents).otherwise(clustered)


def noise_summary(elements: DataFrame) -> DataFrame:
    """Noise documents, their percent, and clusters without noise."""
    c = F.col("cluster_id")
    noise, whole = F.count_if(c == NOISE), F.count(F.lit(1))
    return elements.agg(noise.alias("noise"), share(noise, whole).alias("percent"), F.countDistinct(F.nullif(c, F.lit(NOISE))).alias("clusters"))


def corpus_counts(tokens: DataFrame) -> DataFrame:
    """(term, n) of a frame of token arrays."""
    return tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(tokens: DataFrame) -> DataFrame:
    """(size, a, b, n): counts of words (size 1, without b), of pairs (size 2), and of all of either size (without a and b), by one pass."""
    pairs = stored(pair_counts(tokens), "pairs")
    words = pairs.groupBy("a").agg(F.sum("n").alias("n")).select(F.lit(1).alias("size"), "a", F.lit(None).cast("string").alias("b"), "n")
    both = words.unionByName(pairs.filter("b is not null").select(F.lit(2).alias("size"), "a", "b", "n"))
    none = F.lit(None).cast("string")
    return both.unionByName(both.groupBy("size").agg(F.sum("n").alias("n")).select("size", none.alias("a"), none.alias("b"), "n"))
