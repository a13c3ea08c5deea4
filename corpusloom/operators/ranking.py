"""Orders, pages, representatives, topic ranks; every order ends with a key, so ties are settled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.staging import stored

NOISE_TOPIC = "unclassified papers"


def by_date(rows: DataFrame, day: str, descending: bool, key: str = "doc_id") -> DataFrame:
    """Missing dates are the latest of all."""
    return rows.orderBy(F.col(day).desc_nulls_first() if descending else F.col(day).asc_nulls_last(), key)


def page(rows: DataFrame, number: int, order: list[Column], size: int = 30, total: int | None = None) -> DataFrame:
    """One page of ordered rows; the number is drawn into the range that exists."""
    total = rows.count() if total is None else total
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds `place`: 0 for the row of least key, and so on.

    Rows are dealt by ranges of the key and written; a row's number is its place in its range plus
    the rows of the ranges before, whose counts are one small table.
    """
    dealt = stored(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("_before")
    # One row for each range, so never many.
    return dealt.join(F.broadcast(before), "_part").withColumn("place", place).drop("_part", "_before")


def batches(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Adds `batch`: consecutive groups of `size` keys."""
    if size <= 0:
        raise ValueError("a batch has at least one row")
    return numbered(rows, key).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def top_per_group(rows: DataFrame, group: str, score: str, n: int, key: str = "doc_id") -> DataFrame:
    """The n best of each group; windows with a rank limit are cut before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def representatives(elements: DataFrame) -> DataFrame:
    """The document nearest to each cluster's centre."""
    middle = elements.groupBy("cluster_id").agg(F.avg("pos_x").alias("cx"), F.avg("pos_y").alias("cy"))
    d = F.sqrt(F.pow(F.col("pos_x") - F.col("cx"), F.lit(2)) + F.pow(F.col("pos_y") - F.col("cy"), F.lit(2)))
    best = elements.join(middle, "cluster_id").groupBy("cluster_id").agg(F.min(F.struct(d.alias("distance"), F.col("doc_id"))).alias("best"))
    return best.select("cluster_id", F.col("best.doc_id").alias("doc_id"), F.col("best.distance").alias("distance"))


def cluster_order(clusters: DataFrame) -> DataFrame:
    """Rank of clusters (project_id, cluster_id, topic, n) by size, then topic; noise has -1."""
    noise = F.col("topic") == NOISE_TOPIC
    w = Window.partitionBy("project_id", noise).orderBy(F.desc("n"), "topic", "cluster_id")
    return clusters.withColumn("order", F.when(noise, -1).otherwise(F.row_number().over(w)))


def topic_labels(tfidf: DataFrame, elements: DataFrame, terms: int = 30) -> DataFrame:
    """topic of each cluster: its terms of greatest mean weight, where missing terms weigh 0."""
    sizes = elements.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    sums = tfidf.join(elements, "doc_id").filter("cluster_id != -1").groupBy("cluster_id", "term").agg(F.sum("tfidf").alias("total"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "term")
    ranked = sums.join(sizes, "cluster_id").select("cluster_id", "term", F.round(F.col("total") / F.col("size"), 9).alias("weight"))
    ranked = ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= terms)
    named = ranked.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    named = named.select("cluster_id", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("topic"))
    noise = elements.filter("cluster_id = -1").select("cluster_id", F.lit(NOISE_TOPIC).alias("topic")).distinct()
    return named.unionByName(noise)


def in_order(projects: DataFrame, ids: Sequence[int], key: str = "project_id") -> DataFrame:
    """The projects of a list of ids, in the list's order."""
    place = F.array_position(F.array(*[F.lit(i) for i in dict.fromkeys(ids)]), F.col(key))
    return projects.filter(F.col(key).isin(*ids)).orderBy(place) if ids else projects.limit(0)


def by_history(projects: DataFrame, counts: DataFrame, descending: bool) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0))
    rows = projects.join(counts, "project_id", "left").withColumn("n", n)
    return rows.orderBy(F.desc("n") if descending else F.asc("n"), "project_id")


def supporting_types(support: DataFrame, documents: DataFrame, whole: int, most: int = 3) -> DataFrame:
    """For each consideration (rows of consideration, frequency, doc_id) its percent and the procedure
    types of its first documents; documents without type do not count."""
    named = support.join(documents.filter("procedure_type is not null").select("doc_id", "procedure_type"), "doc_id")
    first = top_per_group(named.withColumn("_first", -F.col("doc_id")), "consideration", "_first", most)
    types = first.groupBy("consideration").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "procedure_type"))), lambda x: x["procedure_type"]).alias("types"))
    percent = F.bround(100.0 * F.col("frequency") / F.lit(max(whole, 1)), 1)
    rows = support.select("consideration", "frequency").distinct().join(types, "consideration", "left")
    return rows.select("consideration", percent.alias("percent"), F.coalesce("types", F.array(F.lit("Inconnu"))).alias("types"))


def answer_table(answers: DataFrame, facets: dict[str, str], needle: str, order: str, descending: bool) -> DataFrame:
    """Valid answers, equal in all facets, with the text somewhere, in order; missing scores count as 0."""
    fields = [c for c in ("procedure_type", "decision_type", "citation", "answer", "language") if c in answers.columns]
    rows = answers.filter(F.col("valid"))
    for k, v in facets.items():
        rows = rows.filter(F.col(k) == v)
    if needle:
        rows = rows.filter(F.lower(F.concat_ws(" ", *fields)).contains(needle.lower()))
    by = F.coalesce(F.col(order), F.lit(0.0) if order == "confidence_score" else F.lit(""))
    return rows.orderBy(by.desc() if descending else by.asc(), "doc_id")


def order_key(order: str, has_scores: bool) -> str:
    """The order asked for, or the latest first where relevance is asked for and there is none."""
    known = {"score": "-score", "-score": "-score", "date": "decision_date", "-date": "-decision_date", "decision_date": "decision_date", "-decision_date": "-decision_date"}
    key = known.get(order, "-decision_date")
    return "-decision_date" if key == "-score" and not has_scores else key


def top_documents(docs: DataFrame, scores: DataFrame | None, n: int = 10, keep_without: bool = True) -> DataFrame:
    """The n best documents; without scores the first n, or none."""
    if scores is None:
        return docs.orderBy("doc_id").limit(n if keep_without else 0)
    return docs.join(scores.select("doc_id", "score"), "doc_id", "left").orderBy(F.col("score").desc_nulls_last(), "doc_id").limit(n)


def facet_values(answers: DataFrame, column: str) -> DataFrame:
    """Distinct values of valid answers, sorted."""
    return answers.filter("valid").select(F.col(column).alias("value")).filter("value is not null").distinct().orderBy("value")


def by_percent(considerations: Column) -> Column:
    """An array of structs with `percent`, the greatest first; equals keep their order."""
    placed = F.transform(considerations, lambda x, i: F.struct((-x["percent"]).alias("p"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda s: s["x"])


def by_term(docs: DataFrame, weights: DataFrame, term: str) -> DataFrame:
    """Documents by the weight of a term, those without it last."""
    own = weights.filter(F.col("term") == term).select("doc_id", "tfidf")
    return docs.join(own, "doc_id", "left").orderBy(F.col("tfidf").desc_nulls_last(), "doc_id")
