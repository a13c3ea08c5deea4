"""Boolean search with relevance over a corpus of texts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import index_tokens
from corpusloom.plans import boolean

K1, B = 1.2, 0.75


def padded_tokens(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(index_tokens(text), " "), F.lit(" "))


def in_range(day: Column, begin: date | None, end: date | None) -> Column:
    """Inclusive at both ends; a null day is in no range."""
    out = F.lit(True)
    if begin is not None:
        out = out & (day >= F.lit(begin))
    if end is not None:
        out = out & (day <= F.lit(end))
    return out


def matching(corpus: DataFrame, query: str, begin: date | None = None, end: date | None = None, text: str = "text", day: str | None = None, legacy: bool = False) -> DataFrame:
    """Rows with text that match; the date range comes first, so it can reach the scan."""
    rows = corpus.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    if day is not None:
        rows = rows.filter(in_range(F.col(day), begin, end))
    if query == boolean.EVERYTHING:
        return rows
    node = boolean.build(query, legacy)
    return rows.withColumn("_padded", padded_tokens(F.col(text))).filter(boolean.compiled(node, F.col("_padded"))).drop("_padded")


#: The fields that a scan of the index gives.
FIELDS = (
    "id", "collector_name", "document_text", "procedure_type", "decision_type", "decision_date", "descriptors", "summary", "standards", "result", "record_key", "document", "language",
)


def scan(corpus: DataFrame, query: str, key: str = "id", text: str = "document_text", fields: Sequence[str] = FIELDS, slices: int = 1, **kw) -> DataFrame:
    """Scored hits with a scan's fields (those that the corpus has) and `slice`, a number below `slices` by hash of the key."""
    rows = corpus.select(*[c for c in fields if c in corpus.columns])
    return scored(rows, query, key=key, text=text, **kw).withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))


def count_matching(corpus: DataFrame, query: str, **kw) -> DataFrame:
    return matching(corpus, query, **kw).agg(F.count(F.lit(1)).alias("n"))


def preview(corpus: DataFrame, query: str, least: int = 20, **kw) -> DataFrame:
    """total, can_cluster (enough documents), can_continue (any)."""
    n = F.col("n")
    return count_matching(corpus, query, **kw).select(n.alias("total"), (n >= least).alias("can_cluster"), (n > 0).alias("can_continue"))


def _term_frequency(tokens: Column, padded: Column, term: list[str]) -> Column:
    if len(term) == 1:
        return F.size(F.filter(tokens, lambda t: t == term[0]))
    # The blank behind a phrase is left for one that begins there.
    return F.size(F.split(padded, " " + " ".join(term) + "(?= )")) - 1


def scored(corpus: DataFrame, query: str, key: str = "doc_id", text: str = "text", legacy: bool = False, **kw) -> DataFrame:
    """Hits with `score`: the sum of BM25 over the query's words and phrases outside of NOT.

    Document frequencies and the mean length come from one aggregate of the corpus, a single
    row; no postings are shuffled.
    """
    terms = [] if query == boolean.EVERYTHING else [t for t in {tuple(t): t for t in boolean.scoring_terms(boolean.build(query, legacy))}.values() if t]
    rows = corpus.filter(F.col(text).isNotNull() & (F.col(text) != ""))

    def counted(df: DataFrame) -> DataFrame:
        df = df.withColumn("_tokens", index_tokens(F.col(text))).withColumn("_length", F.size("_tokens"))
        padded = F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" "))
        return df.withColumns({f"_tf{i}": _term_frequency(F.col("_tokens"), padded, t) for i, t in enumerate(terms)}).drop("_tokens")

    stats = counted(rows.select(text)).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))]
    )
    hits = counted(matching(corpus, query, text=text, legacy=legacy, **kw)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
    made = ["_length", "_n", "_mean", *[f"_tf{i}" for i in range(len(terms))], *[f"_df{i}" for i in range(len(terms))]]
    return hits.withColumn("score", score).drop(*made)


def top(scores: DataFrame, n: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The n best, the least key first among equals; missing scores come last."""
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(n)


def history(projects: DataFrame, words: list[str]) -> DataFrame:
    """Projects whose query has every word; words are patterns, whatever their case."""
    for w in words:
        projects = projects.filter(F.col("query").rlike("(?i)" + w))
    return projects
