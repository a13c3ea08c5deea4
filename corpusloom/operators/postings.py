"""A stored index of words with their places, and boolean search with relevance that reads a query's words only.

Documents are dealt to zones by hash of their key, some thousands each. One row of the index holds a
word's documents in one zone: how often and where it occurs in each, and the greatest share of its
weight that any of them reaches. A zone is one file, whose rows are sorted by word, so a query's filter
prunes its pages; counts and bounds are read without the places. The k best hits are looked for in the zones
whose bounds are greatest, and then in those alone whose bounds reach the k-th best so far.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import placed
from corpusloom.functions.text import index_tokens
from corpusloom.operators.search import K1, B, in_range
from corpusloom.plans import boolean

#: Documents of a zone, on average.
ZONE = 4096


@dataclass(frozen=True)
class Index:
    #: term, zone, n (documents), best (greatest share of a weight), held: array<struct<id, tf, length, places>> by id.
    postings: DataFrame
    #: id, zone, length, and the columns that were kept.
    docs: DataFrame
    n: int
    mean: float
    zones: int


def write_index(corpus: DataFrame, path: str, key: str = "doc_id", text: str = "text", kept: Sequence[str] = (), zone: int = ZONE) -> Index:
    """The index of all rows of `corpus` with text, below `path`; keys are numbers and not null, `kept` columns stay beside them."""
    spark = corpus.sparkSession
    rows = corpus.filter(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull())
    zones = max(1, -(-rows.count() // zone))
    own = rows.select(F.col(key).cast("long").alias("id"), index_tokens(F.col(text)).alias("tokens"), *kept)
    own = own.withColumn("zone", F.pmod(F.xxhash64("id"), F.lit(zones))).withColumn("length", F.size("tokens"))
    own.drop("tokens").write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).withColumn("zones", F.lit(zones))
    stats.write.parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").head()["mean"]
    # Texts are dealt to their zones, and nothing else is: a zone's words are grouped inside the task that holds its texts.
    dealt = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("zone", F.pmod(F.xxhash64("id"), F.lit(zones)).cast("int")).repartitionById(zones, "zone")
    words = dealt.select("id", "zone", index_tokens(F.col("text")).alias("tokens")).select("id", "zone", F.size("tokens").alias("length"), F.explode(placed(F.col("tokens"))).alias("w"))
    each = words.select("id", "zone", "length", "w.term", "w.places")
    tf = F.size("places")
    share = tf / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    held = F.array_sort(F.collect_list(F.struct("id", tf.alias("tf"), "length", "places"))).alias("held")
    table = each.groupBy("zone", "term").agg(F.count(F.lit(1)).alias("n"), F.max(share).alias("best"), held)
    ordered = table.select("term", F.col("zone").cast("long").alias("zone"), "n", "best", "held").sortWithinPartitions("zone", "term")
    ordered.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").head()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), stats["n"], stats["mean"], stats["zones"])


def _words(node: boolean.Node) -> list[list[str]]:
    """Words and phrases of the whole tree, those below NOT too."""
    if isinstance(node, boolean.Word):
        words = boolean.analyzed(node.value)
        return [words] if '"' in node.value and words else [[w] for w in words]
    children = (node.child,) if isinstance(node, boolean.Not) else node.children
    return [t for x in children for t in _words(x)]


def _holds(node: boolean.Node, has) -> Column | bool:
    """The tree over `has(words)`; Python's own truth values stand for themselves."""
    if isinstance(node, boolean.Word):
        words = boolean.analyzed(node.value)
        if not words:
            return has(None)
        parts = [has(words)] if '"' in node.value else [has([w]) for w in words]
        return _any(parts)
    if isinstance(node, boolean.Not):
        x = _holds(node.child, has)
        return not x if isinstance(x, bool) else ~x
    parts = [_holds(x, has) for x in node.children]
    if isinstance(node, boolean.Or):
        return _any(parts)
    return all(parts) if isinstance(parts[0], bool) else boolean._fold(parts, Column.__and__)


def _any(parts: list) -> Column | bool:
    return any(parts) if isinstance(parts[0], bool) else boolean._fold(parts, Column.__or__)


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _phrase_count(places: list[Column]) -> Column:
    """Occurrences of words one behind the other; where two overlap the first counts."""
    starts = places[0]
    for k, own in enumerate(places[1:], 1):
        starts = F.array_intersect(starts, _shifted(own, k))
    width = len(places)
    begin = F.struct(F.lit(-1).alias("free"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(p >= s["free"], F.struct((p + width).alias("free"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.coalesce(F.aggregate(F.array_sort(starts), begin, step)["n"], F.lit(0))


def _met(index: Index, terms: list[list[str]], zones: DataFrame | None = None) -> DataFrame:
    """(id, length, tf0, tf1, ...) of the documents with any word of `terms`, each a word or the words of a phrase."""
    words = sorted({w for t in terms for w in t})
    phrased = {w for t in terms if len(t) > 1 for w in t}
    rows = index.postings.filter(F.col("term").isin(words))
    if zones is not None:
        rows = rows.join(F.broadcast(zones), "zone", "left_semi")
    # Without phrases the places are not read.
    fields = ["id", "tf", "length", *(["places"] if phrased else [])]
    held = F.arrays_zip(*[F.col(f"held.{c}").alias(c) for c in fields])
    each = rows.select("term", F.explode(held).alias("d")).select("term", *[F.col(f"d.{c}").alias(c) for c in fields])
    at = {w: k for k, w in enumerate(words)}
    own = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"_n{k}") for w, k in at.items()]
    own += [F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"_p{k}") for w, k in at.items() if w in phrased]
    got = each.groupBy("id").agg(F.max("length").alias("length"), *own)
    tf = [F.coalesce(F.col(f"_n{at[t[0]]}"), F.lit(0)) if len(t) == 1 else _phrase_count([F.col(f"_p{at[w]}") for w in t]) for t in terms]
    return got.select("id", "length", *[c.alias(f"tf{k}") for k, c in enumerate(tf)])


def _tree(query: str, legacy: bool) -> tuple[boolean.Node, list[list[str]], bool]:
    """The tree, its distinct words and phrases, and whether a document without any of them fits."""
    node = boolean.build(query, legacy)
    terms = [list(t) for t in dict.fromkeys(tuple(t) for t in _words(node))]
    return node, terms, bool(_holds(node, lambda words: False))


def _fits(node: boolean.Node, terms: list[list[str]]) -> Column:
    at = {tuple(t): k for k, t in enumerate(terms)}
    return _holds(node, lambda words: F.lit(False) if words is None else F.coalesce(F.col(f"tf{at[tuple(words)]}") > 0, F.lit(False)))


def found(index: Index, query: str, begin: date | None = None, end: date | None = None, day: str | None = None, legacy: bool = False) -> DataFrame:
    """The rows of `index.docs` that match."""
    docs = index.docs if day is None else index.docs.filter(in_range(F.col(day), begin, end))
    if query == boolean.EVERYTHING:
        return docs
    node, terms, bare = _tree(query, legacy)
    if not terms:
        return docs if bare else docs.limit(0)
    hits = _met(index, terms).drop("length")
    if bare:
        return docs.join(hits, "id", "left").filter(_fits(node, terms)).select(*docs.columns)
    return docs.join(hits.filter(_fits(node, terms)).select("id"), "id", "left_semi")


def _weighed(rows: DataFrame, scoring: list[int], df: dict[int, Column], index: Index) -> DataFrame:
    score = F.lit(0.0)
    for k in scoring:
        tf = F.coalesce(F.col(f"tf{k}"), F.lit(0)).cast("double")
        idf = F.log(1 + (F.lit(index.n) - df[k] + 0.5) / (df[k] + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(index.mean)))
    return rows.withColumn("score", score)


def _document_counts(index: Index, terms: list[list[str]]) -> dict[str, int]:
    """In how many documents each single word occurs; places are not read."""
    words = [t[0] for t in terms if len(t) == 1]
    rows = index.postings.filter(F.col("term").isin(words)).groupBy("term").agg(F.sum("n").alias("n")).collect() if words else []  # a row for each word of the query
    return {r["term"]: r["n"] for r in rows}


def scored(index: Index, query: str, legacy: bool = False, zones: DataFrame | None = None) -> DataFrame:
    """(id, score) of the documents that match: the sum of BM25 over the words and phrases outside of NOT."""
    if query == boolean.EVERYTHING:
        return index.docs.select("id", F.lit(0.0).alias("score"))
    node, terms, bare = _tree(query, legacy)
    if not terms:
        return (index.docs if bare else index.docs.limit(0)).select("id", F.lit(0.0).alias("score"))
    wanted = {tuple(t) for t in boolean.scoring_terms(node)}
    scoring = [k for k, t in enumerate(terms) if tuple(t) in wanted]
    met = _met(index, terms, zones)
    counts = _document_counts(index, [terms[k] for k in scoring])
    df = {k: F.lit(float(counts.get(terms[k][0], 0))) for k in scoring if len(terms[k]) == 1}
    phrases = [k for k in scoring if len(terms[k]) > 1]
    if phrases:
        all_ = met if zones is None else _met(index, [terms[k] for k in phrases])
        number = {k: k if zones is None else j for j, k in enumerate(phrases)}
        one = all_.agg(*[F.count_if(F.col(f"tf{number[k]}") > 0).cast("double").alias(f"df{k}") for k in phrases])
        met = met.crossJoin(F.broadcast(one))  # one row
        df |= {k: F.col(f"df{k}") for k in phrases}
    if bare:
        own = index.docs if zones is None else index.docs.join(F.broadcast(zones), "zone", "left_semi")
        met = own.select("id", "length").join(met.drop("length"), "id", "left")
    return _weighed(met.filter(_fits(node, terms)), scoring, df, index).select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top(index: Index, query: str, k: int, legacy: bool = False, first: int = 4) -> DataFrame:
    """(id, score) of the k best hits, the least id first among equals.

    Queries of single words read the places of few zones: those of the `first` greatest bounds, then all
    whose bounds reach the k-th best score found there. Others read all of their words' rows.
    """
    best = lambda rows: rows.orderBy(F.desc("score"), "id").limit(k)
    node, terms, bare = (None, [], True) if query == boolean.EVERYTHING else _tree(query, legacy)
    wanted = {tuple(t) for t in boolean.scoring_terms(node)} if node else set()
    if bare or not wanted or any(len(t) > 1 for t in wanted) or index.zones <= first:
        return best(scored(index, query, legacy))
    counts = _document_counts(index, [list(t) for t in wanted])
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = index.postings.sparkSession.createDataFrame([(w, float(n)) for w, n in counts.items()], "term string, df double")
    # One row for each zone: some thousands of documents each stand behind it. Sums may differ by rounding.
    bounds = index.postings.filter(F.col("term").isin(sorted(counts))).select("term", "zone", "best").join(F.broadcast(known), "term")
    bounds = bounds.groupBy("zone").agg((F.sum(idf * (K1 + 1) * F.col("best")) * (1 + 1e-9)).alias("bound"))
    seeds = bounds.orderBy(F.desc("bound"), "zone").limit(first)
    reached = best(scored(index, query, legacy, seeds.select("zone"))).collect()  # k rows
    if len(reached) == k:
        bounds = bounds.filter(F.col("bound") >= reached[-1]["score"])
    return best(scored(index, query, legacy, bounds.select("zone")))
