"""Vector search over chunks: exact, filtered, ranked by section; embedding in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(chunks: DataFrame, query: Sequence[float] | Column, k: int, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k chunks most like a query; each task keeps its k best."""
    q = query if isinstance(query, Column) else vector(query)
    return chunks.withColumn("similarity", cosine(F.col(embedding), q)).orderBy(F.desc("similarity"), key).limit(k)


#: Query vectors that are broadcast at once.
QUERIES = 4000


def nearest_of_each(chunks: DataFrame, queries: DataFrame, k: int, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, similarity, place) for a stated query set (query_id, query), whole numbers as keys.

    Blocks of at most about QUERIES queries go to all tasks; there a matrix product scores a whole Arrow
    batch, and a task sends on its k best for each query only. Similarities count to 9 digits, equals by key.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERIES))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    rows = chunks.select(F.col(key).cast("long").alias(key), F.col(embedding).cast("array<double>").alias("v")).filter("v is not null")
    found = []
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).toArrow()
        if block.num_rows:
            shared = chunks.sparkSession.sparkContext.broadcast((block["query_id"].to_numpy(), _unit(_matrix(block["query"].combine_chunks()))))
            found.append(rows.mapInArrow(_scored_by(shared, k, key), f"query_id long, `{key}` long, similarity double"))
    if not found:
        return chunks.sparkSession.createDataFrame([], f"query_id long, `{key}` long, similarity double, place int")
    return reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _scored_by(shared, k: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        held_ids, held = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                if not len(part):
                    continue
                s = np.concatenate([held, np.round(queries @ _unit(_matrix(part.column(1))).T, 9)], axis=1)
                own = np.concatenate([held_ids, np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), (len(ids), len(part)))], axis=1)
                by = np.argsort(own, axis=1, kind="stable")
                s, own = np.take_along_axis(s, by, 1), np.take_along_axis(own, by, 1)
                by = np.argsort(-s, axis=1, kind="stable")[:, :k]
                held, held_ids = np.take_along_axis(s, by, 1), np.take_along_axis(own, by, 1)
        if held.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, held.shape[1])), pa.array(held_ids.reshape(-1)), pa.array(held.reshape(-1))], names=["query_id", key, "similarity"])

    return run


def section_best(chunks: DataFrame, query: Sequence[float] | Column, per_document: int = 10, per_section: int = 8, document: str = "record_key", section: str = "section", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """For each document its best chunks, and of these the best of each section."""
    q = query if isinstance(query, Column) else vector(query)
    rows = chunks.withColumn("similarity", cosine(F.col(embedding), q)).drop(embedding)
    by = [F.desc("similarity"), F.col(key)]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(*by))).filter(F.col("place") <= per_document)
    rows = rows.withColumn("section_place", F.row_number().over(Window.partitionBy(document, section).orderBy(*by)))
    return rows.filter(F.col("section_place") <= per_section)


def embedded(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], size: int = 128) -> DataFrame:
    """Adds `embedding`; the embedder gets `size` texts at a time, in order."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[float]] = []
            for k in range(0, len(texts), size):
                out += embedder(texts.iloc[k : k + size].tolist())
            yield pd.Series(out)

    return rows.withColumn("embedding", run(text))


def hashed_embedding(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a model: signed hashed words, of length 1."""
    import hashlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def document_texts(chunks: DataFrame, text: str = "text", document: str = "doc_id") -> DataFrame:
    """(document, key, n_chunks, all): the joined chunks of each document and their hash."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", text))), lambda x: x[text])
    rows = chunks.groupBy(document).agg(ordered.alias("parts"))
    return rows.select(document, F.size("parts").alias("n_chunks"), F.array_join("parts", "\n").alias("all")).withColumn("key", F.sha2("all", 256))


def not_cached(chunks: DataFrame, cache: DataFrame, text: str = "text", document: str = "doc_id") -> DataFrame:
    """(document, key) of documents whose joined chunks have no entry in the cache."""
    return document_texts(chunks, text, document).select(document, "key").join(cache.select("key"), "key", "left_anti").select(document, "key")


def cache_totals(chunks: DataFrame, cache: DataFrame, tokens: Column, text: str = "text", document: str = "doc_id") -> DataFrame:
    """One row: documents, those that are cached, chunks, and tokens by `tokens` of column `all`."""
    rows = document_texts(chunks, text, document).join(cache.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count("hit").alias("cached"), F.sum("n_chunks").cast("long").alias("chunks"), F.sum(tokens).alias("tokens"))


def with_new_chunks(stored_chunks: DataFrame, chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], size: int = 200, key: str = "chunk_id") -> DataFrame:
    """The collection and, embedded `size` at a time, the chunks that it lacks."""
    fresh = embedded(chunks.join(stored_chunks.select(key), key, "left_anti").select(*chunks.columns), "text", embedder, size)
    return stored_chunks.unionByName(fresh.select(*stored_chunks.columns))


def best_of_section(chunks: DataFrame, query: Sequence[float] | Column, section: str = "Mineure-Subsommation", k: int = 8, document: str = "record_key", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """For each document its k best chunks of one section."""
    q = query if isinstance(query, Column) else vector(query)
    rows = chunks.filter(F.col("section") == section).withColumn("similarity", cosine(F.col(embedding), q)).drop(embedding)
    by = Window.partitionBy(document).orderBy(F.desc("similarity"), key)
    return rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def collection(collections: Mapping[str, DataFrame], name: str, fallbacks: Mapping[str, str] = {}) -> DataFrame:
    """The collection of a source, or the one of its older name; KeyError if neither is there."""
    found = name if name in collections else fallbacks.get(name)
    if found not in collections:
        raise KeyError(f"no collection {name!r}")
    return collections[found]


def has_collection(collections: Mapping[str, DataFrame], name: str, fallbacks: Mapping[str, str] = {}) -> bool:
    """Whether there is a collection with anything in it."""
    try:
        return collection(collections, name, fallbacks).limit(1).count() > 0
    except KeyError:
        return False


def similar_words(keywords: DataFrame, vocabulary: DataFrame, least: float = 0.75) -> DataFrame:
    """(keyword, word, similarity) of vocabulary words whose vector is like a keyword's; both are (word, vector), without null vectors.

    Keywords are a stated query set: blocks of at most about QUERIES of them go to all tasks, where a
    matrix product scores a batch of the vocabulary and only likenesses of at least `least` go on.
    """
    kinds = [t.schema["word"].dataType.simpleString() for t in (keywords, vocabulary)]
    rows = vocabulary.select("word", F.col("vector").cast("array<double>").alias("v")).filter("v is not null")
    asked = keywords.select("word", F.col("vector").cast("array<double>").alias("v")).filter("v is not null")
    blocks = max(1, -(-asked.count() // QUERIES))

    def scored_by(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries = shared.value
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = batch.slice(at, 500)
                    if len(part):
                        s = queries @ _unit(_matrix(part.column(1))).T
                        q, w = np.nonzero(s >= least)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column(0).take(pa.array(w)), pa.array(s[q, w])], names=["keyword", "word", "similarity"])

        return run

    found = []
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if block.num_rows:
            shared = keywords.sparkSession.sparkContext.broadcast((block["word"].combine_chunks(), _unit(_matrix(block["v"].combine_chunks()))))
            found.append(rows.mapInArrow(scored_by(shared), f"keyword {kinds[0]}, word {kinds[1]}, similarity double"))
    if not found:
        return keywords.sparkSession.createDataFrame([], f"keyword {kinds[0]}, word {kinds[1]}, similarity double")
    return reduce(DataFrame.unionByName, found)


def routed_sections(question: Column, hints: dict[str, Sequence[str]]) -> Column:
    """Sections whose hints occur most often in the question; all if none does."""
    low = F.lower(question)
    counts = F.array(*[F.struct(sum((F.when(low.contains(h.lower()), 1).otherwise(0) for h in words), F.lit(0)).alias("n"), F.lit(s).alias("section")) for s, words in hints.items()])
    most = F.array_max(F.transform(counts, lambda c: c["n"]))
    return F.transform(F.filter(counts, lambda c: (most == 0) | (c["n"] == most)), lambda c: c["section"])


def mean_vector_similarity(a: Column, b: Column, size: int) -> Column:
    """Cosine of the means of two arrays of word vectors."""
    mean = lambda vs: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(vs, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.greatest(F.size(vs), F.lit(1)))
    return cosine(mean(a), mean(b))
