"""An approximate vector index: inverted lists of a coarse quantiser, product codes, and exact ranking of what they propose.

Centres and code books are learned from a bounded sample; every row is indexed. A row lies in the list of
its nearest centre, as a few bytes that name the nearest code of each piece of what is left of it. A
search reads the lists of the centres nearest to each query, estimates likenesses by tables of pieces, and
ranks the best of these by their whole vectors. `nearest_of_each` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.vectors import _matrix, _unit
from corpusloom.sources.staging import if_small, stored

#: Query vectors that are broadcast at once.
QUERIES = 2000


@dataclass(frozen=True)
class IndexRule:
    #: Rows that centres and codes are learned from, at most; chosen by hash.
    sample: int = 50_000
    #: Lists, at most; about the square root of the rows.
    lists: int = 4096
    #: Pieces of a vector, and codes of a piece.
    pieces: int = 16
    codes: int = 256
    rounds: int = 12
    seed: int = 5


@dataclass(frozen=True)
class VectorIndex:
    #: list, id, codes (binary), v (unit vector), and the columns that were kept; written by list.
    rows: DataFrame
    centres: np.ndarray
    #: pieces x codes x dimensions of a piece; the last piece is filled up with zeros.
    books: np.ndarray
    dim: int


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of a bounded sample; a mean without rows takes a row at random."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _closest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = counts == 0
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def _in_pieces(x: np.ndarray, pieces: int) -> np.ndarray:
    width = -(-x.shape[1] // pieces)
    padded = np.zeros((len(x), pieces * width))
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), pieces, width)


def build_index(chunks: DataFrame, path: str, embedding: str = "embedding", key: str = "vec_id", kept: Sequence[str] = (), rule: IndexRule = IndexRule()) -> VectorIndex:
    """An index of all rows whose vector is whole, below `path`. Keys are numbers; vectors have one length."""
    spark = chunks.sparkSession
    v = F.col(embedding).cast("array<double>")
    rows = chunks.select(F.col(key).cast("long").alias("id"), v.alias("v"), *kept).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    n = rows.count()
    sample = _unit(_matrix(rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(rule.seed)), "id").limit(rule.sample).toArrow()["v"].combine_chunks())) if n else np.zeros((1, 1))
    rng = np.random.default_rng(rule.seed)
    centres = _means(sample, max(1, min(rule.lists, round(n**0.5))), rule.rounds, rng)
    left = _in_pieces(sample - centres[_closest(sample, centres)], rule.pieces)
    books = [_means(left[:, m], rule.codes, rule.rounds, rng) for m in range(rule.pieces)]
    most = max(map(len, books))
    books = np.stack([np.vstack([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books])
    shared = spark.sparkContext.broadcast((centres, books))  # bounded by the rule

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(_matrix(batch.column(1)))
            own = _closest(x, centres)
            pieces = _in_pieces(x - centres[own], len(books))
            codes = np.stack([_closest(pieces[:, m], books[m]) for m in range(len(books))], axis=1).astype(np.uint8)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(0), unit, *batch.columns[2:]], names=["list", "codes", "id", "v", *kept])

    extra = "".join(f", `{c}` {chunks.schema[c].dataType.simpleString()}" for c in kept)
    table = rows.mapInArrow(coded, f"list int, codes binary, id long, v array<double>{extra}")
    table.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{path}/rows")
    spark.createDataFrame([(centres.shape[1], *books.shape, centres.astype("<f8").tobytes(), books.astype("<f8").tobytes())], "dim int, pieces int, codes int, width int, centres binary, books binary").write.parquet(f"{path}/model")
    return open_vectors(spark, path)


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    m = spark.read.parquet(f"{path}/model").head()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.frombuffer(bytes(m["centres"])).reshape(-1, m["dim"]), np.frombuffer(bytes(m["books"])).reshape(m["pieces"], m["codes"], m["width"]), m["dim"])


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int = 16, again: int = 8, only: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, place) for a stated query set (query_id, query): about the k rows most alike, by cosine, then id.

    probes: lists read for each query. `again` x k proposals of each query are ranked by their whole
    vectors. only: a condition on the kept columns that rows meet before they are proposed.
    """
    spark = index.rows.sparkSession
    rows = index.rows if only is None else index.rows.filter(only)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).filter("query is not null")
    blocks = max(1, -(-asked.count() // QUERIES))
    best = Window.partitionBy("query_id")
    most, parts = again * k, []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, q = block["query_id"].to_numpy(), _unit(_matrix(block["query"].combine_chunks()))
        toward = q @ index.centres.T
        near = np.argsort(np.sqrt(np.maximum((index.centres**2).sum(axis=1) - 2 * toward, -1) + 1), axis=1, kind="stable")[:, :probes]
        read = sorted({int(c) for c in near.reshape(-1)})
        # Likeness to a piece's code, for each query: what is summed for a row.
        tables = np.einsum("qmw,mcw->qmc", _in_pieces(q, len(index.books)), index.books)
        shared = spark.sparkContext.broadcast((ids, near, toward, tables))
        mine = rows.filter(F.col("list").isin(read)).select("list", "codes", "id")
        parts.append(mine.mapInArrow(_proposed(shared, most), "query_id long, id long, estimate double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, similarity double, place int")
    proposed = parts[0]
    for more in parts[1:]:
        proposed = proposed.unionByName(more)
    proposed = proposed.withColumn("place", F.row_number().over(best.orderBy(F.desc("estimate"), "id"))).filter(F.col("place") <= most)
    proposed = stored(proposed.select("query_id", "id"), "proposed")
    whole = index.rows.select("id", "v").join(if_small(proposed.select("id").distinct()), "id", "left_semi")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = proposed.join(whole, "id").join(F.broadcast(asked) if blocks == 1 else asked, "query_id")
    norm = F.sqrt(dot(F.col("query"), F.col("query")))
    met = met.select("query_id", "id", F.when(norm > 0, dot(F.col("v"), F.col("query")) / norm).otherwise(F.lit(0.0)).alias("similarity"))
    return met.withColumn("place", F.row_number().over(best.orderBy(F.desc("similarity"), "id"))).filter(F.col("place") <= k)


def _proposed(shared, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near, toward, tables = shared.value
        of_list: dict[int, np.ndarray] = {}
        for query, lists in enumerate(near):
            for c in lists.tolist():
                of_list.setdefault(c, []).append(query)
        held: dict[int, list[np.ndarray]] = {}

        def cut(query: int) -> None:
            own, score = (np.concatenate(x) for x in zip(*held[query], strict=True))
            if len(own) > most:
                top = np.lexsort((own, -score))[:most]
                own, score = own[top], score[top]
            held[query] = [(own, score)]

        for batch in batches:
            if not len(batch):
                continue
            lists, own = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            order = np.argsort(lists, kind="stable")
            cuts = np.flatnonzero(np.append(True, lists[order][1:] != lists[order][:-1]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                rows = order[lo:hi]
                place = np.arange(codes.shape[1])
                for query in of_list.get(int(lists[rows[0]]), ()):
                    score = toward[query, lists[rows[0]]] + tables[query][place[None, :], codes[rows]].sum(axis=1)
                    held.setdefault(query, []).append((own[rows], score))
                    if sum(len(x[0]) for x in held[query]) > 4 * most:
                        cut(query)
        for query in held:
            cut(query)
            found, score = held[query][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ids[query])), pa.array(found), pa.array(score)], names=["query_id", "id", "estimate"])

    return run
