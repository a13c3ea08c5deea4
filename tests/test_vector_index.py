"""Recall of the index against the exact way, with filters; cases at the edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vector_index, vectors


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 48))
    x = centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 48))
    rows = [(k, v.tolist(), k % 5) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id int, embedding array<double>, section int").repartition(4).cache()


def test_recall(spark, chunks, tmp_path):
    odd = spark.createDataFrame([(9000, None, 1), (9001, [], 1), (9002, [float("nan")] * 48, 1), (9003, [0.0] * 48, 1)], chunks.schema)
    index = vector_index.build_index(chunks.unionByName(odd), str(tmp_path / "i"), kept=["section"])
    assert index.rows.count() == 4001 and 50 <= len(index.centres) <= 70
    queries = chunks.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for only, exact in ((None, chunks), (F.col("section") == 2, chunks.filter("section = 2"))):
        want = {(r["query_id"], r["vec_id"]) for r in vectors.nearest_of_each(exact, queries, 30).collect()}
        got = vector_index.search_vectors(index, queries, 30, only=only).collect()
        assert len(got) == 30 * 200 and len(want & {(r["query_id"], r["id"]) for r in got}) >= 0.9 * len(want)
        assert all(abs(r["similarity"]) <= 1 + 1e-9 for r in got)
    whole = vector_index.search_vectors(index, queries.limit(3), 10, probes=len(index.centres), again=500)
    exact = vectors.nearest_of_each(chunks, queries.limit(3), 10)
    assert {(r["query_id"], r["id"], r["place"]) for r in whole.collect()} == {(r["query_id"], r["vec_id"], r["place"]) for r in exact.collect()}


def test_index_of_little(spark, chunks, tmp_path):
    nothing = vector_index.build_index(chunks.limit(0), str(tmp_path / "n"))
    queries = chunks.limit(2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert vector_index.search_vectors(nothing, queries.limit(0), 3).count() == 0
    few = vector_index.build_index(chunks.limit(3), str(tmp_path / "f"))
    assert vector_index.search_vectors(few, queries, 5).count() == 6
