"""Search over a stored index gives what a scan of the texts gives, and reads what it says."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings, search

QUERIES = [
    "red", '"red green"', '"red red"', "red AND green NOT blue", '(red OR blue) NOT "green red"', "NOT red", "missing", "missing OR red", "red-green", '"no such words"', "!!", "blue OR green NOT red",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["red", "green", "blue", "Grün", "x_1"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12), weights=[4, 3, 2, 1, 1])) + rng.choice([".", "!", ""]), rng.choice("ab")) for k in range(300)]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "red red red", "b"), (1003, "red red red", "b"), (1004, "...", "b"), (1005, "red " * 400, "a")]
    return spark.createDataFrame(rows, "doc_id int, text string, kind string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return postings.write_index(corpus, str(tmp_path_factory.mktemp("index")), kept=["kind"], zone=16)


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_a_scan(corpus, index, query):
    assert index.zones >= 15 and index.n == 304
    want = sorted((r["doc_id"], r["kind"]) for r in search.matching(corpus, query).collect())
    assert sorted((r["id"], r["kind"]) for r in postings.found(index, query).collect()) == want
    scores = {r["doc_id"]: r["score"] for r in search.scored(corpus, query).collect()}
    got = {r["id"]: r["score"] for r in postings.scored(index, query).collect()}
    assert set(got) == set(scores) and all(abs(got[k] - v) < 1e-9 for k, v in scores.items())
    for k in (1, 7, 1000):
        best = [(r["id"], round(r["score"], 9)) for r in postings.top(index, query, k).collect()]
        assert best == sorted(((d, round(s, 9)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_reads_the_words_of_the_query_only(spark, index):
    plan = postings.found(index, "red AND green")._jdf.queryExecution().toString()
    assert "In(term, [green,red])" in plan and "places" not in plan.split("ReadSchema")[1].split("\n")[0]
    words = [r["term"] for r in index.postings.select("term").distinct().collect()]
    assert sorted(words) == ["blue", "green", "grün", "red", "x_1"]
    again = index.postings.select(F.explode("held").alias("d")).select(F.size("d.places").alias("n"), "d.tf")
    assert again.filter("n != tf").count() == 0


def test_top_skips_zones(corpus, index, monkeypatch):
    """A rare heavy hit keeps the zones of all others from being read."""
    asked = []
    scored = postings.scored

    def watched(index, query, legacy=False, zones=None):
        asked.append(zones.count())
        return scored(index, query, legacy, zones)

    monkeypatch.setattr(postings, "scored", watched)
    assert len(postings.top(index, "x_1", 1).collect()) == 1
    assert asked[0] == 4 and asked[1] < index.zones


def test_empty_corpus(spark, corpus, tmp_path):
    index = postings.write_index(corpus.limit(0), str(tmp_path / "i"))
    assert index.n == 0 and postings.found(index, "red").count() == 0 and postings.top(index, "red", 5).count() == 0


def test_building_moves_texts_once(spark, tmp_path):
    """Shuffles hold the texts and no row for each word; a zone's rows are one file, sorted by word."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(300))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4).cache()
    docs.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    index = postings.write_index(docs, str(tmp_path / "i"), zone=100)
    assert written() - before < 1.5 * sum(len(t) for _, t in rows)
    files = index.postings.select(F.input_file_name().alias("f"), "zone", "term", "held")
    assert {len(r["z"]) for r in files.groupBy("f").agg(F.collect_set("zone").alias("z")).collect()} == {1}
    places = {(r["term"], r["d"]["id"]): r["d"]["places"] for r in files.select("term", F.explode("held").alias("d")).filter("d.id < 20").collect()}
    want = {}
    for k, t in rows[:20]:
        for i, w in enumerate(t.split()):
            want.setdefault((w, k), []).append(i)
    assert places == want
