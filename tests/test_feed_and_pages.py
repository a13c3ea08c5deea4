"""Feeds ask their filters of the source; pages by cursor join to the whole."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, StringContains

from corpusloom.operators import cursor
from corpusloom.sources import feed, records


def hits(n=60):
    return [{"Signatur": f"k{k}", "Spider": f"s{k % 3}", "Sprache": ["fr", "de"][k % 2], "Datum": f"2020-01-{1 + k % 28:02}", "attachment": {"content": f"text {k}"}} for k in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("feed"))
    rows = [(h["Spider"], h["Sprache"], json.dumps(h)) for h in hits()]
    feed.write_feed_lines(spark.createDataFrame(rows, "spider string, language string, value string").repartition(2), at)
    feed.register_feed(spark)
    return at


def test_filters_reach_the_feed(spark, folder):
    rows = spark.read.format("feed").option("location", folder).load()
    asked = rows.filter("spider in ('s0', 's1') and language = 'fr' and date >= '2020-01-10'")
    want = sorted(h["Signatur"] for h in hits() if h["Spider"] in ("s0", "s1") and h["Sprache"] == "fr" and h["Datum"] >= "2020-01-10")
    got = records.feed_records(asked, "c")
    assert sorted(r["record_key"] for r in got.collect()) == want
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "spider" not in plan.split("Filter")[1].split("\n")[0].replace("isnotnull(spider", "") if "Filter" in plan else True
    reader = feed.FeedReader({"location": folder})
    left = list(reader.pushFilters([EqualTo(("spider",), "s1"), In(("language",), ("fr", "de")), GreaterThanOrEqual(("date",), "2020-01-10"), StringContains(("value",), "x"), IsNotNull(("value",))]))
    assert left == [StringContains(("value",), "x")]
    assert reader.asked == feed.Asked(["s1"], ["fr", "de"], [(">=", "2020-01-10")])
    assert {p.name.split("/")[0] for p in reader.partitions()} == {"spider=s1"}
    fresh = lambda **o: feed.feed_hits(spark, folder, **o)
    assert fresh(spiders=["s1"]).filter("value like '%text 7%'").count() == 1
    assert fresh().filter("spider = 's0' and spider = 's1'").count() == 0 and fresh().count() == 60
    assert fresh(spiders=["s0", "s1"], language="fr", since="2020-01-10").count() == len(want)


def test_scans_go_on(spark, folder):
    rows = lambda **o: spark.read.format("feed").options(location=folder, **o).load()
    names = sorted(r["batch"] for r in rows().select("batch").distinct().collect())
    for k in (0, len(names) // 2, len(names) - 1):
        got = rows(after=names[k]).select("batch").distinct().collect()
        assert sorted(r["batch"] for r in got) == names[k + 1 :]
    assert rows(limit="1").count() == len(names)


def test_http_pages(spark):
    """The query in the body, a page a batch."""
    bodies = []

    class Search(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bodies.append(body)
            found = [h for h in hits() if h["Spider"] == "s2"]
            page = found[body.get("from", 0) : body.get("from", 0) + body["size"]]
            answer = json.dumps({"hits": {"total": {"value": len(found)}, "hits": [{"_source": h} for h in page] + [{"_source": None}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Search)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    feed.register_feed(spark)
    rows = spark.read.format("feed").options(location=f"http://127.0.0.1:{server.server_port}", client="http", size="7").load()
    got = rows.filter("spider = 's2' and date <= '2020-01-28'").collect()
    server.shutdown()
    assert len(got) == 20 and sorted({r["batch"] for r in got}) == [f"{k:012}" for k in (0, 7, 14)]
    assert bodies[-1]["query"] == {"bool": {"filter": [{"terms": {"Spider.keyword": ["s2"]}}, {"range": {"Datum": {"lte": "2020-01-28"}}}]}}


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_pages_join_to_the_whole(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(k, rng.choice([None, 1.5, rng.random(), 0.0]), f"t{k}") for k in range(130 if size > 1 else 12)]
    source = spark.createDataFrame(rows, "doc_id int, score double, title string")
    frozen = cursor.freeze(source.repartition(5), str(tmp_path / "f"))
    assert frozen.total == len(rows)
    at, seen = None, []
    while page := cursor.page_after(cursor.thaw(spark, str(tmp_path / "f")), at, size).collect():
        assert len(page) <= size and page[0].asDict().keys() == {"doc_id", "score", "title"}
        seen += page
        at = cursor.cursor_of(frozen, page)
    order = sorted(rows, key=lambda r: (-r[1] if r[1] is not None else float("inf"), r[0]))
    assert [r["doc_id"] for r in seen] == [r[0] for r in order]
    if size == 7 and len(frozen.parts) > 2:
        plan = cursor.page_after(frozen, (1.5, -1), 7)._jdf.queryExecution().executedPlan().toString()
        assert "_part" in plan and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_pages_of_nothing(spark, tmp_path):
    frozen = cursor.freeze(spark.createDataFrame([], "doc_id int, score double"), str(tmp_path / "f"))
    assert frozen.total == 0 and cursor.page_after(frozen).collect() == [] and cursor.cursor_of(frozen, []) is None


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_all_pages_are_those_by_cursor(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(k, rng.choice([None, 1.5, float("nan"), rng.random(), 0.0, -0.0])) for k in range(130 if size > 1 else 12)]
    frozen = cursor.freeze(spark.createDataFrame(rows, "doc_id int, score double").filter("not isnan(score) or score is null").repartition(5), str(tmp_path / "f"))
    at, want = None, {}
    for number in range(len(rows) + 1):
        page = cursor.page_after(frozen, at, size).collect()
        want |= {r["doc_id"]: number for r in page}
        at = cursor.cursor_of(frozen, page) or at
    assert {r["doc_id"]: r["page"] for r in cursor.all_pages(frozen, size).collect()} == want


def test_jobs_do_not_grow_with_pages(spark, tmp_path):
    from corpusloom import catalog

    points = spark.range(2000).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.array((F.col("id") % 7).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    points.write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sparkContext.setJobGroup("pages", "pages")
    try:
        got = {r["doc_id"]: r["page"] for r in catalog.QUERIES["r_cursor_pages"](spark, str(tmp_path)).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    order = sorted(range(2000), key=lambda k: (-(k % 7), k))
    assert got == {k: i // 40 for i, k in enumerate(order)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pages")) < 25
