"""A feed of records as a Spark data source: filters go to the feed, each batch is one partition, and a scan can go on where another ended.

    register_feed(spark)
    hits = spark.read.format("feed").option("location", url).option("client", "http").load()
    hits.filter("spider = 'x' and language = 'fr' and date >= '2024-01-01'")

What the feed is asked is all that is read: equality or membership of spider and language, and bounds
of the date. Other filters are applied by Spark. `value` is the hit as JSON, as `records.feed_records`
takes it; `batch` and `place` are where it lies. With `after` (a batch's name) a scan begins behind
that batch, so a job that stores the last batch it has loaded can be resumed. `limit` bounds the rows of
a batch, as no batch need give more; the whole is cut by `DataFrame.limit`.

Load anew for each scan (`feed_hits` does): Spark keeps what the first scan of a loaded frame has asked
of its reader, and a second scan of the same frame with other filters would get the first one's rows.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "spider string, language string, date string, batch string, place long, value string"
#: The fields of a hit that can be asked for.
FIELDS = {"spider": "Spider", "language": "Sprache", "date": "Datum"}


@dataclass
class Asked:
    """What a scan asks of the feed; an empty list asks nothing."""

    spider: list[str] = field(default_factory=list)
    language: list[str] = field(default_factory=list)
    #: (comparison, date), all of which hold.
    date: list[tuple[str, str]] = field(default_factory=list)

    def fits(self, hit: dict) -> bool:
        told = {name: hit.get(source) for name, source in FIELDS.items()}
        if any(getattr(self, c) and told[c] not in getattr(self, c) for c in ("spider", "language")):
            return False
        return all(told["date"] is not None and _COMPARED[how](told["date"], day) for how, day in self.date)


_COMPARED = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}
_BOUNDS = {GreaterThanOrEqual: ">=", GreaterThan: ">", LessThanOrEqual: "<=", LessThan: "<", EqualTo: "="}


class FolderFeed:
    """Files of JSON lines below `spider=.../language=...` folders that all workers reach; a file is a batch. Folders that are not asked for are not opened."""

    def __init__(self, location: str, size: int) -> None:
        self.root = location.removeprefix("file://")

    def batches(self, asked: Asked) -> list[str]:
        found = []
        for folder, names, files in os.walk(self.root):
            inside = dict(p.split("=", 1) for p in os.path.relpath(folder, self.root).split(os.sep) if "=" in p)
            if any(c in inside and getattr(asked, c) and inside[c] not in getattr(asked, c) for c in ("spider", "language")):
                names.clear()
                continue
            found += [os.path.relpath(os.path.join(folder, f), self.root) for f in files if f.endswith((".json", ".jsonl", ".txt")) and not f.startswith((".", "_"))]
        return sorted(found)

    def hits(self, batch: str, asked: Asked) -> Iterator[dict]:
        with open(os.path.join(self.root, batch), encoding="utf-8") as lines:
            for line in lines:
                if line.strip() and asked.fits(hit := json.loads(line)):
                    yield hit


class HttpFeed:
    """A search address that takes a query, `from` and `size`; a page is a batch."""

    def __init__(self, location: str, size: int) -> None:
        self.address, self.size = location.rstrip("/") + "/_search", size

    def body(self, asked: Asked) -> dict:
        terms = [{"terms": {f"{FIELDS[c]}.keyword" if c == "spider" else FIELDS[c]: getattr(asked, c)}} for c in ("spider", "language") if getattr(asked, c)]
        names = {">=": "gte", ">": "gt", "<=": "lte", "<": "lt"}
        for how, day in asked.date:
            bounds = {"gte": day, "lte": day} if how == "=" else {names[how]: day}
            terms.append({"range": {FIELDS["date"]: bounds}})
        return {"query": {"bool": {"filter": terms}}, "sort": ["_doc"]}

    def _get(self, body: dict) -> dict:
        request = urllib.request.Request(self.address, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)

    def batches(self, asked: Asked) -> list[str]:
        total = self._get(self.body(asked) | {"size": 0, "track_total_hits": True})["hits"]["total"]["value"]
        return [f"{start:012}" for start in range(0, total, self.size)]

    def hits(self, batch: str, asked: Asked) -> Iterator[dict]:
        for hit in self._get(self.body(asked) | {"from": int(batch), "size": self.size})["hits"]["hits"]:
            if isinstance(hit.get("_source"), dict):
                yield hit["_source"]


CLIENTS = {"folder": FolderFeed, "http": HttpFeed}


@dataclass
class Batch(InputPartition):
    name: str


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.asked = Asked()
        self.after, self.limit = options.get("after", ""), int(options.get("limit", "0"))
        self.feed = CLIENTS[options.get("client", "folder")](options["location"], int(options.get("size", "500")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "date" and type(f) in _BOUNDS:
                self.asked.date.append((_BOUNDS[type(f)], f.value))
            elif name in ("spider", "language") and isinstance(f, (EqualTo, In)) and not getattr(self.asked, name):
                getattr(self.asked, name).extend([f.value] if isinstance(f, EqualTo) else f.value)
            elif not (isinstance(f, IsNotNull) and name in ("batch", "place", "value")):
                yield f

    def partitions(self) -> list[Batch]:
        return [Batch(b) for b in self.feed.batches(self.asked) if b > self.after]

    def read(self, partition: Batch | None) -> Iterator[tuple]:
        if partition is None:  # no batch at all
            return
        for place, hit in enumerate(self.feed.hits(partition.name, self.asked)):
            if self.limit and place >= self.limit:
                return
            yield (*(hit.get(source) for source in FIELDS.values()), partition.name, place, json.dumps(hit, ensure_ascii=False))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def register_feed(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def feed_hits(spark: SparkSession, location: str, spiders: Sequence[str] = (), language: str | None = None, since: str | None = None, **options: str) -> DataFrame:
    """Hits of a feed, asked for by spider, language and first date; options are those of the source."""
    register_feed(spark)
    rows = spark.read.format("feed").options(location=location, **options).load()
    if spiders:
        rows = rows.filter(F.col("spider").isin(*spiders))
    if language:
        rows = rows.filter(F.col("language") == language)
    return rows.filter(F.col("date") >= since) if since else rows


def write_feed_lines(hits: DataFrame, location: str) -> None:
    """Hits (spider, language, value) as JSON lines that the folder client reads."""
    hits.select("spider", "language", "value").write.mode("append").partitionBy("spider", "language").text(location)
