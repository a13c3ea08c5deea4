"""Line dedup: lines that an earlier document holds, told as compressed bitmaps of the lines to keep.

Hashes of line keys are range-partitioned together with document and place, so a line that a third
of all documents hold spreads over many ranges. Each range is sorted and streamed once: the first
document of a run of equal hashes owns the line, later ones lose it. A run that crosses from one
range to the next is settled by a table of the ranges' edges, two rows a range.

Cases: a null text is one empty line, as an empty one is. A null doc_id stands as the largest one.
Rows that share a doc_id are one document: they take no lines from each other. Keys shorter than
`min_chars` code points stay everywhere, as do all copies of a line within its owner. Rows, texts and
lines may be of any number and length; an empty table gives no rows. Other columns are not read by
`keep_bitmaps` and come through `keep_lines` unchanged, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, checked_broadcast, stored, tidy
from corpusloom.sources.tables import spread

#: Bytes that are stripped from a line before it is compared.
BLANK_BYTES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class LineRule:
    #: Code points that a key needs to be judged.
    min_chars: int = 10
    #: Documents with dropped lines up to which their bitmaps are broadcast; beyond, texts are shuffled.
    max_broadcast: int = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK_BYTES)), UPPER, UPPER.lower())


def _document(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def _keyed(docs: DataFrame, rule: LineRule) -> DataFrame:
    """h, g (128 bits of a key's hash), doc, text_hash, at: one row for each line that is long enough."""
    texts = docs.select(_document(F.col("doc_id")).alias("doc"), F.col("text").cast("string").alias("text"))
    rows = texts.select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    rows = rows.select("doc", "text_hash", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= rule.min_chars)
    return rows.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "doc", "text_hash", "at")


#: What `_stream` tells: lines that go, lines of a range's first run that may go, edges of ranges.
GONE, OPEN, EDGE = 0, 1, 2
TOLD = "kind int, h long, g long, doc long, text_hash long, at int"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: what is not its run's first document goes.

    Only the first run may have begun in an earlier range, so its owner's lines are left open, and
    the owners of the first and the last run are told as edges.
    """
    names = ["kind", "h", "g", "doc", "text_hash", "at"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    make = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    run = None  # key and owner of the run that is open
    first = None
    for batch in batches:
        if not len(batch):
            continue
        h, g, doc, text_hash, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
        owners = doc[starts]
        if run is not None and run[:2] == (int(h[0]), int(g[0])):
            owners[0] = run[2]
        if first is None:
            first = (int(h[0]), int(g[0]), int(owners[0]))
            yield make([EDGE], [first[0]], [first[1]], [first[2]], [0], [0])
        owner = np.repeat(owners, np.diff(np.append(starts, len(h))))
        mine = (h == first[0]) & (g == first[1]) & (doc == first[2])
        told = np.flatnonzero((doc != owner) | mine)
        if len(told):
            yield make(np.where(mine[told], OPEN, GONE), h[told], g[told], doc[told], text_hash[told], at[told])
        run = (int(h[-1]), int(g[-1]), int(owners[-1]))
    if run is not None and run != first:
        yield make([EDGE], [run[0]], [run[1]], [run[2]], [0], [0])


def packed(dropped: np.ndarray) -> bytes:
    """The bitmap of lines to keep, up to the line after the last that goes; bits are counted from the least of each byte."""
    bits = np.ones(int(dropped.max()) + 2, dtype=bool)
    bits[dropped] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpacked(bitmap: bytes) -> np.ndarray:
    """True for lines to keep; its last bit, always set, is that of the line after the last that goes. Lines beyond are kept."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little").astype(bool)
    return bits[: int(np.flatnonzero(bits)[-1]) + 1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column(2)
        ends, values = gone.offsets.to_numpy(), gone.values.to_numpy()
        sets = [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        keep = pa.array([packed(s) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), keep], names=["doc", "text_hash", "n_dropped", "keep"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = [unpacked(bitmap) for bitmap in batch.column(3).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(f) for f in flags], dtype=np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flags, np.zeros(0, bool)])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["doc", "text_hash", "n_dropped", "flags"])


def changed_bitmaps(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """doc, text_hash, n_dropped, keep for each text that loses lines; a stored table."""
    scratch = Scratch()
    order = ["h", "g", "doc", "text_hash", "at"]
    ranged = _keyed(spread(docs, "doc_id"), rule).repartitionByRange(*order).sortWithinPartitions(*order)
    told = scratch.stored(ranged.mapInArrow(tidy(_stream), TOLD), "lines")
    # Two rows a range at most, however many lines there are.
    owners = F.broadcast(told.filter(F.col("kind") == EDGE).groupBy("h", "g").agg(F.min("doc").alias("owner")))
    settled = told.filter(F.col("kind") == OPEN).join(owners, ["h", "g"]).filter("owner < doc")
    gone = told.filter(F.col("kind") == GONE).select("doc", "text_hash", "at").unionByName(settled.select("doc", "text_hash", "at"))
    found = gone.groupBy("doc", "text_hash").agg(F.collect_set("at").alias("gone")).mapInArrow(tidy(_pack), "doc long, text_hash long, n_dropped long, keep binary")
    out = stored(found, "bitmaps")
    scratch.clear()
    return out


def keep_bitmaps(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep (null: all lines) for each row of `docs`; no texts."""
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"))
    found = changed_bitmaps(docs, rule).withColumnRenamed("doc", "__doc").withColumnRenamed("text_hash", "__hash")
    met = rows.join(found, (_document(rows["doc_id"]) == F.col("__doc")) & (rows["text_hash"] == F.col("__hash")), "left")
    return met.select("doc_id", "text_hash", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def keep_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """row (all columns of `docs`), n_lines, n_dropped, kept_text for each row of `docs`."""
    found = changed_bitmaps(docs, rule)
    _, small = checked_broadcast(found, rule.max_broadcast)
    flags = found.mapInArrow(tidy(_unpack), "doc long, text_hash long, n_dropped long, flags array<boolean>")
    flags = F.broadcast(flags) if small else flags
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    met = rows.join(flags, (_document(F.col("row.doc_id")) == F.col("doc")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    left = F.array_join(F.filter(lines_of(text), lambda line, k: F.coalesce(F.get("flags", k), F.lit(True))), "\n")
    return met.select(
        "row",
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("flags").isNull(), F.coalesce(text, F.lit(""))).otherwise(left).alias("kept_text"),
    )
