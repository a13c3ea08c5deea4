"""Exact nearest neighbours of points in few dimensions, however unevenly they lie.

A k-d tree cuts space into leaves by medians of a bounded sample, which decides how even the leaves
are and nothing else. Points sorted by leaf and id become blocks of a bounded size, one row each, with
exact bounding boxes: a leaf that holds a third of all points is many blocks. The boxes, some thousands
however many points there are, are all that tasks share. A block of queries visits blocks in the order
of their distance and stops once no unvisited box can hold a nearer point, or an equally near one of
less id. So a far point costs nothing, and a spot that holds all points costs each query its first blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.staging import discard, stored

#: Points of a block, at least, where there are more; blocks, at most about twice as many.
PER_BLOCK, MOST_BLOCKS = 512, 4096
#: Points whose medians cut space.
SAMPLE = 20_000
#: Visits of a block of queries in a round: the first, and the most.
FIRST, MOST_VISITS = 2, 16
#: Uses of a block in a round beyond which it is dealt to more tasks.
USES = 64


class Boxes(NamedTuple):
    """Of all blocks: number, least and greatest coordinates, least id."""

    block: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


@dataclass(frozen=True)
class Space:
    #: block long, ids binary (int64), points binary (float64, row by row).
    blocks: DataFrame
    boxes: Broadcast
    dim: int
    n: int


def _tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, cut) of each inner node, numbered as a heap; what is greater than the cut goes right."""
    dims, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    held = {0: sample}
    for node in range(2**depth - 1):
        own = held.pop(node, sample[:0])
        right = own[:0]
        if len(own) > 1:
            dims[node] = j = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            x = np.sort(own[:, j])
            below = x[x < x[-1]]
            if len(below):
                cuts[node] = below[min(len(below) - 1, (len(x) - 1) // 2)]
                right = own[own[:, j] > cuts[node]]
                own = own[own[:, j] <= cuts[node]]
        held[2 * node + 1], held[2 * node + 2] = own, right
    return dims, cuts


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def space_of(points: DataFrame, dim: int, per_block: int = PER_BLOCK) -> Space:
    """The space of points (id long, p array<double> of `dim` numbers, none null)."""
    points = points.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"))
    n = points.count()
    size = max(per_block, -(-n // MOST_BLOCKS))
    sample = points.orderBy(F.xxhash64("id", "p"), "id").limit(SAMPLE).collect()
    depth = max(0, math.ceil(math.log2(max(1, n / size))))
    dims, cuts = _tree(np.array([r["p"] for r in sample], dtype=np.float64).reshape(-1, dim), depth)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), dim)
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=["id", "p", "leaf"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        leaf, ids, xs, held = None, [], [], 0

        def told():
            nonlocal number, ids, xs, held
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary())], names=["block", "ids", "points"])
            number, ids, xs, held = number + 1, [], [], 0
            return row

        for batch in batches:
            own, x, at = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1), dim), batch.column(2).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(own):
                if held and (at[start] != leaf or held >= 2 * size):
                    yield told()
                leaf = at[start]
                stop = min(start + 2 * size - held, int(np.searchsorted(at, leaf, side="right")))
                ids.append(own[start:stop])
                xs.append(x[start:stop])
                held, start = held + stop - start, stop
        if held:
            yield told()

    dealt = points.mapInArrow(leaves, "id long, p array<double>, leaf long").repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id")
    blocks = stored(dealt.mapInArrow(cut, "block long, ids binary, points binary"), "blocks")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(b, dtype=np.float64).reshape(-1, dim) for b in batch.column(2).to_pylist()]
            least = [int(np.frombuffer(b, dtype=np.int64).min()) for b in batch.column(1).to_pylist()]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.min(axis=0).tolist() for b in x], kind), pa.array([b.max(axis=0).tolist() for b in x], kind), pa.array(least, pa.int64())], names=["block", "low", "high", "least"])

    # Some thousands of rows, whatever the number of points.
    told = blocks.mapInArrow(boxes, "block long, low array<double>, high array<double>, least long").orderBy("block").collect()
    shape = lambda name: np.array([r[name] for r in told], dtype=np.float64).reshape(-1, dim)
    shared = points.sparkSession.sparkContext.broadcast(Boxes(np.array([r["block"] for r in told], dtype=np.int64), shape("low"), shape("high"), np.array([r["least"] for r in told], dtype=np.int64)))
    return Space(blocks, shared, dim, n)


def gap2(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) from boxes (columns); rounding keeps them at most those of points inside."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0)
        out += gap * gap
    return out


def pair2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all of x from all of y, dimension by dimension."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        out += d * d
    return out


def visited(space: Space, state: DataFrame, columns: str, blocks: DataFrame, update: Callable[[dict, pd.DataFrame, Boxes], dict]) -> DataFrame:
    """Rows of `state` (qb, next array<long>, and `columns`) once they ask for no more blocks.

    In each round the blocks that a row asks for are brought to it, and `update(row, blocks, boxes)`
    gives the row as it is then, with the blocks that it asks for next.
    """
    schema = f"qb long, next array<long>, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    shared, done = space.boxes, []

    def step(own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in names})
        return pd.DataFrame([update(own.iloc[0].to_dict(), met, shared.value)])[names]

    while True:
        over = stored(state.filter("size(next) = 0"), "settled")
        done.append(over)
        live = state.filter("size(next) > 0")
        if not live.take(1):
            break
        asked = live.select("qb", F.explode("next").alias("block"))
        uses = asked.groupBy("block").count().withColumn("parts", F.ceil(F.col("count") / USES)).select("block", "parts")
        pairs = asked.join(uses, "block").withColumn("part", F.pmod(F.xxhash64("qb"), F.col("parts")))
        copies = blocks.join(uses, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        brought = pairs.select(F.col("qb").alias("asks"), "block", "part").join(copies, ["block", "part"]).drop("part")
        new = live.groupBy("qb").cogroup(brought.groupBy("asks")).applyInPandas(step, schema)
        before, state = state, stored(new, "visited")
        if len(done) > 1:
            discard(before)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def asked_next(gaps: np.ndarray, wanted: np.ndarray, boxes: Boxes, seen: np.ndarray) -> np.ndarray:
    """Numbers of the nearest unvisited boxes that some query wants; as many as were seen so far, within limits.

    gaps: least gap of each box over all queries; wanted: whether some query may find better there.
    """
    open_ = np.flatnonzero(wanted & ~np.isin(boxes.block, seen))
    first = open_[np.lexsort((boxes.least[open_], gaps[open_]))]
    return boxes.block[first[: min(MOST_VISITS, max(FIRST, len(seen)))]]


class _Best(NamedTuple):
    d2: np.ndarray
    near: np.ndarray


def _better(best: _Best, ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, k: int) -> _Best:
    """The k best of those so far and one block's points, by distance, then id."""
    for lo in range(0, len(x), 512):
        part = slice(lo, lo + 512)
        d2 = pair2(x[part], y)
        d2[ids[part, None] == other[None, :]] = np.inf
        rows = np.flatnonzero((d2 <= best.d2[part, -1:]).any(axis=1) & (d2 < np.inf).any(axis=1))
        if len(rows):
            at = lo + rows
            all_d = np.hstack([best.d2[at], d2[rows]])
            all_i = np.hstack([best.near[at], np.where(np.isinf(d2[rows]), NONE, other[None, :])])
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best.d2[at] = np.take_along_axis(all_d, order, 1)
            best.near[at] = np.take_along_axis(all_i, order, 1)
    return best


#: Stands for no neighbour yet; greater than all ids.
NONE = np.iinfo(np.int64).max


def nearest(space: Space, k: int, selected: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, d2, place): for each point, or each of `selected` (id), its k nearest others by distance, then id."""
    if not space.n:
        return space.blocks.sparkSession.createDataFrame([], "id long, neighbour long, d2 double, place int")
    dim, shared = space.dim, space.boxes

    def plan(x: np.ndarray, best: _Best, seen: np.ndarray, boxes: Boxes) -> np.ndarray:
        least, wanted = np.full(len(boxes.block), np.inf), np.zeros(len(boxes.block), dtype=bool)
        apart = np.maximum(np.maximum(boxes.low - x.max(axis=0), x.min(axis=0) - boxes.high), 0.0)
        near = np.flatnonzero(sum(apart[:, j] * apart[:, j] for j in range(dim)) <= best.d2[:, -1].max())
        for lo in range(0, len(x), 512):
            g = gap2(x[lo : lo + 512], boxes.low[near], boxes.high[near])
            last, last_id = best.d2[lo : lo + 512, -1:], best.near[lo : lo + 512, -1:]
            wanted[near] |= ((g < last) | ((g == last) & (boxes.least[near][None, :] < last_id))).any(axis=0)
            least[near] = np.minimum(least[near], g.min(axis=0))
        return asked_next(least, wanted, boxes, seen)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = len(ids) // 8
                best = _Best(np.full((m, k), np.inf), np.full((m, k), NONE))
                asked = plan(np.frombuffer(points).reshape(m, dim), best, np.zeros(0, np.int64), shared.value)
                yield pa.RecordBatch.from_pylist([{"qb": block, "next": asked.tolist(), "ids": ids, "points": points, "d2": best.d2.tobytes(), "near": best.near.tobytes(), "seen": b""}], schema=pa.schema([("qb", pa.int64()), ("next", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("ids", "points", "d2", "near", "seen"))]))

    def update(row: dict, met: pd.DataFrame, boxes: Boxes) -> dict:
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        x = np.frombuffer(row["points"]).reshape(len(ids), dim)
        best = _Best(np.frombuffer(row["d2"]).reshape(len(ids), k).copy(), np.frombuffer(row["near"], dtype=np.int64).reshape(len(ids), k).copy())
        for other, points in zip(met["ids"], met["points"], strict=True):
            other = np.frombuffer(other, dtype=np.int64)
            best = _better(best, ids, x, other, np.frombuffer(points).reshape(len(other), dim), k)
        seen = np.concatenate([np.frombuffer(row["seen"], dtype=np.int64), met["block"].to_numpy(dtype=np.int64)])
        return row | {"next": plan(x, best, seen, boxes).tolist(), "d2": best.d2.tobytes(), "near": best.near.tobytes(), "seen": seen.tobytes()}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, d2, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, near, d2 = (np.frombuffer(b, dtype=t) for b, t in ((ids, np.int64), (near, np.int64), (d2, np.float64)))
                real = near != NONE
                place = np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[real]), pa.array(near[real]), pa.array(d2[real]), pa.array(place[real])], names=["id", "neighbour", "d2", "place"])

    queries = space.blocks if selected is None else _chosen(space, selected)
    columns = "ids binary, points binary, d2 binary, near binary, seen binary"
    state = stored(queries.mapInArrow(start, f"qb long, next array<long>, {columns}"), "queries")
    found = visited(space, state, columns, space.blocks, update)
    return found.select("ids", "d2", "near").mapInArrow(told, "id long, neighbour long, d2 double, place int")


def _chosen(space: Space, selected: DataFrame) -> DataFrame:
    """The blocks with only those points whose ids are selected."""
    dim = space.dim
    points = space.blocks.mapInArrow(_flat(dim), "block long, id long, p array<double>")
    kept = points.join(selected.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy(dtype=np.int64).tobytes()], "points": [np.stack(rows["p"].to_list()).astype(np.float64).tobytes()]})

    return kept.groupBy("block").applyInPandas(gather, "block long, ids binary, points binary")


def _flat(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, flat = np.frombuffer(ids, dtype=np.int64), np.frombuffer(points)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), lists], names=["block", "id", "p"])

    return run
