"""Maps of vectors that keep neighbours together: pairs from an angular neighbour graph, laid out by gradient steps.

Neighbours come from a forest of random hyperplanes: points that share a leaf in some tree are compared,
all with all of one bounded block. No pass sees all pairs. Each point is drawn to its neighbours
(near pairs), to middling ones of a few random points (mid-near pairs) and away from random others
(further pairs); weights of the three change over three phases. A block of points moves for some steps
by itself, with the places that its pairs have elsewhere as they were, and then places are exchanged.
All draws follow from the seed and the ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.staging import discard, stored

SAMPLE = 20_000


@dataclass(frozen=True)
class Forest:
    trees: int = 12
    #: Points of a leaf that are compared with each other, at most twice as many.
    leaf: int = 256
    seed: int = 5


@dataclass(frozen=True)
class Layout:
    dimensions: int = 2
    #: Near pairs of a point; by the number of points if None.
    neighbours: int | None = None
    mid_near: float = 0.5
    further: float = 2.0
    seed: int = 5
    #: Steps of the three phases.
    steps: tuple[int, int, int] = (100, 100, 250)
    #: Points that move together, and steps between exchanges where there are more.
    block: int = 20_000
    exchange: int = 10
    forest: Forest = Forest()


def neighbour_count(points: int) -> int:
    """10, and 15 more for each power of ten beyond 10,000 points."""
    return 10 if points <= 10_000 else round(10 + 15 * (math.log10(points) - 4))


def unit_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, p): vectors of length 1; those that are null, hold null or non-finite numbers or have no length are left out."""
    p = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), p.alias("p")).filter("id is not null and size(p) > 0 and forall(p, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).filter("norm > 0").select("id", F.transform("p", lambda x: x / F.col("norm")).alias("p"))


def _hyperplanes(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(normal, offset) of the inner nodes of a tree, numbered as a heap: halves between two random points, at the median."""
    nodes = 2**depth - 1
    normals, offsets = np.zeros((nodes, sample.shape[1])), np.full(nodes, np.inf)
    held = {0: sample}
    for node in range(nodes):
        own = held.pop(node, sample[:0])
        right = own[:0]
        if len(own) > 1:
            a, b = own[rng.choice(len(own), 2, replace=False)]
            normals[node] = a - b
            side = own @ normals[node]
            offsets[node] = np.median(side)
            right, own = own[side > offsets[node]], own[side <= offsets[node]]
        held[2 * node + 1], held[2 * node + 2] = own, right
    return normals, offsets


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, points) of runs of equal (tree, leaf) in sorted rows, cut at `most` rows."""
    key, ids, xs, held = None, [], [], 0
    for batch in batches:
        if not len(batch):
            continue
        tree, leaf, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        x = _matrix(batch.column(3))
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
            at = lo
            while at < hi:
                if held and (key != (tree[at], leaf[at]) or held >= most):
                    yield np.concatenate(ids), np.vstack(xs)
                    ids, xs, held = [], [], 0
                key, stop = (tree[at], leaf[at]), min(hi, at + most - held)
                ids.append(own[at:stop])
                xs.append(x[at:stop])
                held, at = held + stop - at, stop
    if held:
        yield np.concatenate(ids), np.vstack(xs)


def angular_neighbours(points: DataFrame, k: int, how: Forest = Forest()) -> DataFrame:
    """(id, neighbour, cosine, place): up to k near points of each of `points` (id, unit p), by cosine, then id. A stored table.

    Near, not always nearest: a neighbour that shares no leaf is missed (recall is measured in a test).
    Copies beyond a block's size meet only those of their block, as near as any.
    """
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n / how.leaf))))
    sample = np.array([r["p"] for r in points.orderBy(F.xxhash64("id", F.lit(how.seed)), "id").limit(SAMPLE).collect()])
    if not len(sample):
        return stored(points.sparkSession.createDataFrame([], "id long, neighbour long, cosine double, place int"), "near")
    rng = np.random.default_rng(how.seed)
    planes = points.sparkSession.sparkContext.broadcast([_hyperplanes(sample, depth, rng) for _ in range(how.trees)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            for tree, (normals, offsets) in enumerate(planes.value):
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > offsets[node])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, dtype=np.int64)), pa.array(node), *batch.columns], names=["tree", "leaf", "id", "p"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _in_blocks(batches, 2 * how.leaf):
            cosine = x @ x.T
            np.fill_diagonal(cosine, -np.inf)
            m = min(k, len(ids) - 1)
            if m > 0:
                order = np.argpartition(-cosine, m - 1, axis=1)[:, :m]
                near = np.take_along_axis(cosine, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(ids[order].reshape(-1)), pa.array(np.clip(near, -1, 1).reshape(-1))], names=["id", "neighbour", "cosine"])

    dealt = points.select("id", "p").mapInArrow(leaves, "tree long, leaf long, id long, p array<double>")
    mixed = F.xxhash64("id", F.lit(how.seed))
    dealt = dealt.repartitionByRange("tree", "leaf", mixed).sortWithinPartitions("tree", "leaf", mixed)
    found = dealt.mapInArrow(compare, "id long, neighbour long, cosine double").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    # A point has at most k rows of each tree.
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return stored(found.withColumn("place", place).filter(F.col("place") <= k), "near")


NEAR, MIDDLE, FURTHER = 0, 1, 2


def _near_pairs(near: DataFrame, k: int) -> DataFrame:
    """(i, j): of each point's candidates the k nearest by distance over how far both points' fourth to sixth neighbours lie."""
    d = F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0)))
    near = near.withColumn("d", d)
    scale = near.filter("place between 4 and 6").groupBy("id").agg(F.greatest(F.avg("d"), F.lit(1e-10)).alias("scale"))
    other = scale.select(F.col("id").alias("neighbour"), F.col("scale").alias("other"))
    met = near.join(scale, "id", "left").join(other, "neighbour", "left")
    scaled = F.col("d") * F.col("d") / (F.coalesce("scale", F.lit(1.0)) * F.coalesce("other", F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("id").orderBy(scaled, "neighbour"))
    return met.withColumn("place", place).filter(F.col("place") <= k).select(F.col("id").alias("i"), F.col("neighbour").alias("j"))


def _random_pairs(points: DataFrame, near: DataFrame, middle: int, further: int, seed: int, leaf: int) -> DataFrame:
    """(i, j, kind): mid-near pairs (the second nearest of six random points) and further pairs (random, no near ones), drawn in random blocks."""
    lists = near.groupBy("i").agg(F.collect_list("j").alias("near"))  # at most as many as near pairs of a point
    rows = points.join(lists.withColumnRenamed("i", "id"), "id", "left").select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("leaf"), "id", "p", F.coalesce("near", F.array().cast("array<long>")).alias("near"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def told(block: list[tuple]) -> pa.RecordBatch:
            ids, x, lists = np.array([r[0] for r in block]), np.vstack([r[1] for r in block]), [r[2] for r in block]
            rng = np.random.default_rng([seed, int(ids.min()) & (2**63 - 1)])
            cosine, n = x @ x.T, len(block)
            out = []
            for k in range(n):
                others = np.delete(np.arange(n), k)
                if not len(others):
                    continue
                for _ in range(middle):
                    six = rng.choice(others, min(6, len(others)), replace=False)
                    out.append((ids[k], ids[six[np.argsort(-cosine[k, six], kind="stable")[min(1, len(six) - 1)]]], MIDDLE))
                far = others[~np.isin(ids[others], lists[k])]
                if len(far):
                    out += [(ids[k], ids[f], FURTHER) for f in rng.choice(far, min(further, len(far)), replace=False)]
            i, j, kind = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(kind, pa.int32())], names=["i", "j", "kind"])

        for batch in batches:
            if len(batch):
                held += zip(batch.column(2).to_pylist(), _matrix(batch.column(3)), batch.column(4).to_pylist(), strict=True)
            while len(held) >= 4 * leaf:
                yield told(held[: 2 * leaf])
                held = held[2 * leaf :]
        if held:
            for lo in range(0, len(held), 2 * leaf):
                yield told(held[lo : lo + 2 * leaf])

    mixed = F.xxhash64("id", F.lit(seed), F.lit("block"))
    return rows.repartitionByRange(mixed).sortWithinPartitions(mixed).mapInArrow(draw, "i long, j long, kind int")


def _weights(step: int, steps: tuple[int, int, int]) -> tuple[float, float, float]:
    """Of near, mid-near and further pairs in a step."""
    first, second, _ = steps
    if step < first:
        return 2.0, 1000.0 * (1 - step / first) + 3.0 * step / first, 1.0
    return (3.0, 3.0, 1.0) if step < first + second else (1.0, 0.0, 1.0)


def _move(y: np.ndarray, m: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, outside: np.ndarray, span: range, how: Layout) -> None:
    """Adaptive gradient steps of the places y, in place; j beyond len(y) counts on in `outside`, which stays."""
    near, middle = kind == NEAR, kind == MIDDLE
    scale = np.where(near, 20.0, np.where(middle, 20_000.0, -2.0))
    reach = np.where(near, 10.0, np.where(middle, 10_000.0, 1.0))
    for step in span:
        w = np.choose(kind, _weights(step, how.steps))
        both = np.vstack([y, outside])
        apart = y[i] - both[j]
        d = 1 + (apart * apart).sum(axis=1)
        pull = (w * scale / (reach + d) ** 2)[:, None] * apart
        gradient = np.stack([np.bincount(i, weights=pull[:, c], minlength=len(y)) for c in range(y.shape[1])], axis=1)
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        y -= np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1)) * m / (np.sqrt(v) + 1e-7)


def laid_out(vectors: DataFrame, key: str = "doc_id", vector: str = "features", how: Layout = Layout()) -> DataFrame:
    """(key, y array): places of the vectors that have a direction; a stored table."""
    points = stored(unit_rows(vectors, key, vector), "unit")
    n, width = points.count(), how.dimensions
    k = min(how.neighbours or neighbour_count(n), max(1, n - 1))
    near = angular_neighbours(points, min(n - 1, k + 50) if n > 1 else 1, how.forest)
    pairs = stored(_near_pairs(near, k), "near-pairs")
    drawn = _random_pairs(points, pairs, round(k * how.mid_near), round(k * how.further), how.seed, how.forest.leaf)
    pairs = stored(pairs.withColumn("kind", F.lit(NEAR)).unionByName(drawn), "pairs")
    # Either end of a pair moves.
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "kind"))
    blocks = max(1, -(-n // how.block))
    chance = lambda c: F.pmod(F.xxhash64("id", F.lit(how.seed), F.lit(c)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5
    zero = F.array_repeat(F.lit(0.0), width)
    # Neighbours are mostly in one block if blocks are ranges along one random direction.
    line = np.random.default_rng(how.seed + 1)
    first = points.select(F.size("p").alias("dim")).head()
    direction = F.array(*[F.lit(float(x)) for x in line.standard_normal(first["dim"] if first else 1)])
    along = F.aggregate(F.zip_with("p", direction, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    cuts = points.agg(F.percentile_approx(along, [b / blocks for b in range(1, blocks)], 10_000)).head()[0] if blocks > 1 else []
    block = sum([(along > F.lit(c)).cast("int") for c in cuts], F.lit(0)) if cuts else F.lit(0)
    state = stored(points.select("id", block.alias("block"), F.array(*[chance(c) * 1e-4 for c in range(width)]).alias("y"), zero.alias("m"), zero.alias("v")), "places")
    homes = state.select(F.col("id").alias("i"), "block")
    both = stored(both.join(homes, "i"), "both") if blocks > 1 else both.withColumn("block", F.lit(0))
    total = sum(how.steps)
    size = how.exchange if blocks > 1 else total  # with one block nothing lies elsewhere
    schema = "id long, block int, y array<double>, m array<double>, v array<double>"

    def mover(span: range):
        def run(own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
            ids = own["id"].to_numpy(dtype=np.int64)
            order = np.argsort(ids)
            ids = ids[order]
            y, m, v = (np.stack(own[c].to_list())[order].astype(float) for c in ("y", "m", "v"))
            met = met.sort_values(["i", "j", "kind"])
            j = met["j"].to_numpy(dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, j), len(ids) - 1)
            here = ids[at] == j
            others, index = np.unique(j[~here], return_index=True)
            outside = np.stack(met["there"][~here].iloc[index].to_list()) if len(others) else np.zeros((0, width))
            at[~here] = len(ids) + np.searchsorted(others, j[~here])
            _move(y, m, v, np.searchsorted(ids, met["i"].to_numpy(dtype=np.int64)), at, met["kind"].to_numpy(), outside, span, how)
            return pd.DataFrame({"id": ids, "block": own["block"].iloc[0], "y": list(y), "m": list(m), "v": list(v)})

        return run

    for start in range(0, total, size):
        if blocks > 1:
            ends = both.join(state.select(F.col("id").alias("j"), F.col("block").alias("far"), F.col("y").alias("there")), "j")
            ends = ends.select(F.col("block").alias("home"), "i", "j", "kind", F.when(F.col("far") != F.col("block"), F.col("there")).alias("there"))
        else:
            ends = both.select(F.col("block").alias("home"), "i", "j", "kind", F.lit(None).cast("array<double>").alias("there"))
        moved = state.groupBy("block").cogroup(ends.groupBy("home")).applyInPandas(mover(range(start, min(total, start + size))), schema)
        before, state = state, stored(moved, "places")
        discard(before)
    return state.select(F.col("id").alias(key), "y")
