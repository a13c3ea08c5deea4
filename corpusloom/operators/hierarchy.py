"""Hierarchical density clustering and its validity.

Points are as far apart as the greatest of their distance and of how far either lies from its
`min_samples`-th other point. The spanning tree of least weight under that distance grows by Borůvka
rounds: a component takes its lightest way out, known from lists of nearest neighbours where these
reach far enough, and from a search over blocks of space where they do not. Cutting the tree from its
lightest edge upwards tells when each point's component first has `min_cluster_size` points: the
clusters are the components that do so without holding another one (the leaves of the condensed
tree). A point's probability is its cluster's least such weight over its own.

Copies of a point are told apart by no distance, so one of them, with their number, stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import connected_components
from corpusloom.operators.neighbours import PER_BLOCK, Boxes, Space, asked_next, gap2, nearest, pair2, space_of, visited
from corpusloom.operators.stats import NOISE
from corpusloom.sources.staging import if_small, stored

#: Neighbours of a point that are kept as ways out.
WAYS = 32
#: Edges that one task joins in order of their weights.
BATCH = 200_000


@dataclass(frozen=True)
class Hierarchy:
    min_cluster_size: int = 5
    #: Other points within the distance that a point is dense by; `min_cluster_size` if None.
    min_samples: int | None = None
    #: 'euclidean', or 'cosine': one less the cosine of the angle.
    metric: str = "cosine"
    per_block: int = PER_BLOCK
    batch: int = BATCH

    @property
    def samples(self) -> int:
        return self.min_cluster_size if self.min_samples is None else self.min_samples


@dataclass(frozen=True)
class Tree:
    """weight is in units of the metric; stored tables."""

    #: key, id: the point that stands for a row; rows without a direction under 'cosine' are not here.
    members: DataFrame
    #: id, size: points and how many rows each stands for.
    points: DataFrame
    #: a, b, weight: edges between points.
    edges: DataFrame
    #: id, core: the distance that a point is dense by.
    cores: DataFrame


def _distinct(rows: DataFrame, key: str, how: Hierarchy) -> tuple[DataFrame, DataFrame]:
    p = F.transform("p", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    rows = rows.select(F.col(key).cast("long").alias("key"), p.alias("p")).filter("p is not null and size(p) > 0 and forall(p, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    if how.metric == "cosine":
        # Divided by the largest entry first, so that no square is lost.
        most = F.aggregate("p", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
        rows = rows.filter(most > 0).withColumn("p", F.transform("p", lambda x: x / most))
        norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("p", F.transform("p", lambda x: x / norm))
    groups = stored(rows.groupBy("p").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("size")), "distinct")
    return stored(rows.join(groups.select("p", "id"), "p").select("key", "id"), "members"), groups


def _cores(near: DataFrame, points: DataFrame, samples: int) -> DataFrame:
    """(id, core2): the squared distance of the `samples`-th other row; all there are where there are fewer."""
    sizes = points.select(F.col("id").alias("neighbour"), "size")
    found = near.join(sizes, "neighbour")
    upto = F.sum("size").over(Window.partitionBy("id").orderBy("place"))
    met = found.select("id", "d2", upto.alias("upto"))
    # Copies of the point itself come first, at no distance.
    own = points.select("id", (F.col("size") - 1).alias("own"))
    reach = own.join(met, "id", "left").groupBy("id", "own").agg(F.min(F.when(F.col("own") + F.col("upto") >= samples, F.col("d2"))).alias("first"), F.max("d2").alias("last"))
    return reach.select("id", F.when(F.col("own") >= samples, F.lit(0.0)).otherwise(F.coalesce("first", "last", F.lit(0.0))).alias("core2"))


def _joined(labels: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Labels after each source label is replaced by its target, which is less."""
    names = np.unique(labels)
    to = names.copy()
    to[np.searchsorted(names, source)] = target
    while True:
        far = to[np.searchsorted(names, to)]
        if (far == to).all():
            return to[np.searchsorted(names, labels)]
        to = far


def _within(rows: pd.DataFrame) -> pd.DataFrame:
    """Borůvka rounds inside one block, as far as its own ways out settle them: rows (a, b, v2, edge) of edges, and of labels (a: point, b: label)."""
    q, x, v, lb = (rows[c].to_numpy() for c in ("q", "x", "v2", "lb"))
    ids = np.unique(q)
    at = np.searchsorted(ids, x)
    inside = ids[np.minimum(at, len(ids) - 1)] == x
    qi, xi = np.searchsorted(ids, q), np.minimum(at, len(ids) - 1)
    label = ids.copy()
    edges = []
    while True:
        own, other = label[qi], np.where(inside, label[xi], -1)
        out = np.flatnonzero(~inside | (own != other))
        if not len(out):
            break
        order = out[np.lexsort((other[out], ~inside[out], v[out], own[out]))]
        first = order[np.concatenate(([True], own[order][1:] != own[order][:-1]))]
        names, place = np.unique(own, return_inverse=True)
        least = np.full(len(names), np.inf)
        np.minimum.at(least, place, lb)
        sure = first[inside[first] & (v[first] <= least[np.searchsorted(names, own[first])]) & (other[first] < own[first])]
        if not len(sure):
            break
        edges += [(int(q[k]), int(x[k]), float(v[k])) for k in sure]
        label = _joined(label, own[sure], other[sure])
    a, b, v2 = zip(*edges, strict=True) if edges else ((), (), ())
    nothing = np.zeros(len(ids))
    return pd.DataFrame({"a": np.concatenate([ids, np.array(a, np.int64)]), "b": np.concatenate([label, np.array(b, np.int64)]), "v2": np.concatenate([nothing, np.array(v2, float)]), "edge": np.arange(len(ids) + len(a)) >= len(ids)})


def _ways_out(space: Space, labels: DataFrame, cores: DataFrame, bounds: DataFrame) -> DataFrame:
    """(comp, v2, a, b): the lightest edge that leaves each component, by a search over blocks; `bounds` (comp, v2, a, b) are known edges."""
    dim, shared = space.dim, space.boxes
    known = labels.join(cores, "id").join(bounds.select("comp", F.col("v2").alias("bound")), "comp", "left").select("id", "comp", "core2", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    homes = space.blocks.mapInArrow(_ids, "block long, id long")

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        flat = lambda c, t: rows[c].to_numpy(dtype=t).tobytes()
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "comp": [flat("comp", np.int64)], "core2": [flat("core2", np.float64)], "bound": [flat("bound", np.float64)]})

    marks = homes.join(known, "id").groupBy("block").applyInPandas(gather, "block long, comp binary, core2 binary, bound binary")
    marked = stored(space.blocks.join(marks, "block"), "marked")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            comps = [np.frombuffer(c, dtype=np.int64) for c in batch.column(1).to_pylist()]
            least = [float(np.frombuffer(c).min()) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(c[0]) if (c == c[0]).all() else None for c in comps], pa.int64()), pa.array(least)], names=["block", "only", "core2"])

    told = marked.select("block", "comp", "core2").mapInArrow(summary, "block long, only long, core2 double").orderBy("block").collect()  # one row a block
    only = np.array([NOISE - 1 if r["only"] is None else r["only"] for r in told], dtype=np.int64)
    mixed = np.array([r["only"] is None for r in told])
    least_core = np.array([r["core2"] for r in told])
    outline = marked.sparkSession.sparkContext.broadcast((only, mixed, least_core))

    def points_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """In order of ids, as the space has them and `gather` puts them."""
        return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["points"]).reshape(-1, dim)

    def plan(x, comp, core, best, names, seen, boxes: Boxes) -> np.ndarray:
        only, mixed, least_core = outline.value
        bound = best[np.searchsorted(names, comp)]
        least, wanted = np.full(len(boxes.block), np.inf), np.zeros(len(boxes.block), dtype=bool)
        for lo in range(0, len(x), 512):
            part = slice(lo, lo + 512)
            g = np.maximum(np.maximum(gap2(x[part], boxes.low, boxes.high), least_core[None, :]), core[part, None])
            foreign = mixed[None, :] | (only[None, :] != comp[part, None])
            g = np.where(foreign, g, np.inf)
            wanted |= (g < bound[part, None]).any(axis=0)
            least = np.minimum(least, g.min(axis=0))
        return asked_next(least, wanted, boxes, seen)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, x = points_of(r)
                comp, core, bound = np.frombuffer(r["comp"], dtype=np.int64), np.frombuffer(r["core2"]), np.frombuffer(r["bound"])
                names, first = np.unique(comp, return_index=True)
                best = bound[first]
                asked = plan(x, comp, core, best, names, np.zeros(0, np.int64), shared.value)
                row = {"qb": r["block"], "next": asked.tolist(), **{c: r[c] for c in ("ids", "points", "comp", "core2")}, "best": best.tobytes(), "a": np.full(len(names), -1, np.int64).tobytes(), "b": np.full(len(names), -1, np.int64).tobytes(), "seen": b""}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("qb", pa.int64()), ("next", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("ids", "points", "comp", "core2", "best", "a", "b", "seen"))]))

    def update(row: dict, met: pd.DataFrame, boxes: Boxes) -> dict:
        ids, x = points_of(row)
        comp, core = np.frombuffer(row["comp"], dtype=np.int64), np.frombuffer(row["core2"])
        names, place = np.unique(comp, return_inverse=True)
        best, a, b = np.frombuffer(row["best"]).copy(), np.frombuffer(row["a"], dtype=np.int64).copy(), np.frombuffer(row["b"], dtype=np.int64).copy()
        for r in met.to_dict("records"):
            other, y = points_of(r)
            their_comp, their_core = np.frombuffer(r["comp"], dtype=np.int64), np.frombuffer(r["core2"])
            for lo in range(0, len(x), 512):
                part = slice(lo, lo + 512)
                v = np.maximum(np.maximum(pair2(x[part], y), core[part, None]), their_core[None, :])
                v[comp[part, None] == their_comp[None, :]] = np.inf
                j = v.argmin(axis=1)
                found = v[np.arange(len(v)), j]
                for k in np.argsort(found, kind="stable"):
                    c = place[lo + k]
                    if found[k] < best[c]:
                        best[c], a[c], b[c] = found[k], ids[lo + k], other[j[k]]
        seen = np.concatenate([np.frombuffer(row["seen"], dtype=np.int64), met["block"].to_numpy(dtype=np.int64)])
        asked = plan(x, comp, core, best, names, seen, boxes)
        return row | {"next": asked.tolist(), "best": best.tobytes(), "a": a.tobytes(), "b": b.tobytes(), "seen": seen.tobytes()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for comp, best, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.frombuffer(a, dtype=np.int64)
                real = a >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(comp, dtype=np.int64))[real]), pa.array(np.frombuffer(best)[real]), pa.array(a[real]), pa.array(np.frombuffer(b, dtype=np.int64)[real])], names=["comp", "v2", "a", "b"])

    columns = "ids binary, points binary, comp binary, core2 binary, best binary, a binary, b binary, seen binary"
    state = stored(marked.mapInArrow(start, f"qb long, next array<long>, {columns}"), "searches")
    over = visited(space, state, columns, marked.drop("bound"), update)
    rows = over.select("comp", "best", "a", "b").mapInArrow(found, "comp long, v2 double, a long, b long")
    rows = rows.unionByName(bounds)  # which stand where nothing lighter was found
    return rows.groupBy("comp").agg(F.min(F.struct("v2", "a", "b")).alias("e")).select("comp", "e.*")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], names=["block", "id"])


def spanning_tree(rows: DataFrame, key: str = "doc_id", how: Hierarchy = Hierarchy()) -> Tree:
    """The spanning tree of least weight of rows (key, p array) under mutual reachability.

    Rows whose p is null, empty or holds null or non-finite numbers are left out; so are, under 'cosine',
    those of length 0. All other p have one length.
    """
    members, groups = _distinct(rows, key, how)
    points = groups.select("id", "size")
    spark = rows.sparkSession
    first = groups.select(F.size("p").alias("dim")).head()
    if first is None:
        return Tree(members, points, spark.createDataFrame([], "a long, b long, weight double"), spark.createDataFrame([], "id long, core double"))
    space = space_of(groups, first["dim"], how.per_block)
    k = max(1, min(space.n - 1, max(how.samples, WAYS)))
    near = stored(nearest(space, k), "near")
    cores = stored(_cores(near, points, how.samples), "cores")
    theirs = cores.select(F.col("id").alias("neighbour"), F.col("core2").alias("their"))
    ways = near.filter(F.col("place") <= WAYS).join(cores, "id").join(theirs, "neighbour")
    last = near.filter(F.col("place") <= WAYS).groupBy("id").agg(F.max("d2").alias("last"), F.count(F.lit(1)).alias("n"))
    # What a point's list does not hold is at least as far as its last entry; a list of all points leaves nothing out.
    floor = last.join(cores, "id").select("id", F.when(F.col("n") >= space.n - 1, F.lit(float("inf"))).otherwise(F.greatest("last", "core2")).alias("lb"))
    homes = space.blocks.mapInArrow(_ids, "block long, id long")
    ways = ways.join(floor, "id").join(homes, "id").select("block", F.col("id").alias("q"), F.col("neighbour").alias("x"), F.greatest("d2", "core2", "their").alias("v2"), "lb")
    ways = stored(ways, "ways")
    local = stored(ways.groupBy("block").applyInPandas(_within, "a long, b long, v2 double, edge boolean"), "local")
    parts = [local.filter("edge").select("a", "b", "v2")]
    labels = homes.join(local.filter("not edge").select(F.col("a").alias("id"), F.col("b").alias("comp")), "id", "left")
    labels = stored(labels.select("id", F.coalesce("comp", "id").alias("comp")), "labels")
    while labels.select("comp").distinct().limit(2).count() > 1:
        own, other = labels.select(F.col("id").alias("q"), F.col("comp").alias("c")), labels.select(F.col("id").alias("x"), F.col("comp").alias("d"))
        bounded = ways.join(own, "q").join(other, "x")
        leaving = F.when(F.col("c") != F.col("d"), F.struct("v2", F.col("q").alias("a"), F.col("x").alias("b")))
        best = stored(bounded.groupBy("c").agg(F.min(leaving).alias("e"), F.min("lb").alias("lb")).select(F.col("c").alias("comp"), "e.*", "lb"), "best")
        sure = best.filter("v2 is not null and v2 <= lb").select("comp", "v2", "a", "b")
        picked = stored(_towards_less(sure, labels), "picked")
        if not picked.take(1):
            picked = stored(_towards_less(_ways_out(space, labels, cores, best.filter("v2 is not null").select("comp", "v2", "a", "b")), labels), "picked")
        parts.append(picked.select("a", "b", "v2"))
        joined = connected_components(picked.select(F.col("comp").alias("a"), F.col("target").alias("b")))
        moved = if_small(joined.select(F.col("id").alias("comp"), "label"))
        labels = stored(labels.join(moved, "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "labels")
    edges = parts[0]
    for more in parts[1:]:
        edges = edges.unionByName(more)
    unit = (lambda c: F.col(c) / 2) if how.metric == "cosine" else F.sqrt
    return Tree(members, points, stored(edges.select("a", "b", unit("v2").alias("weight")), "tree"), stored(cores.select("id", unit("core2").alias("core")), "cores"))


def _towards_less(best: DataFrame, labels: DataFrame) -> DataFrame:
    """(comp, target, v2, a, b): edges to a component of lesser label. These close no circle; of each circle of picks at least one is among them."""
    targets = labels.select(F.col("id").alias("b"), F.col("comp").alias("target"))
    return best.join(targets, "b").filter("target < comp").select("comp", "target", "v2", "a", "b")


def _intervals(tree: Tree, batch: int) -> list[tuple[str, bool]]:
    """Conditions that part the edges by weight, in order, at most some `batch` edges each; True for one weight that has more."""
    n = tree.edges.count()
    parts = -(-n // batch)
    if parts <= 1:
        return [("true", False)]
    cuts = tree.edges.agg(F.percentile_approx("weight", [k / parts for k in range(1, parts)], 100_000)).head()[0]
    out, low = [], None
    for t in sorted(set(cuts)):
        above = "true" if low is None else f"weight > double('{low!r}')"
        if cuts.count(t) > 1:
            out += [(f"{above} and weight < double('{t!r}')", False), (f"weight = double('{t!r}')", True)]
        else:
            out.append((f"{above} and weight <= double('{t!r}')", False))
        low = t
    return [*out, (f"weight > double('{low!r}')", False)]


def _merged(least: int):
    """Joins components by edges in order of weight, those of one weight at once; rows of what becomes of each component."""

    def run(edges: pd.DataFrame, comps: pd.DataFrame) -> pd.DataFrame:
        names = comps["comp"].to_numpy(dtype=np.int64)
        place = {int(c): k for k, c in enumerate(names)}
        parent, size = list(range(len(names))), comps["size"].tolist()
        cluster = [None if pd.isna(c) else int(c) for c in comps["cluster"]]
        small = {k: [k] for k in range(len(names)) if cluster[k] is None}  # components without a cluster, by the root that holds them
        given: list = [(None, None)] * len(names)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        edges = edges.sort_values("weight")
        a, b, w = ([place[int(c)] for c in edges["a"]], [place[int(c)] for c in edges["b"]], edges["weight"].tolist())
        lo = 0
        while lo < len(w):
            hi = lo
            touched: dict[int, set] = {}
            while hi < len(w) and w[hi] == w[lo]:
                x, y = root(a[hi]), root(b[hi])
                held = touched.pop(x, {x}) | touched.pop(y, {y})
                parent[y] = x
                touched[x] = held
                hi += 1
            for top, held in touched.items():
                total = sum(size[k] for k in held)
                old = [cluster[k] for k in held if cluster[k] is not None]
                free = [c for k in held for c in small.pop(k, ())]
                size[top] = total
                if total >= least:
                    cluster[top] = min(int(names[c]) for c in free) if not old else old[0] if len(old) == 1 else NOISE
                    for c in free:
                        given[c] = (cluster[top], w[lo])
                else:
                    cluster[top], small[top] = None, free
            lo = hi
        tops = [root(k) for k in range(len(names))]
        nullable = lambda values, kind: pd.array(values, dtype=kind)
        return pd.DataFrame({"comp": names, "into": names[tops], "size": [size[k] for k in tops], "cluster": nullable([cluster[k] for k in tops], "Int64"), "given": nullable([g for g, _ in given], "Int64"), "weight": nullable([w for _, w in given], "Float64")})

    return run


def point_labels(tree: Tree, how: Hierarchy = Hierarchy()) -> DataFrame:
    """(id, cluster_id, prob) for the points of a tree; -1 and 0 for noise. Clusters are numbered by falling rows, then least id.

    Where all points form one cluster that no two denser ones part, only its densest points are labelled.
    """
    least = how.min_cluster_size
    points = tree.points.withColumn("comp", F.col("id")).join(tree.cores, "id", "left")
    # Enough copies of one point are a cluster from the weight on at which they meet.
    own = points.filter(F.col("size") >= least).select(F.col("id").alias("a"), F.col("id").alias("b"), F.coalesce("core", F.lit(0.0)).alias("weight"))
    tree = Tree(tree.members, tree.points, tree.edges.unionByName(own), tree.cores)
    nothing = F.lit(None).cast("long")
    comps = tree.points.select(F.col("id").alias("comp"), "size", nothing.alias("cluster"))
    labels = points.select("id", "comp", nothing.alias("given"), F.lit(None).cast("double").alias("weight"))
    intervals = _intervals(tree, how.batch)
    for condition, equal in intervals:
        edges = tree.edges.filter(condition)
        for end in ("a", "b"):
            edges = edges.join(labels.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")), end).drop(end).withColumnRenamed(f"{end}_comp", end)
        edges = stored(edges, "batch")
        if len(intervals) > 1:
            groups = connected_components(edges).withColumnRenamed("id", "comp")
            inside = comps.join(groups, "comp")
        else:  # one batch has the whole tree, which is connected
            inside = comps.withColumn("label", F.lit(0).cast("long"))
        if equal:
            total = inside.groupBy("label").agg(F.sum("size").alias("total"), F.count("cluster").alias("old"), F.min("cluster").alias("one"), F.min(F.when(F.col("cluster").isNull(), F.col("comp"))).alias("free"), F.first("label").cast("long").alias("into"))
            made = F.when(F.col("total") >= least, F.when(F.col("old") == 0, F.col("free")).when(F.col("old") == 1, F.col("one")).otherwise(F.lit(NOISE)))
            met = inside.select("label", "comp", F.col("cluster").alias("was")).join(total.withColumn("cluster", made), "label").crossJoin(F.broadcast(edges.agg(F.max("weight").alias("w"))))
            free = F.col("was").isNull() & F.col("cluster").isNotNull()
            became = met.select("comp", "into", F.col("total").alias("size"), "cluster", F.when(free, F.col("cluster")).alias("given"), F.when(free, F.col("w")).alias("weight"))
        else:
            if len(intervals) > 1:
                edges = edges.join(groups.select(F.col("comp").alias("a"), F.col("label").alias("home")), "a")
            else:
                edges = edges.withColumn("home", F.lit(0).cast("long"))
            own = inside.select("comp", "size", "cluster", F.col("label").alias("within"))
            merged = edges.groupBy("home").cogroup(own.groupBy("within"))
            became = merged.applyInPandas(_merged(least), "comp long, into long, size long, cluster long, given long, weight double")
        became = stored(became, "became")
        now = became.select("comp", "into", F.col("given").alias("new"), F.col("weight").alias("at"))
        labels = stored(labels.join(now, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp"), F.coalesce("given", "new").alias("given"), F.coalesce("weight", "at").alias("weight")), "labels")
        rest = comps.join(became.select("comp"), "comp", "left_anti")
        comps = stored(rest.unionByName(became.groupBy(F.col("into").alias("comp")).agg(F.first("size").alias("size"), F.first("cluster").alias("cluster"))), "comps")
    rows = stored(labels.join(tree.points, "id").select("id", "size", F.coalesce("given", F.lit(NOISE)).cast("long").alias("given"), "weight"), "given")
    named = rows.filter(F.col("given") != NOISE).groupBy("given").agg(F.sum("size").alias("rows"), F.min("weight").alias("dense"), F.min("id").alias("least"))
    # Clusters that hold no other are far fewer than points: one row each, of at least `min_cluster_size` rows.
    number = F.row_number().over(Window.orderBy(F.desc("rows"), "least")) - 1
    named = named.select("given", "dense", number.alias("cluster_id"), F.count(F.lit(1)).over(Window.partitionBy()).alias("clusters"))
    whole = (F.col("clusters") == 1) & (F.col("weight") > F.col("dense"))
    met = rows.join(if_small(stored(named, "clusters")), "given", "left").withColumn("in", F.col("cluster_id").isNotNull() & ~whole)
    prob = F.when(F.col("weight") > 0, F.col("dense") / F.col("weight")).otherwise(F.lit(1.0))
    return met.select("id", F.when(F.col("in"), F.col("cluster_id")).otherwise(F.lit(NOISE)).cast("int").alias("cluster_id"), F.when(F.col("in"), prob).otherwise(F.lit(0.0)).alias("prob"))


def row_labels(rows: DataFrame, tree: Tree, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, prob) for all rows, those that are not in the tree as noise."""
    found = tree.members.join(labels, "id").select(F.col("key").alias(key), "cluster_id", "prob")
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"), F.coalesce("prob", F.lit(0.0)).alias("prob"))


def hierarchical_clusters(rows: DataFrame, key: str = "doc_id", how: Hierarchy = Hierarchy()) -> DataFrame:
    """(key, cluster_id, prob) of rows (key, p array)."""
    tree = spanning_tree(rows, key, how)
    return row_labels(rows, tree, point_labels(tree, how), key)


def validity(tree: Tree, labels: DataFrame) -> float:
    """Density-based validity of the labels (id, cluster_id) of a tree's points, between -1 and 1; 0 without clusters.

    A cluster's sparseness is its heaviest inner edge, its separation the lightest edge to another
    cluster; (separation - sparseness) over the greater of both counts by the cluster's share of all
    rows, noise among them. A cluster without an edge to another counts as apart by twice the heaviest
    edge; if it is the only one, by twice its lightest edge to noise, where it has one.
    """
    rows = stored(labels.join(tree.points, "id").select("id", "cluster_id", "size"), "labelled")
    copies = tree.points.filter("size > 1").join(tree.cores, "id").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("weight"))
    edges = tree.edges.unionByName(copies)
    for end in ("a", "b"):
        edges = edges.join(rows.select(F.col("id").alias(end), F.col("cluster_id").alias(f"{end}_in")), end)
    edges = stored(edges.select("a_in", "b_in", "weight"), "edges")
    inner = F.col("a_in") == F.col("b_in")
    noise = (F.col("a_in") == NOISE) != (F.col("b_in") == NOISE)
    top = edges.agg(F.max("weight").alias("heaviest"), F.min(F.when(noise, F.col("weight"))).alias("to_noise"))
    sides = edges.filter(f"a_in != {NOISE} and b_in != {NOISE}").withColumn("cluster_id", F.explode(F.array_distinct(F.array("a_in", "b_in"))))
    own = sides.groupBy("cluster_id").agg(F.max(F.when(inner, F.col("weight"))).alias("sparse"), F.min(F.when(~inner, F.col("weight"))).alias("apart"))
    sizes = rows.filter(f"cluster_id != {NOISE}").groupBy("cluster_id").agg(F.sum("size").alias("rows"))
    total = rows.agg(F.sum("size").alias("total"), F.count_distinct(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))).alias("clusters"))
    met = sizes.join(own, "cluster_id", "left").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(total))  # two tables of one row
    far = 2 * F.when(F.col("clusters") > 1, F.col("heaviest")).otherwise(F.coalesce("to_noise", "heaviest"))
    apart, sparse = F.coalesce("apart", far, F.lit(0.0)), F.coalesce("sparse", F.lit(0.0))
    each = F.when(F.greatest(apart, sparse) > 0, (apart - sparse) / F.greatest(apart, sparse)).otherwise(F.lit(0.0))
    return met.agg(F.sum(each * F.col("rows") / F.col("total"))).head()[0] or 0.0
