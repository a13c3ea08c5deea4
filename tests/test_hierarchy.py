"""Neighbours, spanning trees, clusters and their validity against brute force."""

import random

import numpy as np
import pytest

from corpusloom.operators import hierarchy, neighbours
from corpusloom.operators.hierarchy import Hierarchy


def blobs(rng, n=150):
    """Three crowds of unlike density, chains between them, copies and a far point."""
    rows = [[rng.gauss(0, 0.3), rng.gauss(0, 0.3)] for _ in range(n // 3)] + [[rng.gauss(5, 1), rng.gauss(1, 1)] for _ in range(n // 3)]
    rows += [[rng.gauss(2, 0.05), rng.gauss(6, 0.05)] for _ in range(n // 6)] + [[k / 3, 3.0] for k in range(n // 10)]
    rows += [[5.5, 1.5]] * 9 + [[9.0, 9.0]] * 4 + [[1e3, -1e3]]
    return rows


def mutual(points, how):
    p = np.array(points, dtype=float)
    if how.metric == "cosine":
        p = p / np.linalg.norm(p, axis=1)[:, None]
    d2 = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    d = d2 / 2 if how.metric == "cosine" else np.sqrt(d2)
    core = np.sort(d, axis=1)[:, min(how.samples, len(p) - 1)]
    m = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    np.fill_diagonal(m, 0)
    return m, core


def by_force(points, how):
    """Weights of a least spanning tree, labels, probabilities and validity."""
    m, core = mutual(points, how)
    n, least = len(points), how.min_cluster_size
    inside, best, via, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    inside[0] = True
    for _ in range(n - 1):  # Prim
        closer = m[at] < best
        best[closer], via[closer] = m[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((int(via[at]), at, best[at]))
        inside[at] = True
    u = m.copy()
    for k in range(n):  # least heaviest edge of a way
        u = np.minimum(u, np.maximum(u[:, k, None], u[None, k, :]))
    near = lambda x, y: x <= y + 1e-12
    joins = np.sort(u, axis=1)[:, least - 1] if n >= least else np.full(n, np.inf)  # the weight at which a point's component is large enough
    at_join = [np.flatnonzero(near(u[p], joins[p])) if np.isfinite(joins[p]) else np.zeros(0, int) for p in range(n)]
    born = {p: int(x.min()) for p, x in enumerate(at_join) if len(x) and not (joins[x] < joins[p] - 1e-12).any()}
    leaf = np.full(n, -1)
    for p, x in enumerate(at_join):
        homes = {born[y] for y in x.tolist() if y in born}
        if len(homes) == 1:
            leaf[p] = homes.pop()
    names = [c for c in np.unique(leaf) if c >= 0]
    dense = {c: joins[leaf == c].min() for c in names}
    if len(names) == 1:
        leaf = np.where(near(joins, dense[names[0]]), leaf, -1)
    order = sorted(names, key=lambda c: (-int((leaf == c).sum()) if len(names) > 1 else 0, int(np.flatnonzero(leaf == c)[0])))
    labels = np.array([order.index(c) if c >= 0 else -1 for c in leaf])
    prob = np.array([0.0 if c < 0 else 1.0 if joins[p] <= 0 else dense[c] / joins[p] for p, c in enumerate(leaf)])
    return edges, labels, prob, m, core


def dbcv(edges, labels):
    heaviest = max(w for *_, w in edges)
    names = sorted(set(labels[labels >= 0]))
    sparse, apart, noise = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf), np.inf
    for a, b, w in edges:
        x, y = labels[a], labels[b]
        if x < 0 and y < 0:
            continue
        if x < 0 or y < 0:
            noise = min(noise, w)
        elif x == y:
            sparse[x] = max(sparse[x], w)
        else:
            apart[x], apart[y] = min(apart[x], w), min(apart[y], w)
    noise = heaviest if np.isinf(noise) else noise
    total = 0.0
    for c in names:
        far = apart[c] if np.isfinite(apart[c]) else 2 * (heaviest if len(names) > 1 else noise)
        total += (labels == c).sum() / len(labels) * (far - sparse[c]) / max(far, sparse[c])
    return total


CASES = [
    Hierarchy(5, 5, "euclidean"),
    Hierarchy(8, 3, "euclidean", per_block=10, batch=25),
    Hierarchy(6, None, "cosine", per_block=16),
    Hierarchy(120, 40, "euclidean", per_block=40),
]


@pytest.mark.parametrize("how", CASES)
def test_clusters(spark, how):
    points = blobs(random.Random(3))
    frame = spark.createDataFrame([(k, p, "x") for k, p in enumerate(points)], "doc_id int, p array<double>, id string").repartition(3)
    edges, labels, prob, m, core = by_force(points, how)
    tree = hierarchy.spanning_tree(frame, "doc_id", how)
    stands = {r["key"]: r["id"] for r in tree.members.collect()}
    assert len(stands) == len(points)
    mine = [(r["a"], r["b"], r["weight"]) for r in tree.edges.collect()]
    assert len(mine) == len(set(stands.values())) - 1
    copies = [core[k] for k in stands if stands[k] != k]
    assert np.allclose(sorted([w for *_, w in mine] + copies), sorted(w for *_, w in edges), atol=1e-9)
    assert all(abs(m[a, b] - w) < 1e-9 for a, b, w in mine)
    found = hierarchy.point_labels(tree, how)
    got = {r["doc_id"]: (r["cluster_id"], r["prob"]) for r in hierarchy.row_labels(frame, tree, found).collect()}
    # Sizes may tie: compare as partitions.
    pairs = {(got[k][0], int(labels[k])) for k in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all((a < 0) == (b < 0) for a, b in pairs)
    assert np.allclose([got[k][1] for k in range(len(points))], prob, atol=1e-6)
    assert abs(hierarchy.validity(tree, found) - dbcv(edges, labels)) < 1e-6


def test_numbers_follow_sizes(spark):
    points = blobs(random.Random(3))
    got = hierarchy.hierarchical_clusters(spark.createDataFrame(list(enumerate(points)), "doc_id int, p array<double>"), how=CASES[0]).collect()
    sizes = [sum(r["cluster_id"] == c for r in got) for c in range(1 + max(r["cluster_id"] for r in got))]
    assert len(sizes) >= 3 and sizes == sorted(sizes, reverse=True)


def test_odd_rows(spark):
    schema = "doc_id int, p array<double>"
    how = Hierarchy(3, 2, "cosine")
    for rows in ([], [(1, None), (2, [0.0, 0.0]), (3, [])], [(1, [1.0, 0.0]), (2, [1.0, 1.0])]):
        got = hierarchy.hierarchical_clusters(spark.createDataFrame(rows, schema), how=how).collect()
        assert sorted(tuple(r) for r in got) == [(k, -1, 0.0) for k, _ in rows]
    same = [(k, [2.0, 2.0]) for k in range(30)] + [(40, [float("nan"), 1.0]), (41, [None, 1.0])]
    got = sorted(tuple(r) for r in hierarchy.hierarchical_clusters(spark.createDataFrame(same, schema), how=how).collect())
    assert got == [(k, 0, 1.0) for k in range(30)] + [(40, -1, 0.0), (41, -1, 0.0)]
    tree = hierarchy.spanning_tree(spark.createDataFrame(same, schema), how=how)
    assert hierarchy.validity(tree, hierarchy.point_labels(tree, how)) == 0.0


@pytest.mark.parametrize("name", ["even", "outlier", "spot", "line"])
def test_neighbours(spark, name):
    """The same as force with a far point, with most points in one spot and on a line; the spot visits few blocks."""
    rng = random.Random(5)
    points = {
        "even": [(rng.random(), rng.random()) for _ in range(700)],
        "outlier": [(rng.random(), rng.random()) for _ in range(600)] + [(1e6, 1e6)],
        "spot": [(0.5, 0.5)] * 600 + [(rng.random(), rng.random()) for _ in range(100)],
        "line": [(float(rng.randint(0, 30)), 0.0) for _ in range(700)],
    }[name]
    order = list(range(len(points)))
    rng.shuffle(order)
    rows = [(3 * k - 50, list(points[j])) for k, j in enumerate(order)]
    space = neighbours.space_of(spark.createDataFrame(rows, "id long, p array<double>"), 2, per_block=32)
    assert space.blocks.count() >= 10
    chosen = spark.createDataFrame([(r[0],) for r in rows[::7]] + [(10**9,)], "id long")
    got = {}
    for r in neighbours.nearest(space, 6, chosen).collect():
        got.setdefault(r["id"], {})[r["place"]] = (r["d2"], r["neighbour"])
    assert len(got) == len(rows[::7])
    for k, (x, y) in rows[::7]:
        near = sorted(((a - x) * (a - x) + (b - y) * (b - y), j) for j, (a, b) in rows if j != k)[:6]
        assert [got[k][i + 1] for i in range(6)] == near
    all_ = neighbours.nearest(space, 3)
    assert all_.count() == 3 * len(rows)
