"""Neighbour graphs, maps and guided search."""

import math
import random

import numpy as np

from corpusloom.operators import layout
from corpusloom.operators.sampler import Range, Sampler


def crowds(n=300, dim=24, seed=1):
    """Points near many curves in many dimensions: two principal components hold few of their neighbours."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 2
    along = rng.standard_normal((12, dim))
    which = rng.integers(0, 12, n)
    return centres[which] + rng.uniform(-1, 1, n)[:, None] * along[which] + 0.1 * rng.standard_normal((n, dim))


def angular(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u @ u.T
    np.fill_diagonal(c, -np.inf)
    return c


def kept(x, y, k=10):
    """Share of each point's k angular neighbours that are among its k neighbours on the map."""
    near = np.argsort(-angular(x), axis=1)[:, :k]
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    there = np.argsort(d, axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near, there, strict=True)])


def test_neighbour_graph(spark):
    x = crowds(1500)
    points = layout.unit_rows(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>"), "id", "v")
    got = {}
    for r in layout.angular_neighbours(points, 10, layout.Forest(leaf=64)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    near = np.argsort(-angular(x), axis=1)[:, :10]
    assert np.mean([len(got[k] & set(near[k].tolist())) / 10 for k in range(len(x))]) >= 0.9


def test_map_keeps_neighbours(spark):
    x = crowds()
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24)]
    frame = spark.createDataFrame(rows, "doc_id int, features array<double>")
    whole = {r["doc_id"]: r["y"] for r in layout.laid_out(frame).collect()}
    assert sorted(whole) == list(range(300))
    again = {r["doc_id"]: r["y"] for r in layout.laid_out(frame.repartition(5)).collect()}
    assert np.allclose([whole[k] for k in whole], [again[k] for k in whole])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    u = u - u.mean(axis=0)
    flat = u @ np.linalg.svd(u, full_matrices=False)[2][:2].T
    mine = kept(x, np.array([whole[k] for k in range(300)]))
    assert mine > kept(x, flat) + 0.1 and mine > 0.4
    # Blocks that exchange places keep neighbours too.
    parts = layout.Layout(block=120, exchange=45, forest=layout.Forest(leaf=64))
    dealt = {r["doc_id"]: r["y"] for r in layout.laid_out(frame, how=parts).collect()}
    assert kept(x, np.array([dealt[k] for k in range(300)])) > kept(x, flat)


def test_maps_of_little(spark):
    for rows in ([], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])]):
        got = layout.laid_out(spark.createDataFrame(rows, "doc_id int, features array<double>"), how=layout.Layout(steps=(5, 5, 5))).collect()
        assert sorted(r["doc_id"] for r in got) == [k for k, _ in rows] and all(len(r["y"]) == 2 and all(map(math.isfinite, r["y"])) for r in got)
    assert layout.neighbour_count(10_000) == 10 and layout.neighbour_count(10**6) == 40


RANGES = (Range("x", -10.0, 10.0), Range("n", 2, 400, True), Range("idle", 0.0, 1.0))


def score(p):
    return -((p["x"] - 3.3) ** 2) - ((p["n"] - 120) / 20) ** 2


def trials_to(goal, sampler, most=300):
    done = []
    for number in range(most):
        p = sampler.ask(number, done)
        assert -10 <= p["x"] <= 10 and isinstance(p["n"], int) and 2 <= p["n"] <= 400
        done.append((p, score(p)))
        if done[-1][1] >= goal:
            return number + 1
    return most


def test_guided_search_needs_fewer_trials():
    guided = [trials_to(-0.1, Sampler(RANGES, seed)) for seed in range(15)]
    blind = [trials_to(-0.1, Sampler(RANGES, seed, blind=10**9)) for seed in range(15)]
    assert np.median(guided) < 0.5 * np.median(blind)


def test_batches_spread_and_resume():
    sampler = Sampler(RANGES, 2)
    rng = random.Random(0)
    done = [({"x": rng.uniform(-10, 10), "n": rng.randint(2, 400), "idle": 0.5}, 0.0) for _ in range(20)]
    done = [(p, score(p)) for p, _ in done]
    asked = []
    for number in range(20, 25):
        asked.append(sampler.ask(number, done, asked))
    assert len({round(p["x"], 6) for p in asked}) == 5
    assert sampler.ask(20, done) == Sampler(RANGES, 2).ask(20, list(done))
