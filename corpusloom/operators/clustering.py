"""Clusters and maps of weighted documents.

Documents are laid out in few dimensions by their angular neighbours and clustered there by hierarchical
density; a study searches the parameters of both for the best density-based validity. Clusters by dense
cells of a grid, and Spark's k-means, are there as cheaper ways.

Labels are numbers from 0, -1 is noise, probabilities lie between 0 and 1. Vectors come from hashed
terms, so no vocabulary is gathered in one place.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import layout
from corpusloom.operators.graph import connected_components
from corpusloom.operators.hierarchy import Hierarchy, point_labels, row_labels, spanning_tree, validity
from corpusloom.operators.sampler import Range, Sampler
from corpusloom.operators.stats import NOISE
from corpusloom.sources.staging import stored

LEAST_DOCUMENTS = 20
#: Fixed value: the colour of the noise topic.
NOISE_COLOUR = "#9494b8"


@dataclass(frozen=True)
class Trial:
    k: int
    dimensions: int
    seed: int = 5


def document_vectors(weights: DataFrame, dimensions: int = 256, key: str = "doc_id") -> DataFrame:
    """(key, features): signed hashed terms of (key, term, tfidf), of length 1."""
    h = F.xxhash64("term")
    cells = weights.groupBy(key, F.pmod(h, F.lit(dimensions)).cast("int").alias("cell")).agg(F.sum(F.when(F.shiftrightunsigned(h, 63) == 1, F.col("tfidf")).otherwise(-F.col("tfidf"))).alias("v"))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    values = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("n", F.lit(1e-12)))
    return maps.select(key, array_to_vector(values).alias("features"))


def kmeans(vectors: DataFrame, trial: Trial, noise_below: float = 0.0, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, prob): prob falls with the cosine distance from the cluster's centre."""
    model = KMeans(k=trial.k, seed=trial.seed, distanceMeasure="cosine", predictionCol="cluster_id").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    own = F.get(centres, F.col("cluster_id"))
    v = vector_to_array("features")
    near = F.aggregate(F.zip_with(v, own, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), near))
    rows = model.transform(vectors).select(key, "cluster_id", prob.alias("prob"))
    return rows.withColumn("cluster_id", F.when(F.col("prob") < noise_below, -1).otherwise(F.col("cluster_id")))


Clusterer = Callable[..., DataFrame]


def silhouette(vectors: DataFrame, labels: DataFrame, key: str = "doc_id") -> float:
    """Mean cosine silhouette of rows that are no noise; -1 where there are not two clusters."""
    rows = stored(vectors.join(labels.filter("cluster_id >= 0").select(key, "cluster_id"), key), "silhouette")
    if rows.select("cluster_id").distinct().limit(2).count() < 2:
        return -1.0
    return ClusteringEvaluator(predictionCol="cluster_id", distanceMeasure="cosine").evaluate(rows)


@dataclass(frozen=True)
class Density:
    """dimensions that vectors are projected to; width of a cell in units of the projection's spread; documents that make a cell dense."""

    dimensions: int
    width: float
    least: int


def projected(vectors: DataFrame, dimensions: int, key: str = "doc_id") -> DataFrame:
    """(key, p): the first principal components, an array."""
    rows = PCA(k=dimensions, inputCol="features", outputCol="_p").fit(vectors).transform(vectors)
    return rows.select(key, vector_to_array("_p").alias("p"))


def density(vectors: DataFrame, trial: Density, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, prob) by density in a projection of vectors."""
    points = stored(projected(vectors, trial.dimensions, key), "projected")
    spread = points.agg(*[F.var_pop(F.get("p", F.lit(i))).alias(f"v{i}") for i in range(trial.dimensions)]).first()
    size = (sum(v or 0.0 for v in spread) / trial.dimensions) ** 0.5 or 1.0
    return density_clusters(points, trial.width * size, trial.least, trial.dimensions, key)


def density_clusters(points: DataFrame, width: float, least: int, dimensions: int, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, prob) of points (key, p) by the density of the cells of a grid.

    A cell of at least `least` points is dense. Dense cells that touch, by a corner at least, form a
    cluster; numbers rise as sizes fall, from 0. A point of another cell that touches dense ones goes to
    the densest of these (the first in order among equals); the rest is noise, -1. prob: how dense
    its cell is by the cluster's densest, per dimension; 0 for noise. What is compared is cells, each
    with its 3 ** dimensions neighbours, never points with points.
    """
    cell = F.transform("p", lambda x: F.floor(x / F.lit(width)).cast("int"))
    placed = stored(points.select(key, cell.alias("cell")), "placed")
    cells = stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")), "cells")
    steps = F.array(*[F.array(*[F.lit(d) for d in step]) for step in itertools.product((-1, 0, 1), repeat=dimensions)])
    beside = cells.select("cell", "c", F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda a, b: a + b))).alias("near"))
    dense = cells.filter(F.col("c") >= least).select(F.col("cell").alias("near"), F.col("c").alias("near_c"))
    touching = stored(beside.join(dense, "near"), "touching")
    joined = connected_components(touching.filter(F.col("c") >= least).select(F.col("cell").alias("a"), F.col("near").alias("b")))
    best = touching.filter(F.col("c") < least).groupBy("cell", "c").agg(F.min(F.struct((-F.col("near_c")).alias("n"), "near")).alias("b"))
    homes = touching.filter((F.col("c") >= least) & (F.col("cell") == F.col("near"))).select("cell", "c", F.col("cell").alias("home"))
    homes = homes.unionByName(best.select("cell", "c", F.col("b.near").alias("home"))).join(joined.select(F.col("id").alias("home"), "label"), "home")
    homes = stored(homes, "homes")
    sizes = homes.groupBy("label").agg(F.sum("c").alias("size"), F.max("c").alias("top"))
    # One row for each cluster, of which each has `least` documents.
    ranks = sizes.withColumn("cluster_id", (F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1).cast("int"))
    named = homes.join(ranks, "label").select("cell", "cluster_id", F.pow(F.col("c") / F.col("top"), F.lit(1.0 / dimensions)).alias("prob"))
    return placed.join(named, "cell", "left").select(key, F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"), F.coalesce("prob", F.lit(0.0)).alias("prob"))


@dataclass(frozen=True)
class Hierarchical:
    """A projection by layout to so many dimensions, and clusters by hierarchical density there."""

    dimensions: int
    further: float
    min_cluster_size: int
    min_samples: int


#: Dimensions that are tried, at most.
MOST_DIMENSIONS = 400


def search_ranges(documents: int, terms: int) -> tuple[Range, ...]:
    """Ranges of the parameters of Hierarchical for a collection of so many documents and terms (or cells of terms)."""
    half = max(2, round(documents / 2) - 1)
    return (
        Range("dimensions", 2, max(2, min(documents, terms, MOST_DIMENSIONS)), True),
        Range("further", 2.0, max(3.0, min(20.0, round(documents / 20)))),
        Range("min_cluster_size", 2, half, True),
        Range("min_samples", 2, half, True),
    )


def projected_by_layout(vectors: DataFrame, trial: Hierarchical, key: str = "doc_id") -> DataFrame:
    """(key, p): places of a layout of the vectors, which are ml vectors or arrays."""
    how = layout.Layout(dimensions=trial.dimensions, further=trial.further)
    return layout.laid_out(_arrays(vectors), key, "features", how).select(key, F.col("y").alias("p"))


def _arrays(vectors: DataFrame) -> DataFrame:
    return vectors if vectors.schema["features"].dataType.typeName() == "array" else vectors.withColumn("features", vector_to_array("features"))


def hierarchical(vectors: DataFrame, trial: Hierarchical, key: str = "doc_id") -> tuple[DataFrame, float]:
    """((key, cluster_id, prob), density-based validity) of a trial."""
    places = stored(projected_by_layout(vectors, trial, key), "projected")
    how = Hierarchy(trial.min_cluster_size, trial.min_samples, "cosine")
    tree = spanning_tree(places, key, how)
    labels = stored(point_labels(tree, how), "labels")
    return row_labels(vectors, tree, labels, key), validity(tree, labels)


TRIALS = "number int, params string, state string, score double"


def scored_density(vectors: DataFrame, trial: Density) -> tuple[DataFrame, float]:
    """Clusters by dense cells, scored by silhouette and the share that is no noise."""
    labels = stored(density(vectors, trial), "trial")
    noise = labels.agg(F.avg((F.col("cluster_id") < 0).cast("double"))).first()[0] or 0.0
    return labels, silhouette(vectors, labels) * (1 - noise)


def study(vectors: DataFrame, wanted: int, done: DataFrame | None = None, jobs: int = 1, run: Callable = hierarchical, kind: type = Hierarchical, ranges: tuple[Range, ...] | None = None, seed: int = 5) -> DataFrame:
    """The trials table (TRIALS) with `wanted` trials: those of `done` that are complete, and new ones for the numbers that lack.

    `run(vectors, kind(**parameters))` gives labels and a score. Parameters are asked of a sampler
    that knows all trials so far; `jobs` trials are asked for, and run, at a time, as Spark jobs side by
    side. A trial that fails is recorded as such and tried again when the study is resumed. Write the
    table to resume later.
    """
    spark = vectors.sparkSession
    names = [c.split()[0] for c in TRIALS.split(", ")]
    # One row a trial, of which there are as many as were wanted.
    kept = [] if done is None else [tuple(r) for r in done.filter((F.col("state") == "COMPLETE") & (F.col("number") < wanted)).select(*names).collect()]
    if ranges is None:
        first = _arrays(vectors.limit(1)).select(F.size("features").alias("terms")).head()
        ranges = search_ranges(vectors.count(), first["terms"] if first else 2)
    sampler = Sampler(ranges, seed)
    left = sorted(set(range(wanted)) - {r[0] for r in kept})

    def tried(number: int, params: dict) -> tuple:
        told = json.dumps(params)
        try:
            return number, told, "COMPLETE", float(run(vectors, kind(**params))[1])
        except PySparkException:
            return number, told, "FAIL", None

    failed = []
    with ThreadPoolExecutor(max(1, jobs)) as pool:
        for start in range(0, len(left), max(1, jobs)):
            asked: list[tuple[int, dict]] = []
            known = [(json.loads(r[1]), r[3]) for r in sorted(kept)]
            for number in left[start : start + max(1, jobs)]:
                asked.append((number, sampler.ask(number, known, [p for _, p in asked])))
            for row in pool.map(lambda x: tried(*x), asked):
                (kept if row[2] == "COMPLETE" else failed).append(row)
    return spark.createDataFrame(sorted(kept + failed), TRIALS)


def count_trials(trials: DataFrame) -> int:
    return trials.filter(F.col("state") == "COMPLETE").count()


def best_params(trials: DataFrame) -> dict | None:
    """Parameters of the complete trial of greatest score, the first among equals; None without any."""
    rows = trials.filter(F.col("state") == "COMPLETE").agg(F.max_by("params", F.struct("score", -F.col("number"))).alias("p"))
    found = rows.first()["p"]
    return json.loads(found) if found else None


def clustered(vectors: DataFrame, wanted: int = 10, done: DataFrame | None = None, jobs: int = 1) -> tuple[DataFrame | None, DataFrame | None]:
    """(labels, trials): a study and the clusters of its best trial; (None, done) below LEAST_DOCUMENTS."""
    if vectors.limit(LEAST_DOCUMENTS).count() < LEAST_DOCUMENTS:
        return None, done
    trials = study(vectors, wanted, done, jobs)
    best = best_params(trials)
    return (hierarchical(vectors, Hierarchical(**best))[0] if best else None), trials


#: Topic and number of the one cluster that an early map has until clusters are found.
PROVISIONAL = ("provisional", -2)


def early_map(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, pos_x, pos_y): the map with all documents in one provisional cluster."""
    return mapped(vectors, key).select(key, F.lit(PROVISIONAL[1]).alias("cluster_id"), "pos_x", "pos_y")


def without_provisional(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("cluster_id") != PROVISIONAL[1])


def best_trial(vectors: DataFrame, trials: Sequence[Trial], clusterer: Clusterer = kmeans) -> tuple[Trial, float]:
    """The trial of greatest silhouette, the first among equals."""
    found = [(silhouette(vectors, clusterer(vectors, t)), -i, t) for i, t in enumerate(trials)]
    score, _, trial = max(found, key=lambda x: x[:2])
    return trial, score


def trials_left(done: int, wanted: int, jobs: int, legacy: bool = False) -> list[int]:
    """How many trials each job runs; `legacy` drops what does not divide evenly."""
    left = max(0, wanted - done)
    return [left // jobs + (0 if legacy else int(i < left % jobs)) for i in range(jobs)]


def mapped(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos_x, pos_y): the map of the vectors that have a direction, by the layout's defaults."""
    places = layout.laid_out(_arrays(vectors), key, "features")
    return places.select(key, F.get("y", F.lit(0)).alias("pos_x"), F.get("y", F.lit(1)).alias("pos_y"))


def palette(topics: Sequence[str], noise: str = "unclassified papers") -> dict[str, str]:
    """A colour for each topic, evenly around the wheel; the noise topic is grey."""
    import colorsys

    named = [t for t in topics if t != noise]
    out = {t: "#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hls_to_rgb(k / max(1, len(named)), 0.5, 0.65)) for k, t in enumerate(named)}
    return out | ({noise: NOISE_COLOUR} if noise in topics else {})
