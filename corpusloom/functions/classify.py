"""Sentence classes by multinomial logistic regression over hashed words and word pairs.

Spark fits the weights; probabilities come in batches from the fitted model, or from any given table of
weights by joins. What they give is the map that `passages.likeliest` and `second_label` read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let
from corpusloom.functions.text import index_tokens
from corpusloom.sources.staging import if_small


@dataclass(frozen=True)
class Fitting:
    cells: int = 1 << 18
    #: Words that make a feature, at most.
    words: int = 2
    penalty: float = 1e-4
    steps: int = 100


@dataclass(frozen=True)
class SentenceClasses:
    labels: tuple[str, ...]
    model: LogisticRegressionModel
    how: Fitting


def word_features(text: Column, most: int = 2) -> Column:
    """Words, and runs of up to `most` words joined by a blank; repeats stay."""

    def runs(tokens: Column) -> Column:
        found = [tokens]
        for k in range(2, most + 1):
            longer = F.zip_with(found[-1], F.slice(tokens, k, F.size(tokens)), lambda run, w: F.concat(run, F.lit(" "), w))
            found.append(F.filter(longer, lambda run: run.isNotNull()))  # the last one has no word behind it
        return F.concat(*found)

    return let(index_tokens(F.coalesce(text, F.lit(""))), runs)


def _vectors(sentences: DataFrame, text: str, how: Fitting) -> DataFrame:
    hashed = HashingTF(inputCol="_features", outputCol="_cells", numFeatures=how.cells, binary=True)
    return hashed.transform(sentences.withColumn("_features", word_features(F.col(text), how.words))).drop("_features")


def fit_classes(sentences: DataFrame, text: str = "sentence", label: str = "label", how: Fitting = Fitting()) -> SentenceClasses:
    """Classes learned from the rows with text and label. Gradients add up over tasks; weights are one vector a label."""
    rows = sentences.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, F.col(label).cast("string").alias("_label"))
    index = StringIndexer(inputCol="_label", outputCol="_class", stringOrderType="alphabetAsc").fit(rows)
    model = LogisticRegression(featuresCol="_cells", labelCol="_class", family="multinomial", regParam=how.penalty, maxIter=how.steps).fit(index.transform(_vectors(rows, text, how)))
    return SentenceClasses(tuple(index.labels), model, how)


def classified(sentences: DataFrame, classes: SentenceClasses, text: str = "sentence") -> DataFrame:
    """`sentences` with `scores`, a map of label probabilities; null where there are no words."""
    model = classes.model.setFeaturesCol("_cells").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    rows = model.transform(_vectors(sentences, text, classes.how))
    labels = F.array(*[F.lit(x) for x in classes.labels])
    said = F.size(index_tokens(F.coalesce(F.col(text), F.lit("")))) > 0
    return rows.withColumn("scores", F.when(said, F.map_from_arrays(labels, vector_to_array("_p")))).select(*sentences.columns, "scores")


def weighed(features: DataFrame, weights: DataFrame, intercepts: DataFrame, key: list[str]) -> DataFrame:
    """(key..., scores): the map of label probabilities by given weights.

    features: (key..., feature, n); weights: (feature, label, weight), where a missing one is 0; intercepts:
    (label, intercept), a row for each label. Rows of `features` without a known feature have the
    intercepts' probabilities.
    """
    own = features.select(*key).distinct().crossJoin(F.broadcast(intercepts))  # a row for each label
    known = if_small(weights)
    parts = features.join(known, "feature").groupBy(*key, "label").agg(F.sum(F.col("n") * F.col("weight")).alias("part"))
    total = own.join(parts, [*key, "label"], "left").select(*key, "label", (F.col("intercept") + F.coalesce("part", F.lit(0.0))).alias("z"))
    lists = total.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("label", "z"))).alias("all"), F.max("z").alias("most"))
    shares = F.transform("all", lambda x: F.exp(x["z"] - F.col("most")))
    whole = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return lists.select(*key, F.map_from_arrays(F.transform("all", lambda x: x["label"]), F.transform(shares, lambda x: x / whole)).alias("scores"))
