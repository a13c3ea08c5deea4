"""Languages of texts by character n-grams, learned as counts and scored by joins.

A text's words are read with a blank at either end, as all their grams of one to `orders`
characters. A language's log-likelihood of a gram is that of its smoothed share among the grams of
its length; a text's score is the sum over its grams. Each distinct word is scored once, however
often it occurs. A text is of no known language if it has no letters, or if too small a share of its
three-character grams occurs in the best language's texts at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.staging import if_small, stored

#: Length of the grams by which texts are refused.
TELLING = 3


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: gram, gains: how much more likely than an unseen gram it is, by language; 0 where unseen. A stored table.
    grams: DataFrame
    #: floors[k - 1][j]: log-likelihood of an unseen gram of k characters in language j.
    floors: tuple[tuple[float, ...], ...]


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def word_grams(word: Column, orders: int) -> Column:
    """All grams of a word, repeats too; a blank by itself is none."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)

    def of(k: int) -> Column:
        starts = F.when(size >= k, F.sequence(F.lit(1), size - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.substring(padded, s, F.lit(k)))

    sets = [of(k) for k in range(1, orders + 1)]
    return F.filter(F.concat(*sets), lambda g: g != " ")


def learn_languages(texts: DataFrame, lang: str = "lang", text: str = "text", orders: int = 5, smoothing: float = 0.5) -> LanguageModel:
    """A model of the rows with a language and text. Counts add up before each shuffle; a row for each gram is kept."""
    words = texts.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word")).groupBy("lang", "word").count()
    counts = words.select("lang", "count", F.explode(word_grams(F.col("word"), orders)).alias("gram")).groupBy("lang", "gram").agg(F.sum("count").alias("n"))
    counts = stored(counts, "gram-counts")
    size = F.length("gram").alias("k")
    kinds = {r["k"]: r["v"] for r in counts.groupBy(size).agg(F.count_distinct("gram").alias("v")).collect()}
    totals = {(r["lang"], r["k"]): r["n"] for r in counts.groupBy("lang", size).agg(F.sum("n").alias("n")).collect()}  # a row for each language and length
    languages = tuple(sorted({lang for lang, _ in totals}))
    from math import log

    floors = tuple(tuple(log(smoothing / (totals.get((lang, k), 0) + smoothing * max(1, kinds.get(k, 1)))) for lang in languages) for k in range(1, orders + 1))
    gains = F.array(*[F.coalesce(F.max(F.when(F.col("lang") == lang, F.log(1 + F.col("n") / F.lit(smoothing)))), F.lit(0.0)) for lang in languages])
    return LanguageModel(languages, stored(counts.groupBy("gram").agg(gains.alias("gains")), "gram-gains"), floors)


def word_scores(words: DataFrame, model: LanguageModel) -> DataFrame:
    """(word, n_telling, scores, telling) of distinct (word): grams of three characters, scores by language, and how many of these grams each has seen."""
    grams = words.select("word", F.explode(word_grams(F.col("word"), len(model.floors))).alias("gram"))
    met = grams.join(if_small(model.grams), "gram", "left").withColumn("k", F.length("gram"))
    telling = F.col("k") == TELLING
    scores, seen = [], []
    for j in range(len(model.languages)):
        gain = F.coalesce(F.get("gains", F.lit(j)), F.lit(0.0))
        floor = F.get(F.array(*[F.lit(f[j]) for f in model.floors]), F.col("k") - 1)
        scores.append(F.sum(gain + floor))
        seen.append(F.count_if(telling & (gain > 0)))
    return met.groupBy("word").agg(F.count_if(telling).alias("n_telling"), F.array(*scores).alias("scores"), F.array(*seen).alias("telling"))


def detect(texts: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", kept: Sequence[str] | None = None, least_known: float = 0.5) -> DataFrame:
    """(key, language, margin) for each row: null where the text is of no known language, or of none of `kept`.

    margin: by how much the best language's log-likelihood of a gram is above the second's, on average.
    """
    number = F.monotonically_increasing_id()
    rows = stored(texts.select(number.alias("_row"), F.col(key), letter_words(F.col(text)).alias("_words")), "worded")
    words = rows.select("_row", F.explode("_words").alias("word")).groupBy("_row", "word").count()
    known = stored(word_scores(words.select("word").distinct(), model), "word-scores")
    met = words.join(known, "word")
    sums = [F.sum(F.col("count") * F.get("scores", F.lit(j))).alias(f"s{j}") for j in range(len(model.languages))]
    seen = [F.sum(F.col("count") * F.get("telling", F.lit(j))).alias(f"t{j}") for j in range(len(model.languages))]
    grams = F.sum(F.col("count") * F.col("n_telling")).alias("n")
    total = met.groupBy("_row").agg(grams, *sums, *seen)
    each = [F.struct(F.col(f"s{j}").alias("s"), F.lit(-j).alias("j"), F.lit(lang).alias("lang"), (F.col(f"t{j}") / F.col("n")).alias("known")) for j, lang in enumerate(model.languages)]
    order = F.sort_array(F.array(*each), asc=False) if each else F.array().cast("array<struct<s:double,j:int,lang:string,known:double>>")
    got = total.select("_row", "n", order.alias("order")).select("_row", F.get("order", F.lit(0)).alias("one"), ((F.get("order", F.lit(0))["s"] - F.get("order", F.lit(1))["s"]) / F.col("n")).alias("margin"))
    good = F.col("one.known") >= least_known
    if kept is not None:
        good = good & F.col("one.lang").isin(*kept)
    return rows.select("_row", F.col(key)).join(got, "_row", "left").select(key, F.when(good, F.col("one.lang")).alias("language"), "margin")
