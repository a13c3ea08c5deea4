"""Language models, taggers and sentence classes: exact against force, and how often right on rows that were held out."""

import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import classify, languages, tagging

ROOT = os.environ.get("CORPUSLOOM_TABLES", "/root/testdata/sf0.001")


def test_scores_of_words(spark):
    rows = [("aa", "ab aba b"), ("bb", "cd ab"), ("bb", "Cdc!"), (None, "zz")]
    model = languages.learn_languages(spark.createDataFrame(rows, "lang string, text string"), orders=3)
    counts = {lang: {k: {} for k in (1, 2, 3)} for lang in ("aa", "bb")}

    def grams(word):
        padded = f" {word} "
        return [(k, padded[s : s + k]) for k in (1, 2, 3) for s in range(len(padded) - k + 1) if padded[s : s + k] != " "]

    for lang, words in (("aa", ["ab", "aba", "b"]), ("bb", ["cd", "ab", "cdc"])):
        for w in words:
            for k, g in grams(w):
                counts[lang][k][g] = counts[lang][k].get(g, 0) + 1
    kinds = {k: len(set(counts["aa"][k]) | set(counts["bb"][k])) for k in (1, 2, 3)}
    got = {r["word"]: r for r in languages.word_scores(spark.createDataFrame([("abc",), ("cd",), ("é",)], "word string"), model).collect()}
    for word, r in got.items():
        for j, lang in enumerate(("aa", "bb")):
            want = sum(math.log((counts[lang][k].get(g, 0) + 0.5) / (sum(counts[lang][k].values()) + 0.5 * kinds[k])) for k, g in grams(word))
            assert abs(r["scores"][j] - want) < 1e-9 and r["telling"][j] == sum(k == 3 and g in counts[lang][3] for k, g in grams(word))
    texts = spark.createDataFrame([(1, "AB aba"), (2, "cd"), (3, None), (4, "12 ?"), (5, "щщщ ждщ"), (2, "cd")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["language"]) for r in languages.detect(texts, model).collect()) == [(1, "aa"), (2, "bb"), (2, "bb"), (3, None), (4, None), (5, None)]
    assert {r["language"] for r in languages.detect(texts, model, kept=["bb"]).filter("doc_id <= 2").collect()} == {None, "bb"}
    nothing = languages.learn_languages(texts.limit(0).withColumn("lang", F.lit("x")))
    assert languages.detect(texts, nothing).filter("language is not null").count() == 0


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")
def test_held_out_languages(spark):
    """Whole documents, and their first four words only."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").filter("lang is not null and length(text) > 40")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = languages.learn_languages(docs.filter(~held))
    few = docs.filter(held).withColumn("text", F.array_join(F.slice(languages.letter_words(F.col("text")), 1, 4), " "))
    for rows, least in ((docs.filter(held), 0.97), (few, 0.85)):
        got = languages.detect(rows, model).join(docs.select("doc_id", "lang"), "doc_id")
        assert got.filter("lang = language").count() >= least * rows.count() > 20


GRAMMAR = {"DET": ["the", "a"], "NOUN": ["dog", "run", "walk", "ship"], "VERB": ["walks", "run", "walk", "sails"], "ADV": ["slowly", "quickly", "oddly"], "ADJ": ["red", "fast"]}
PATTERNS = [["DET", "NOUN", "VERB", "ADV"], ["DET", "ADJ", "NOUN", "VERB"], ["NOUN", "VERB", "DET", "NOUN"], ["ADV", "DET", "NOUN", "VERB"]]
LEMMAS = {"walks": "walk", "sails": "sail"}


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(1)
    rows = []
    for s in range(200):
        for i, t in enumerate(rng.choice(PATTERNS)):
            w = rng.choice(GRAMMAR[t])
            rows.append((s, i, w.upper() if s % 9 == 0 else w, t, LEMMAS.get(w, w)))
    return tagging.learn_tags(spark.createDataFrame(rows, "doc_id int, i int, word string, tag string, lemma string"), lemma="lemma", rare=60)


def test_tags_follow_their_neighbours(spark, tagger):
    docs = spark.createDataFrame([(1, "the run walks slowly".split()), (2, "the dog run Strangely".split()), (3, "a walk walk oddly".split()), (4, []), (5, None), (6, ["the", "wugs", "sail"])], "doc_id int, tokens array<string>")
    got = {r["doc_id"]: [w["tag"] for w in r["words"]] for r in tagging.tagged_tokens(docs, tagger).collect()}
    assert got[1] == ["DET", "NOUN", "VERB", "ADV"] and got[2] == ["DET", "NOUN", "VERB", "ADV"] and got[3] == ["DET", "NOUN", "VERB", "ADV"]
    assert got[4] == got[5] == [] and len(got[6]) == 3
    lemmas = {r["doc_id"]: r["tokens"] for r in tagging.lemmatized_in_context(docs, tagger).collect()}
    assert lemmas[1] == ["run", "walk", "slowly"] and lemmas[2] == ["dog", "run", "strangely"] and lemmas[4] == []
    rule = tagging.lemmatized_in_context(spark.createDataFrame([(1, "the dog talks slowly".split())], "doc_id int, tokens array<string>"), tagger).first()
    assert rule["tokens"] == ["dog", "talk", "slowly"]


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    starts, moves = rng.normal(size=3), rng.normal(size=(3, 3))
    scores = [rng.normal(size=(n, 3)) for n in (4, 1, 0, 6, 4, 2)]
    for s, got in zip(scores, tagging._viterbi(scores, starts, moves), strict=True):
        value = lambda p, s=s: (starts[p[0]] if p else 0) + sum(s[t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=len(s)), key=value)
        assert tuple(got.tolist()) == best


def test_sentence_classes(spark):
    rng = random.Random(2)
    ends = {"facts": "on monday the parties met", "law": "under article of the code", "ruling": "the court orders that costs"}
    make = lambda label: " ".join(rng.sample(ends[label].split(), 4) + rng.choices(["and", "so", "then", "it"], k=3))
    rows = [(k, label := rng.choice(list(ends)), make(label)) for k in range(400)]
    known = spark.createDataFrame(rows, "id int, label string, sentence string")
    classes = classify.fit_classes(known.filter("id < 300"), how=classify.Fitting(cells=1 << 10))
    got = classify.classified(known.filter("id >= 300"), classes).collect()
    assert all(abs(sum(r["scores"].values()) - 1) < 1e-9 and set(r["scores"]) == set(ends) for r in got)
    assert sum(max(r["scores"], key=r["scores"].get) == r["label"] for r in got) >= 95
    odd = classify.classified(spark.createDataFrame([(None,), ("",), ("law",)], "sentence string"), classes).collect()
    assert [r["scores"] is None for r in odd] == [True, True, False]
    assert spark.range(1).select(classify.word_features(F.lit("A b, c"), 3).alias("f")).first()["f"] == ["a", "b", "c", "a b", "b c", "a b c"]
    features = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "none", 5)], "id int, feature string, n int")
    weights = spark.createDataFrame([("x", "a", 0.5), ("y", "b", -1.0)], "feature string, label string, weight double")
    both = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "label string, intercept double")
    z = {r["id"]: r["scores"] for r in classify.weighed(features, weights, both, ["id"]).collect()}
    for k, (a, b) in {1: (1.1, -0.8), 2: (0.1, 0.2)}.items():
        assert abs(z[k]["a"] - math.exp(a) / (math.exp(a) + math.exp(b))) < 1e-12 and abs(z[k]["a"] + z[k]["b"] - 1) < 1e-12


def test_word_features_of_a_long_line_take_linear_time(spark):
    n = 60_000
    line = " ".join(f"w{k % 97}" for k in range(n))
    began = time.monotonic()
    got = spark.createDataFrame([(line,)], "s string").select(F.size(classify.word_features(F.col("s"), 3)).alias("n")).first()["n"]
    assert got == 3 * n - 3 and time.monotonic() - began < 60
    short = spark.createDataFrame([("a",), ("a b",), ("",)], "s string").select(classify.word_features(F.col("s"), 3).alias("f"))
    assert [r["f"] for r in short.collect()] == [["a"], ["a", "b", "a b"], []]
