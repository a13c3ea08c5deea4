"""Parts of speech and lemmas in context: a hidden Markov tagger and rules of suffixes, learned from tagged words.

Counts of tag pairs and of words by tag are the model; words that it lacks are judged by their longest
suffix among those of rare words. Each token carries its log-likelihood of every tag; the likeliest
sequence of tags of a whole token array is found by Viterbi's steps, for many arrays at once. A lemma is that
of the word under its tag, else what the tag's rule for the longest suffix makes of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import KEPT_POS
from corpusloom.sources.staging import if_small, stored

#: Characters of the longest suffix that is learned.
SUFFIX = 4


@dataclass(frozen=True)
class Tagger:
    tags: tuple[str, ...]
    #: transitions[i][j]: log-probability of tag j behind tag i; starts: at the beginning.
    transitions: np.ndarray
    starts: np.ndarray
    #: word, scores: log-likelihood by tag. A stored table.
    words: DataFrame
    #: suffix, scores, of rare words; '' is there. A stored table.
    suffixes: DataFrame
    #: word, tag, lemma, and suffix, tag, cut, put: how many last characters go and what comes instead. Stored tables.
    lemmas: DataFrame
    rules: DataFrame


def _suffixes(word: str, least: int = 0):
    return F.transform(F.sequence(F.lit(least), F.least(F.length(word), F.lit(SUFFIX))), lambda k: F.substring(F.col(word), F.length(word) - k + 1, k))


def learn_tags(tagged: DataFrame, key: str = "doc_id", place: str = "i", word: str = "word", tag: str = "tag", lemma: str | None = None, rare: int = 10, smoothing: float = 0.1) -> Tagger:
    """A tagger of rows (key, place, word, tag, and lemma if named): the words of sequences in order. Words of at most `rare` rows teach suffixes."""
    rows = tagged.select(F.col(key).alias("key"), F.col(place).alias("i"), F.lower(word).alias("word"), F.col(tag).alias("tag"), (F.lower(lemma) if lemma else F.lit(None).cast("string")).alias("lemma")).filter("word is not null and tag is not null")
    rows = stored(rows, "tagged")
    by = Window.partitionBy("key").orderBy("i")
    pairs = rows.select(F.lag("tag").over(by).alias("before"), "tag").groupBy("before", "tag").count().collect()  # as many as pairs of tags
    tags = tuple(sorted({r["tag"] for r in pairs}))
    n = len(tags)
    at = {t: k for k, t in enumerate(tags)}
    counts, starts = np.full((n, n), smoothing), np.full(n, smoothing)
    for r in pairs:
        if r["before"] is None:
            starts[at[r["tag"]]] += r["count"]
        else:
            counts[at[r["before"]], at[r["tag"]]] += r["count"]
    each = stored(rows.groupBy("word", "tag").count(), "word-tags")
    shares = each.groupBy("tag").agg(F.sum("count").alias("all"))
    whole = {r["tag"]: r["all"] for r in shares.collect()}
    kinds = each.select("word").distinct().count()

    def scored(table: DataFrame, name: str) -> DataFrame:
        """Log of count of (name, tag) over the tag's, smoothed, by tag."""
        own = [F.coalesce(F.max(F.when(F.col("tag") == t, F.col("count"))), F.lit(0)) for t in tags]
        logs = [F.log((c + F.lit(smoothing)) / F.lit(whole[t] + smoothing * (kinds + 1))) for c, t in zip(own, tags, strict=True)]
        return table.groupBy(name).agg(F.array(*logs).alias("scores"))

    total = each.groupBy("word").agg(F.sum("count").alias("total")).filter(F.col("total") <= rare)
    few = each.join(total, "word").withColumn("suffix", F.explode(_suffixes("word"))).groupBy("suffix", "tag").agg(F.sum("count").alias("count"))
    # Of a suffix the tags' shares matter, not how common it is: its scores are over its own total.
    base = few.groupBy("suffix").agg(F.sum("count").alias("of"))
    own = [F.coalesce(F.max(F.when(F.col("tag") == t, F.col("count"))), F.lit(0)) for t in tags]
    logs = [F.log((c + F.lit(smoothing)) / (F.max("of") + F.lit(smoothing * n))) - F.lit(float(np.log(whole[t]))) for c, t in zip(own, tags, strict=True)]
    suffixes = stored(few.join(base, "suffix").groupBy("suffix").agg(F.array(*logs).alias("scores")), "suffixes")
    best = Window.partitionBy("word", "tag").orderBy(F.desc("count"), "lemma")
    found = rows.filter("lemma is not null").groupBy("word", "tag", "lemma").count().withColumn("place", F.row_number().over(best)).filter("place = 1")
    lemmas = stored(found.select("word", "tag", "lemma"), "lemmas")
    shared = F.expr("size(filter(sequence(1, least(length(word), length(lemma))), k -> substring(word, 1, k) = substring(lemma, 1, k)))")
    edits = lemmas.filter("word != '' and lemma != ''").withColumn("shared", shared).select("tag", F.explode(_suffixes("word")).alias("suffix"), (F.length("word") - F.col("shared")).cast("int").alias("cut"), F.expr("substring(lemma, shared + 1)").alias("put"))
    edits = edits.filter("cut <= length(suffix)").groupBy("suffix", "tag", "cut", "put").count()
    most = Window.partitionBy("suffix", "tag").orderBy(F.desc("count"), "cut", "put")
    rules = stored(edits.withColumn("place", F.row_number().over(most)).filter("place = 1").select("suffix", "tag", "cut", "put"), "suffix-rules")
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Tagger(tags, log(counts), log(starts), stored(scored(each, "word"), "word-scores"), suffixes, lemmas, rules)


def _viterbi(scores: list[np.ndarray], starts: np.ndarray, transitions: np.ndarray) -> list[np.ndarray]:
    """The likeliest tags of each sequence, the first named among equals; sequences step together, the longest first."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    live = [k for k in order if len(scores[k])]
    out = [np.zeros(len(s), dtype=np.int64) for s in scores]
    if not live:
        return out
    longest = len(scores[live[0]])
    state = np.stack([starts + scores[k][0] for k in live])
    back, ends = [], {}
    for t in range(1, longest + 1):
        n = sum(len(scores[k]) > t for k in live)
        for row in range(n, len(state)):
            ends[live[row]] = int(state[row].argmax())
        if not n:
            break
        paths = state[:n, :, None] + transitions[None]
        back.append(paths.argmax(axis=1))
        state = paths.max(axis=1) + np.stack([scores[k][t] for k in live[:n]])
    for row, k in enumerate(live):
        tag = ends[k]
        for t in range(len(scores[k]) - 1, -1, -1):
            out[k][t] = tag
            if t:
                tag = int(back[t - 1][row, tag])
    return out


def tagged_tokens(docs: DataFrame, tagger: Tagger, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, words array<struct<i, word, tag>>) of rows (key, tokens array), in order; each distinct word is looked up once. Rows that share a key count as one, keys are not null."""
    each = docs.select(F.col(key).alias("key"), F.posexplode_outer(tokens).alias("i", "word")).withColumn("low", F.lower("word"))
    unknown = each.select("low").distinct().join(tagger.words.select(F.col("word").alias("low")), "low", "left_anti").filter("low is not null")
    guessed = unknown.withColumn("suffix", F.explode(_suffixes("low"))).join(if_small(tagger.suffixes), "suffix")
    guessed = guessed.groupBy("low").agg(F.max_by("scores", F.length("suffix")).alias("scores"))
    known = stored(tagger.words.withColumnRenamed("word", "low").unionByName(guessed), "known")
    rows = each.join(if_small(known), "low", "left")
    held = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("i", "word", "scores")))
    lists = rows.groupBy("key").agg(F.array_sort(held).alias("words"))
    names, starts, transitions = tagger.tags, tagger.starts, tagger.transitions
    flat = np.zeros(len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("word", pa.string()), ("tag", pa.string())]))
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                words = part.column(1).to_pylist()
                scores = [np.array([w["scores"] if w["scores"] is not None else flat for w in ws]).reshape(-1, len(names)) for ws in words]
                found = _viterbi(scores, starts, transitions)
                told = [[{"i": w["i"], "word": w["word"], "tag": names[t]} for w, t in zip(ws, ts.tolist(), strict=True)] for ws, ts in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, kind)], names=["key", "words"])

    type_ = docs.schema[key].dataType.simpleString()
    return lists.mapInArrow(run, f"key {type_}, words array<struct<i:int,word:string,tag:string>>").withColumnRenamed("key", key)


def lemmatized_in_context(docs: DataFrame, tagger: Tagger, kept: Sequence[str] = KEPT_POS, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, tokens) with the lemmas of the words whose tag is among `kept`, in order."""
    rows = tagged_tokens(docs, tagger, key, tokens).select(F.col(key).alias("key"), F.explode_outer("words").alias("w")).select("key", "w.i", F.lower("w.word").alias("word"), "w.tag")
    kinds = rows.filter(F.col("tag").isin(*kept)).select("word", "tag").distinct()
    own = kinds.join(tagger.lemmas, ["word", "tag"], "left")
    ruled = own.filter("lemma is null").select("word", "tag", F.explode(_suffixes("word")).alias("suffix")).join(if_small(tagger.rules), ["suffix", "tag"])
    ruled = ruled.groupBy("word", "tag").agg(F.max_by(F.struct("cut", "put"), F.length("suffix")).alias("r"))
    made = own.join(ruled, ["word", "tag"], "left").select("word", "tag", F.coalesce("lemma", F.expr("concat(substring(word, 1, length(word) - r.cut), r.put)"), "word").alias("made"))
    met = rows.join(if_small(stored(made, "made")), ["word", "tag"], "left")
    held = F.array_sort(F.collect_list(F.when(F.col("made").isNotNull(), F.struct("i", "made"))))
    return met.groupBy("key").agg(F.transform(held, lambda x: x["made"]).alias(tokens)).withColumnRenamed("key", key)
