"""Language of each word in code-switched text by a linear-chain conditional random field.

A word's features are its character 2- to 4-grams, those that reach its first or last letter
standing for prefixes and suffixes, and the word itself as a lexicon entry; all are hashed into a
table of SLOTS rows with a weight for each language. Learned transition weights tie neighbours.
Forward-backward gives each word's probability of each language; a document's is the mean of its
words'.

Training takes a sample of at most `passages` passages of `chars` characters in all, as many of each
language (and at most `per_language`), the same from any part of a text, chosen by hash; so what
reaches the driver is bounded however many the languages and however long the texts are. Beyond
`passages` languages each gives one passage, shortened so that the total stays. Words are labelled
with their document's language and spliced into sequences that switch language now and then, so that
transitions are learned from switches. More than `languages` languages are refused, as the model has
a weight for each feature and language: 512 KB a language while it is trained.

Work is done at array speed for whole batches: features of all characters at once, the chain for
all documents of a slice in step. Memory follows the slice's text, not the batch's.

Cases: null text and text without letters give `und` with score 0; null doc_id is kept and never
used in training; rows are judged one by one, so repeated rows repeat; with no labelled rows every
text is `und`; empty tables work; a text of any length is judged whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import stored, tidy
from corpusloom.llm.wordstream import mix, multipliers

SLOTS = 1 << 16
SIZES = (2, 3, 4)
#: Characters of text that are worked on at once.
SLICE = 1_500_000
_KEY = multipliers(8, 29)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


@dataclass(frozen=True)
class Training:
    """passages: sampled in all, of `chars` characters each, and per_language of one of at most `languages` languages.
    steps: gradient steps of `batch` sequences of `words` words."""

    passages: int = 600
    per_language: int = 150
    chars: int = 4000
    languages: int = 1000
    steps: int = 150
    batch: int = 48
    words: int = 32
    rate: float = 0.3
    switch: float = 0.06
    seed: int = 5


class Features:
    """Slots of the features of all words of some texts; word w's lie from bounds[w] on, in each row."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        sizes = np.array([len(t) + 1 for t in lowered])
        chars = np.frombuffer("".join(["\n" + t for t in lowered] + ["\n"]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[chars]
        c = np.where(letter, chars, 1).astype(np.uint64)
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        self.bounds = np.flatnonzero(first)
        ends = np.cumsum(sizes)
        self.per_text = np.diff(np.searchsorted(self.bounds, np.concatenate([[0], ends])))
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(self.bounds):
            return
        run = c * _KEY[0]
        inner = np.ones(len(c), dtype=bool)
        for n in range(2, max(SIZES) + 1):
            back = np.concatenate([np.zeros(n - 1, dtype=np.uint64), c[: -(n - 1)]])
            run = run + back * _KEY[n - 1]
            if n > 2:
                inner[1:] &= letter[:-1] if n == 3 else np.concatenate([np.zeros(n - 3, dtype=bool), letter[: -(n - 2)]])
            valid = inner & (letter | np.concatenate([[False], letter[:-1]])) if n == 2 else inner
            if n in SIZES:
                self.rows.append(((mix(run + np.uint64(n)) % np.uint64(SLOTS)).astype(np.int32), valid))
        at = np.arange(len(c)) - np.repeat(np.concatenate([[0], self.bounds]), np.diff(np.concatenate([[0], self.bounds, [len(c)]])))
        own = np.where(letter, mix(c + at.astype(np.uint64) * _KEY[7]), np.uint64(0))
        self.lexicon = (mix(np.add.reduceat(own, self.bounds)) % np.uint64(SLOTS)).astype(np.int32)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """(words, languages): the sum of a word's weights."""
        if not len(self.bounds):
            return np.zeros((0, weights.shape[1]), dtype=np.float32)
        total = None
        for slots, valid in self.rows:
            w = weights[slots]
            w[~valid] = 0
            total = w if total is None else np.add(total, w, out=total)
        return np.add.reduceat(total, self.bounds, axis=0) + weights[self.lexicon]

    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """(slots, bounds): the slots of all words in a row, word w's from bounds[w] on."""
        n = len(self.bounds)
        word = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.append(self.bounds, len(self.rows[0][0])))) if n else np.zeros(0, np.int32)
        skipped = self.bounds[0] if n else 0
        owners = [word[v[skipped:]] for _, v in self.rows if n] + [np.arange(n, dtype=np.int32)]
        slots = [s[skipped:][v[skipped:]] for s, v in self.rows if n] + [self.lexicon if n else np.zeros(0, np.int32)]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(slots)[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def _chain(e: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word probabilities of sequences laid out by position: first words, second words, ...

    e: exp of emissions in that layout; lengths: sequences at each position, falling.
    """
    at = np.concatenate([[0], np.cumsum(lengths)])
    alpha = np.empty_like(e)
    alpha[: at[1]] = e[: at[1]] / e[: at[1]].sum(axis=1, keepdims=True)
    for t in range(1, len(lengths)):
        a = alpha[at[t - 1] : at[t - 1] + lengths[t]] @ step
        a *= e[at[t] : at[t + 1]]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[t] : at[t + 1]] = a
    back = np.ones((lengths[-1], e.shape[1]), dtype=e.dtype)
    out = alpha
    turned = np.ascontiguousarray(step.T)
    for t in range(len(lengths) - 1, 0, -1):
        ahead = e[at[t] : at[t + 1]] * back
        g = ahead @ turned
        g /= g.sum(axis=1, keepdims=True)
        back = np.ones((lengths[t - 1], e.shape[1]), dtype=e.dtype)
        back[: lengths[t]] = g
        here = slice(at[t - 1], at[t])
        out[here] = alpha[here] * back
    out /= out.sum(axis=1, keepdims=True)
    return out


class Crf:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def word_probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, probabilities of all words in a row)."""
        f = Features(texts)
        e = f.emissions(self.weights)
        n = f.per_text
        if not len(e):
            return n, e
        e = np.exp(e - e.max(axis=1, keepdims=True)) + np.float32(1e-30)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n))
        position = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        lengths = np.searchsorted(-n[order], -np.arange(1, n.max() + 1), side="right")
        place = np.concatenate([[0], np.cumsum(lengths)])[position] + np.repeat(rank, n)
        laid = np.empty_like(e)
        laid[place] = e
        return n, _chain(laid, np.exp(self.transitions).astype(np.float32), lengths)[place]

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, p = self.word_probabilities(texts)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(n)
        if len(some):
            mean = np.add.reduceat(p, (np.cumsum(n) - n)[some], axis=0, dtype=np.float64) / n[some, None]
            best = mean.argmax(axis=1)
            for k, b, m in zip(some.tolist(), best.tolist(), mean.max(axis=1).tolist(), strict=True):
                langs[k], scores[k] = self.languages[b], min(1.0, m)
        return langs, scores


def fit(texts: list[str], labels: list[str], how: Training = Training()) -> Crf:
    languages = sorted(set(labels))
    size, rng = len(languages), np.random.default_rng(how.seed)
    f = Features(texts)
    words, bounds = f.by_word()
    label = np.repeat(np.searchsorted(languages, labels), f.per_text)
    place = [np.flatnonzero(label == k) for k in range(size)]
    weights, moved = np.zeros((SLOTS, size), dtype=np.float32), np.full((SLOTS, size), 1e-6, dtype=np.float32)
    trans, trans_moved = np.zeros((size, size), dtype=np.float32), np.full((size, size), 1e-6, dtype=np.float32)
    usable = [k for k in range(size) if len(place[k])]
    for _ in range(how.steps if usable else 0):
        picked, gold = np.empty((how.words, how.batch), dtype=np.int64), np.empty((how.words, how.batch), dtype=np.int64)
        for b in range(how.batch):
            t = 0
            while t < how.words:
                k = int(rng.choice(usable))
                n = min(how.words - t, int(rng.geometric(how.switch)))
                s = int(rng.integers(len(place[k])))
                run = place[k][s : s + n]
                picked[t : t + len(run), b], gold[t : t + len(run), b] = run, k
                t += len(run)
        chosen = picked.reshape(-1)
        counts = bounds[chosen + 1] - bounds[chosen]  # one at least, the lexicon's
        starts = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(chosen)), counts)
        used, flat = np.unique(words[np.arange(counts.sum()) - starts[owner] + bounds[chosen][owner]], return_inverse=True)
        own = weights[used]
        e = np.add.reduceat(own[flat], starts, axis=0)
        e = np.exp(e - e.max(axis=1, keepdims=True)) + np.float32(1e-30)
        step = np.exp(trans)
        shape = (how.words, how.batch, size)
        grid = e.reshape(shape)
        alpha, beta = np.empty(shape, dtype=np.float32), np.ones(shape, dtype=np.float32)
        alpha[0] = grid[0] / grid[0].sum(axis=1, keepdims=True)
        for t in range(1, how.words):
            a = (alpha[t - 1] @ step) * grid[t]
            alpha[t] = a / a.sum(axis=1, keepdims=True)
        for t in range(how.words - 2, -1, -1):
            g = (grid[t + 1] * beta[t + 1]) @ step.T
            beta[t] = g / g.sum(axis=1, keepdims=True)
        node = alpha * beta
        node /= node.sum(axis=2, keepdims=True)
        ahead = grid[1:] * beta[1:]
        whole = ((alpha[:-1] @ step) * ahead).sum(axis=2, keepdims=True)
        edges = step * ((alpha[:-1] / whole).reshape(-1, size).T @ ahead.reshape(-1, size))
        delta = -node.reshape(-1, size)
        delta[np.arange(len(chosen)), gold.reshape(-1)] += 1
        order = np.argsort(flat, kind="stable")
        pull = np.add.reduceat(delta[owner[order]], np.searchsorted(flat[order], np.arange(len(used))), axis=0)
        pull = pull / how.batch - 1e-4 * own
        moved[used] += pull * pull
        weights[used] += how.rate * pull / np.sqrt(moved[used])
        found = np.zeros((size, size), dtype=np.float32)
        np.add.at(found, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), 1)
        pull = (found - edges) / how.batch - 1e-3 * trans
        trans_moved += pull * pull
        trans += how.rate * pull / np.sqrt(trans_moved)
    return Crf(languages, weights, trans)


def _sample(labelled: DataFrame, how: Training) -> DataFrame:
    """(doc_id, lang, piece, text) of as many passages of each language as the bounds allow; which ones, a hash says.

    Texts are not moved: passages are ranked by their places, and the few chosen places go to the texts.
    """
    own = labelled.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    last = F.greatest(F.ceil(F.length("text") / how.chars) - 1, F.lit(0)).cast("int")
    places = own.select("doc_id", "lang", "h", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "h", "piece"), "doc_id", "h", "piece")
    n = labelled.select("lang").distinct().count()
    if n > how.languages:
        raise ValueError(f"{n} languages; a model of at most {how.languages} is trained (Training.languages)")
    each = max(1, min(how.per_language, how.passages // max(1, n)))
    chars = min(how.chars, how.chars * how.passages // max(1, n * each))
    chosen = places.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= each)
    # At most max(passages, languages) rows, by construction.
    chosen = stored(chosen.select("doc_id", "lang", "h", "piece").distinct(), "places")
    met = own.join(F.broadcast(chosen), ["doc_id", "lang", "h"])
    return met.select("doc_id", "lang", "piece", F.substring("text", F.col("piece") * how.chars + 1, F.lit(chars)).alias("text")).distinct()


def train(labelled: DataFrame, how: Training = Training()) -> Crf | None:
    """A model of the rows (doc_id, text, lang), none of them null; None if there are none."""
    rows = stored(_sample(labelled, how), "sample").orderBy("doc_id", "lang", "piece", "text").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], how) if rows else None


def _slices(texts: list[str | None], languages: int) -> Iterator[tuple[int, int]]:
    """Of a batch: runs of texts that are worked on at once, the fewer the more languages there are."""
    start, held, most = 0, 0, SLICE * 4 // max(4, languages)
    for k, t in enumerate(texts):
        if held and held + len(t or "") > most:
            yield start, k
            start, held = k, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Adds lang_pred and score to (doc_id, text), text left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts, len(own.languages)):
                langs, scores = own.texts(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id and runs: array<struct<first, words, lang>> of neighbouring words with one likeliest language."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*shared.value)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts, len(own.languages)):
                n, p = own.word_probabilities(texts[a:b])
                best, out = p.argmax(axis=1), []
                for start, size in zip(np.cumsum(n) - n, n, strict=True):
                    x = best[start : start + size]
                    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if size else np.empty(0, dtype=int)
                    out.append([{"first": int(c), "words": int(d - c), "lang": own.languages[x[c]]} for c, d in zip(cut, np.append(cut[1:], size), strict=False)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, kind)], names=["doc_id", "runs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, runs array<struct<first:long,words:long,lang:string>>")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
