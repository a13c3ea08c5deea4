"""URL filters: host and path rules, and a character language-model ratio where no rule fits.

URLs that a rule accepts or rejects train two Markov models of variable order: a character is told
by the longest of its contexts of up to ORDER characters that was seen at least LEAST times, mixed
with the shorter ones by Witten and Bell's weights; contexts seen less often are pruned. A URL's
score is the difference of its log-likelihoods by its length. The cut between accepted and rejected
scores is calibrated by cross-fitting: URLs with a rule fall into FOLDS parts by hash, each part is
scored by models of the other parts, and the cut with the least sum of both error rates counts.
The models of all parts then judge the URLs without rule.

Gram counts are summed over all such URLs by Spark, one for each gram (contexts by a 64-bit hash),
so the models grow with the input. Up to `max_broadcast_grams` of them are broadcast; beyond, grams
and URLs meet in joins. A gram's part of a score is a fixed-point number, so both ways give the same.

Cases: null URLs and URLs without `://` have empty host and path; a null URL scores like an empty
one. With no accepted or no rejected URL the models say nothing, and URLs without rule are allowed;
where a part leaves no models of both kinds, the cut is 0 if that holds for all parts. Rows are
judged one by one, so repeated rows repeat (and all fall into one part); empty tables work; a URL
of any length is scored whole, together with few others; columns besides page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import discard, stored, tidy
from corpusloom.llm.wordstream import mix, multipliers

ORDER = 6
#: Occurrences of a context that count as evidence for it.
LEAST = 2
FOLDS = 3
#: Characters that are worked on at once.
SLICE = 400_000
#: Grams are joined in so many parts of each key, as some contexts and grams are in nearly every URL.
SALTS = 16
#: Of the fixed-point numbers that scores are summed in.
FIXED = float(1 << 32)
#: Alphabet that unseen characters share.
ALPHABET = 256.0
STEP = 0.005


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


PRODUCTION = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<name, verdict> of the longest rule that fits; null if none does."""
    kind = "struct<name:string,verdict:string>"
    found = F.lit(None).cast(kind)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


_KEY = multipliers(ORDER + 1, 23)


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of all URLs in a row (each with an end mark): the character, the hashes of
    its contexts of 0 to ORDER characters, and the URL that it belongs to."""
    texts = [(u or "") + "\x03" for u in urls]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    contexts = np.empty((ORDER + 1, len(chars)), dtype=np.uint64)
    run = np.zeros(len(chars), dtype=np.uint64)
    contexts[0] = mix(run + np.uint64(1))
    for k in range(1, ORDER + 1):
        back = np.concatenate([np.full(k, 2, dtype=np.uint64), chars[:-k]])[: len(chars)]
        back[within < k] = 2
        run = run + back * _KEY[k]
        contexts[k] = mix(run + np.uint64(k + 1))
    return chars, contexts, owner


def _pair(context: np.ndarray, char: np.ndarray) -> np.ndarray:
    return mix(context + char * _KEY[0])


def _slices(batches: Iterator[pa.RecordBatch], url: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most SLICE characters of URLs, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(url)), 0).to_numpy(zero_copy_only=False) + 1
        ends, k = np.cumsum(sizes), 0
        while k < len(batch):
            stop = max(k + 1, int(np.searchsorted(ends, ends[k] - sizes[k] + SLICE, side="right")))
            yield batch.slice(k, stop - k)
            k = stop


COUNTS = "accepted boolean, fold int, context long, char long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 2):
        kind = 2 * part.column(1).to_numpy(zero_copy_only=False).astype(np.int64) + part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        chars, contexts, owner = _grams(part.column(2).to_pylist())
        for k in np.unique(kind):
            own = kind[owner] == k
            keys = np.stack([contexts[:, own].reshape(-1), np.tile(chars[own], ORDER + 1)], axis=1)
            grams, n = np.unique(keys, axis=0, return_counts=True)
            cols = [pa.array(np.full(len(n), bool(k % 2))), pa.array(np.full(len(n), k // 2, dtype=np.int32)), pa.array(grams[:, 0].view(np.int64)), pa.array(grams[:, 1].astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["accepted", "fold", "context", "char", "n"])


def _ratios(n: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Log-likelihood of each character by the accepted less that by the rejected, in units of 1 / FIXED.

    By class (rejected, accepted), order and character: the counts of the gram and of its context,
    and the context's kinds of next character.
    """
    total = np.zeros(n.shape[2])
    for c, sign in ((0, -1), (1, 1)):
        p = np.full(n.shape[2], 1 / ALPHABET)
        for k in range(ORDER + 1):
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(seen[c, k] > 0, (n[c, k] + kinds[c, k] * p) / (seen[c, k] + kinds[c, k]), p)
        total += sign * np.log(p)
    return np.rint(total * FIXED).astype(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Of sorted keys: the values of the wanted ones, 0 for those that are not there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, v[at], 0) for v in values]


class UrlModel:
    """Sorted tables of both classes, in the order rejected, accepted: grams and their counts;
    contexts, their counts and kinds of next character."""

    def __init__(self, tables: list[tuple[np.ndarray, ...]]):
        self.tables = tables

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Log-likelihood of the accepted less that of the rejected, by length."""
        chars, contexts, owner = _grams(urls)
        _, at, back = np.unique(_pair(contexts[ORDER], chars), return_index=True, return_inverse=True)
        n, seen, kinds = (np.zeros((2, ORDER + 1, len(at))) for _ in range(3))
        for c, (pairs, pair_n, known, known_n, known_kinds) in enumerate(self.tables):
            for k in range(ORDER + 1):
                (n[c, k],) = _found(pairs, _pair(contexts[k, at], chars[at]), pair_n)
                seen[c, k], kinds[c, k] = _found(known, contexts[k, at], known_n, known_kinds)
        sizes = np.bincount(owner, minlength=len(urls))
        return np.add.reduceat(_ratios(n, seen, kinds)[back], np.cumsum(sizes) - sizes) / FIXED / sizes


@dataclass(frozen=True)
class WideModel:
    """A model of more grams than are broadcast: (accepted, context, char, n)."""

    grams: DataFrame


def counted(labelled: DataFrame) -> DataFrame:
    """(accepted, fold, context, char, n): the grams of all rows of (accepted, url), by part."""
    rows = labelled.select("accepted", _fold(F.col("url")).alias("fold"), "url").mapInArrow(tidy(_count), COUNTS)
    return stored(rows.groupBy("accepted", "fold", "context", "char").agg(F.sum("n").alias("n")), "url-grams")


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def train(grams: DataFrame, max_broadcast_grams: int = 2_000_000, without: int | None = None) -> UrlModel | WideModel | None:
    """The models of `counted` grams, of all parts or without one; None unless there are both kinds.

    Contexts that were seen fewer than LEAST times go: a context's grams are at most as many as the
    characters that follow it, so no key is hot.
    """
    own = grams if without is None else grams.filter(F.col("fold") != without)
    own = own.groupBy("accepted", "context", "char").agg(F.sum("n").alias("n"))
    seen = F.sum("n").over(Window.partitionBy("accepted", "context"))
    counts = stored(own.withColumn("seen", seen).filter(F.col("seen") >= LEAST).drop("seen"), "url-model")
    if counts.select("accepted").distinct().count() < 2:
        return None
    if counts.count() > max_broadcast_grams:
        return WideModel(counts)
    got = counts.toArrow()
    discard(counts)
    accepted = got["accepted"].to_numpy(zero_copy_only=False).astype(bool)
    context, char = (got[c].to_numpy().view(np.uint64) for c in ("context", "char"))
    n = got["n"].to_numpy()
    tables = []
    for kind in (~accepted, accepted):
        pairs = _pair(context[kind], char[kind])
        order = np.argsort(pairs)
        known, at = np.unique(context[kind], return_inverse=True)
        tables.append((pairs[order], n[kind][order], known, np.bincount(at, weights=n[kind]).astype(np.int64), np.bincount(at)))
    return UrlModel(tables)


def _url_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (at, url): the grams of each URL and how often it holds them."""
    for part in _slices(batches, 1):
        chars, contexts, owner = _grams(part.column(1).to_pylist())
        held, n = np.unique(np.stack([owner.astype(np.uint64), _pair(contexts[ORDER], chars)], axis=1), axis=0, return_counts=True)
        at = part.column(0).take(pa.array(held[:, 0].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([at, pa.array(held[:, 1].copy().view(np.int64)), pa.array(n.astype(np.int64))], names=["at", "gram", "times"])


def _gram_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (at, url): each gram's contexts of all orders and its character."""
    for part in _slices(batches, 1):
        chars, contexts, _ = _grams(part.column(1).to_pylist())
        gram, at = np.unique(_pair(contexts[ORDER], chars), return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (ORDER + 1)), pa.array(contexts[:, at].T.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), lists, pa.array(chars[at].astype(np.int64))], names=["gram", "contexts", "char"])


_TOLD = [f"{name}{c}" for name in ("n", "seen", "kinds") for c in (0, 1)]


def _gram_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (gram, one struct of counts for each order): the gram's part of a score."""
    for batch in batches:
        if len(batch):
            told = batch.column(1).flatten()
            n, seen, kinds = (np.stack([told.field(f"{name}{c}").to_numpy().reshape(-1, ORDER + 1).T.astype(float) for c in (0, 1)]) for name in ("n", "seen", "kinds"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_ratios(n, seen, kinds))], names=["gram", "ratio"])


def _joined(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """`rows` and their score by a model that stays a table."""
    of_class = lambda value, c: F.coalesce(F.sum(F.when(F.col("accepted") == F.lit(bool(c)), value)), F.lit(0))
    salted = lambda df: df.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    pairs = grams.groupBy("context", "char").agg(*[of_class(F.col("n"), c).alias(f"n{c}") for c in (0, 1)])
    known = grams.groupBy("context").agg(*[of_class(v, c).alias(f"{name}{c}") for name, v in (("seen", F.col("n")), ("kinds", F.lit(1))) for c in (0, 1)])

    key = F.unhex(F.md5(F.coalesce("url", F.lit(""))))
    own = stored(rows.select(key.alias("at"), F.coalesce("url", F.lit("")).alias("url")).dropDuplicates(["at"]), "urls")
    wanted = own.mapInArrow(_gram_contexts, "gram long, contexts array<long>, char long").dropDuplicates(["gram"])
    wanted = wanted.select("gram", "char", F.pmod("gram", F.lit(SALTS)).cast("int").alias("salt"), F.posexplode("contexts").alias("k", "context"))
    met = wanted.join(salted(pairs), ["context", "char", "salt"], "left").join(salted(known), ["context", "salt"], "left").fillna(0, _TOLD)
    told = met.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", *_TOLD))).alias("told"))
    ratios = stored(told.mapInArrow(_gram_ratios, "gram long, ratio long"), "url-ratios")

    held = own.mapInArrow(_url_grams, "at binary, gram long, times long").withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    sums = held.join(salted(ratios), ["gram", "salt"]).groupBy("at").agg(F.sum(F.col("ratio") * F.col("times")).alias("total"), F.sum("times").alias("size"))
    score = F.col("total").cast("double") / FIXED / F.col("size")
    return rows.withColumn("at", key).join(sums, "at").select(*rows.columns, score.alias("score"))


def _scored(rows: DataFrame, model: UrlModel | WideModel) -> DataFrame:
    """`rows` (with url) and their score; `rows` has the columns named here and no other."""
    if isinstance(model, WideModel):
        return _joined(rows, model.grams)
    shared = rows.sparkSession.sparkContext.broadcast(model.tables)
    at = rows.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UrlModel(shared.value)
        for part in _slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.scores(part.column(at).to_pylist()))], names=[*part.schema.names, "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(tidy(run), schema + ", score double")


def calibrate(labelled: DataFrame, grams: DataFrame, max_broadcast_grams: int = 2_000_000) -> float:
    """The score with the least sum of error rates, from a histogram of steps of STEP within -20 to 20.

    Each row is scored by models that have not seen it; 0 where no part leaves models of both kinds.
    """
    cell = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) / STEP).cast("int")
    size = int(40 / STEP) + 2
    cells = np.zeros((2, size))
    for k in range(FOLDS):
        model = train(grams, max_broadcast_grams, without=k)
        if model is not None:
            part = labelled.select("accepted", "url").filter(_fold(F.col("url")) == k)
            rows = _scored(part, model).groupBy("accepted", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
            cells[rows["accepted"].to_numpy(zero_copy_only=False).astype(int), rows["cell"].to_numpy() + int(20 / STEP)] += rows["n"].to_numpy()
    if not cells.sum(axis=1).all():
        return 0.0
    parts = cells / cells.sum(axis=1, keepdims=True)
    below = np.concatenate([[0], np.cumsum(parts[1])])[:-1]
    above = 1 - np.concatenate([[0], np.cumsum(parts[0])])[:-1]
    errors = below + above
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((best[len(best) // 2]) * STEP - 20)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = PRODUCTION, max_broadcast_grams: int = 2_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides or the models say nothing)."""
    url = F.col("url")
    judged = pages.select("page_id", url.cast("string").alias("url"), host(url).alias("host"), path(url).alias("path"))
    judged = judged.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "url", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("verdict"))
    labelled = judged.filter("rule is not null").select((F.col("verdict") == "allow").alias("accepted"), "url")
    grams = counted(labelled)
    model = train(grams, max_broadcast_grams)
    if model is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    cut = calibrate(labelled, grams, max_broadcast_grams)
    discard(grams)
    out = _scored(judged, model)
    free = F.col("rule").isNull()
    by_score = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_score).alias("verdict"), F.when(free, F.col("score")).alias("score"))
