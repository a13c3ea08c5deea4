"""Quality rules: word statistics, fixed limits, and robust multivariate outliers (native).

Statistics come from array functions within a row, so a text is never exploded. Verdicts come
from minimum-covariance-determinant estimates for each language and source. Three deterministic
starts are taken: medians with scaled median deviations, spatial signs around them, and the mean
and scatter of all rows. From each, concentration steps keep the part of the rows that is nearest
by Mahalanobis distance and estimate centre and scatter from it again. After two of them the start
with the least determinant goes on alone, until no group's determinant falls any more. Everything that crosses rows is a
sum or a count of integers, so it combines before the shuffle, a source that holds a third of the
rows is no hot spot, and a lost executor changes no digit.

The part that is kept is met up to a bin of 1/32 octave of distance: as rows of one bin are kept or
left together, ties are settled without an order, and a bin's few rows more or less are all that
tells the steps from exact ones. A step that would raise a determinant because of them is not taken.
A scatter gets a floor on its diagonal.

Cases: null or empty text has no words and fails the base rules; null language or source is a
group of its own; rows are judged one by one, so repeated rows and ids give repeated results;
an empty table gives an empty result. A group with fewer than `min_rows` rows is judged by
estimates from all rows of its language, by those from all rows if these are fewer too, and not at
all if the whole table has fewer. A text of any length is judged whole, in its row. Other columns,
whatever their names, go through `quality_filter` unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import BLANKS, checked_broadcast, discard, let, positions, split_words, stored

WINDOW = 5
SCALE = 4096
DIMS = 4
#: Width of the bins that medians are found in: a group has a few hundred, however many its rows.
BIN = 16


@dataclass(frozen=True)
class QualityRules:
    """Limits of the base rules and of the outlier test.

    coverage: part of a group's rows that its estimates rest on. steps: further concentration steps at
    most, should determinants fall on. tail: probability beyond the cut if rows were normal. floors: the least standard deviation taken for each transformed
    statistic, which also keeps a scatter of constant statistics invertible.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    coverage: float = 0.75
    steps: int = 10
    tail: float = 1e-9
    min_rows: int = 40
    floors: tuple[float, ...] = (0.08, 0.04, 0.12, 0.12)


def _repeat_words(words: Column) -> Column:
    """Words within a WINDOW-word window that the text holds twice or more."""

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def of_sorted(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j)["h"] == x["h"])
        repeated = F.filter(s, lambda x, j: F.coalesce((j > 0) & same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
        return let(F.sort_array(F.transform(repeated, lambda x: x["p"])), covered)

    def of_hashes(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(by_hash, of_sorted))

    hashes = F.transform(positions(F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    return let(hashes, of_hashes)


def text_statistics(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.struct(F.coalesce(text, F.lit("")).alias("t"), split_words(text).alias("w"), F.coalesce(lines, F.array().cast("array<string>")).alias("l")),
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            (F.length(v["t"]) - F.regexp_count(v["t"], F.lit(BLANKS))).cast("long").alias("word_chars"),
            F.regexp_count(v["t"], F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            _repeat_words(v["w"]).cast("long").alias("n_repeat_words"),
        ),
    )


def _vector(s: str) -> list[Column]:
    """Transformed statistics as fixed-point numbers: sums of them are exact in any order.

    Means of few words scatter more, so they are drawn to 5 characters a word by 20 words' weight.
    """
    c = lambda k: F.col(f"{s}.{k}").cast("double")
    x = [
        F.log((c("word_chars") + 100) / (c("n_words") + 20)),
        F.sqrt(c("n_symbols") / (c("word_chars") + 20)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 1)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 1)),
    ]
    return [F.round(v * SCALE).cast("long") for v in x]


def _chi2_cdf(x: float, d: int) -> float:
    """Lower regularised gamma function by its series."""
    a, z = d / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 2000):
        term *= z / (a + n)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, d) < p else (lo, mid)
    return hi


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


#: Estimates belong to a group and the start they come from.
KEY = ["g", "start"]
CENTRE, SCATTER, FACTOR = [f"m{i}" for i in range(DIMS)], [f"s{i}{j}" for i, j in PAIRS], [f"w{i}{j}" for i, j in PAIRS]


def _sums() -> list[Column]:
    """Count, sums and sums of products of q0, ...: whole numbers, so exact in any order."""
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    q = [F.col(f"q{i}") for i in range(DIMS)]
    return [F.count(F.lit(1)).alias("n"), *[big(q[i]).alias(f"a{i}") for i in range(DIMS)], *[big(q[i] * q[j]).alias(f"b{i}{j}") for i, j in PAIRS]]


SUMS = ["n", *[f"a{i}" for i in range(DIMS)], *[f"b{i}{j}" for i, j in PAIRS]]


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and scatter (lower triangle) of each group and start, in units of 1 / SCALE, from their sums."""
    f = lambda c: F.col(c).cast("double")
    means = [(f(f"a{i}") / f("n")).alias(f"m{i}") for i in range(DIMS)]
    cov = [((f(f"b{i}{j}") - f(f"a{i}") * f(f"a{j}") / f("n")) / F.greatest(f("n") - 1, F.lit(1.0)) * factor).alias(f"s{i}{j}") for i, j in PAIRS]
    return sums.select(*KEY, *means, *cov)


def _factored(est: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Group, start, centre m_i, w_ij (the inverse of the lower Cholesky factor of the scatter) and the scatter's log-determinant."""
    for i in range(DIMS):
        for j in range(i + 1):
            v = F.col(f"s{i}{j}") + (F.lit((floors[i] * SCALE) ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit((0.5 * floors[i] * SCALE) ** 2))) if i == j else v / F.col(f"l{j}{j}"))
    for j in range(DIMS):
        est = est.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, DIMS):
            v = F.lit(0.0)
            for k in range(j, i):
                v = v - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            est = est.withColumn(f"w{i}{j}", v / F.col(f"l{i}{i}"))
    logdet = F.lit(0.0)
    for i in range(DIMS):
        logdet = logdet + 2 * F.log(F.col(f"l{i}{i}"))
    return est.select(*KEY, *CENTRE, *FACTOR, logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of q0, ... from a factored estimate."""
    total = F.lit(0.0)
    for i in range(DIMS):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(f"q{j}") - F.col(f"m{j}"))
        total = total + F.pow(y, F.lit(2.0))
    return total


def _upto(counts: DataFrame, keys: list[str], part: float) -> DataFrame:
    """Of (keys, bin, c): the least bin up to which at least `part` of a key's rows lie."""
    w = Window.partitionBy(*keys)
    run = counts.withColumn("run", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    return run.filter(F.col("run") >= F.col("all") * F.lit(part)).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _medians(rows: DataFrame) -> DataFrame:
    """Start 0: median and scaled median deviation of each statistic, to within a bin; no correlation."""
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f"q{i}") / BIN) for i in range(DIMS)])).alias("dim", "bin"))
    counts = long.groupBy("g", "dim", "bin").agg(F.count(F.lit(1)).alias("c"))
    mid = _upto(counts, ["g", "dim"], 0.5).withColumnRenamed("bin", "mid")
    away = counts.join(mid, ["g", "dim"]).groupBy("g", "dim", F.abs(F.col("bin") - F.col("mid")).alias("bin")).agg(F.sum("c").alias("c"))
    mad = _upto(away, ["g", "dim"], 0.5).withColumnRenamed("bin", "mad")
    both = mid.join(mad, ["g", "dim"])
    pick = lambda k, c: F.max(F.when(F.col("dim") == k, c)).cast("double")
    return both.groupBy("g", F.lit(0).alias("start")).agg(
        *[pick(i, F.col("mid") * BIN + BIN // 2).alias(f"m{i}") for i in range(DIMS)],
        *[(pick(i, F.pow(F.col("mad") * (BIN * 1.4826), 2)) if i == j else F.max(F.lit(0.0))).alias(f"s{i}{j}") for i, j in PAIRS],
    )


def _signs(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Start 1: the scatter of directions from the medians, where a far row weighs no more than a near one.

    medians: factored estimates of start 0.
    """
    z = [(F.col(f"q{i}") - F.col(f"m{i}")) * F.col(f"w{i}{i}") for i in range(DIMS)]
    size = F.sqrt(sum((F.pow(x, F.lit(2.0)) for x in z[1:]), F.pow(z[0], F.lit(2.0))))
    met = _with_estimates(rows, medians).select("g", *[(F.round(F.when(size > 0, x / size).otherwise(F.lit(0.0)) * SCALE)).cast("long").alias(f"u{i}") for i, x in enumerate(z)])
    sums = met.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"b{i}{j}") for i, j in PAIRS])
    own, _ok = checked_broadcast(medians.drop("start", "logdet"), MAX_GROUPS)
    cov = [(F.col(f"b{i}{j}") / F.col("n") * (DIMS / SCALE**2) / (F.col(f"w{i}{i}") * F.col(f"w{j}{j}"))).alias(f"s{i}{j}") for i, j in PAIRS]
    return sums.join(own, "g").select("g", F.lit(1).alias("start"), *CENTRE, *cov)


def _starts(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Factored estimates of all starts."""
    medians = stored(_factored(_medians(rows), floors), "estimates")
    everything = _moments(rows.groupBy("g", F.lit(2).alias("start")).agg(*_sums()), 1.0)
    out = stored(medians.unionByName(_factored(_signs(rows, medians).unionByName(everything), floors)), "estimates")
    discard(medians)
    return out


#: Estimates of so many groups are broadcast. Beyond, each is joined in so many parts, as one group may hold a third of all rows.
MAX_GROUPS, SALTS = 100_000, 32


def _with_estimates(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows (g, salt, ...) with the estimates of their group, one row for each start that `est` has."""
    small, ok = checked_broadcast(est, 3 * MAX_GROUPS)
    if ok:
        return rows.join(small, "g")
    return rows.join(est.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))), ["g", "salt"])


def _step(rows: DataFrame, est: DataFrame, rules: QualityRules, factor: float) -> DataFrame:
    """The estimates after one concentration step.

    One pass over the rows gives counts and sums for each bin of distance; which bins hold the
    nearest rows, and their sums, then follow from that small table.
    """
    bin_of = F.floor(32 * F.log2(_distance() + 1e-3)).cast("long")
    binned = _with_estimates(rows, est).groupBy(*KEY, bin_of.alias("bin")).agg(*_sums())
    own = Window.partitionBy(*KEY)
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = binned.withColumns({"before": before, "all": F.sum("n").over(own)}).filter(F.col("before") < F.col("all") * F.lit(rules.coverage))
    return _factored(_moments(near.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]), factor), rules.floors)


#: Concentration steps after which only the best start of each group goes on.
FIRST_STEPS = 2
#: A step counts if the determinant falls by this part at least.
GAIN = 1e-3


def _concentrated(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """The estimate of least determinant of each group: g, m_i, w_ij, logdet.

    All starts take FIRST_STEPS steps; of each group that with the least determinant then goes on.
    A step that does not lower a group's determinant is not taken, so steps come to rest.
    """
    factor = rules.coverage / _chi2_cdf(chi2_quantile(rules.coverage, DIMS), DIMS + 2)
    fields = ["logdet", "start", *CENTRE, *FACTOR]
    est = _starts(rows, rules.floors)
    for k in range(FIRST_STEPS + rules.steps):
        new = _step(rows, est, rules, factor)
        if k == FIRST_STEPS - 1:
            new = new.groupBy("g").agg(F.min(F.struct(*fields)).alias("e")).select("g", *[F.col(f"e.{c}") for c in fields])
        if k >= FIRST_STEPS:
            new = new.join(est.select("g", F.struct(*fields).alias("was")), "g").withColumn("fell", F.col("logdet") < F.col("was.logdet") - GAIN)
            new = new.select("g", *[F.when(F.col("fell"), F.col(c)).otherwise(F.col(f"was.{c}")).alias(c) for c in fields], "fell")
        new = stored(new, "estimates")
        discard(est)
        est = new.drop("fell")
        if k >= FIRST_STEPS and not new.filter("fell").limit(1).count():
            break
    return est


def _levels(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """For languages and sources: g, the group that they are judged by (null where the table has too
    few rows), and groups, those whose estimates their rows go into."""
    sizes = stored(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per_lang = sizes.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"), (F.min("n") < rules.min_rows).alias("some_few"))
    known = sizes.join(per_lang, F.col("lang").eqNullSafe(F.col("l")))
    few = F.col("n") < rules.min_rows
    lone = few & (F.col("n_lang") < rules.min_rows)
    total, any_lone = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bool(known.filter(lone).limit(1).count())
    own, lang, every = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]")
    wide = F.col("some_few") & (F.col("n_lang") >= rules.min_rows)
    pooled = F.lit(any_lone and total >= rules.min_rows)
    level = known.select(
        F.col("lang").alias("k_lang"),
        F.col("source").alias("k_source"),
        F.when(~few, own).when(~lone, lang).when(pooled, every).alias("g"),
        F.array_compact(F.array(F.when(~few, own), F.when(wide, lang), F.when(pooled, every))).alias("groups"),
    )
    return checked_broadcast(stored(level, "levels"), 100_000)[0]


def _grouped(rows: DataFrame, level: DataFrame) -> DataFrame:
    """Adds g and groups."""
    on = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    return rows.join(level, on, "left").drop("k_lang", "k_source")


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    With `carry`, also `row`: a struct of all columns of `docs`.
    """
    s = docs.select(
        "doc_id", "lang", "source", *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []), text_statistics(F.col("text")).alias("s")
    )
    failed = (F.col("s.n_words") < rules.min_words) | (100 * F.col("s.n_repeat_words") > rules.max_repeat_percent * F.col("s.n_words"))
    rows = stored(s.withColumn("base_failed", failed), "statistics")
    vectors = [v.alias(f"q{i}") for i, v in enumerate(_vector("s"))]
    thin = rows.filter("not base_failed").select("lang", "source", *vectors)
    level = _levels(thin, rules)
    used = _grouped(thin, level).select(F.explode("groups").alias("g"), *[f"q{i}" for i in range(DIMS)])
    used = stored(used.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "vectors")
    est = _concentrated(used, rules)
    discard(used)
    outside = chi2_quantile(1 - rules.tail, DIMS)
    judged = _grouped(rows.select("*", *vectors, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")), level.drop("groups"))
    own, ok = checked_broadcast(est.drop("logdet", "start"), MAX_GROUPS)
    own = own if ok else own.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    judged = judged.join(own, ["g"] if ok else ["g", "salt"], "left").withColumn("distance", _distance())
    keep = ~F.col("base_failed") & F.coalesce(F.col("distance") <= outside, F.lit(True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"s.{n}").alias(n) for n in names], "base_failed", keep.alias("kept"), "distance", *(["row"] if carry else []))


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return quality_verdicts(docs, rules, carry=True).filter("kept").select("row.*")
