"""Benchmark decontamination by winnowing (native).

A window is WINDOW consecutive item words. Of its K-word grams, both sides keep the one with the
least hash, so a shared window always shares a kept gram: every shared span of WINDOW words is
found. Kept grams of documents meet those of the benchmark in a hash join; each hit is extended
word by word along its diagonal, which also rules out hash collisions, and counts if the matching
run reaches WINDOW words. Of grams that tie in a window, documents keep one and the benchmark
keeps all, so the right diagonal is always among the hits.

The benchmark side is broadcast in slices of at most `max_broadcast` rows and of bounded bytes, dealt
by a hash of all that tells rows apart and checked; a larger benchmark takes more passes over the
documents, never a larger broadcast.
Document words stay in their row: only hits (a start, an end, item ids) reach the shuffle, and
what is gathered for one document is bounded by its own length.

Items of fewer than WINDOW words are matched whole, by a gram of their own length.

Cases: null or empty text has no words, is hit by nothing and comes back; items without words
and items with null item_id are ignored; items with one item_id count once; equal rows of
`documents` give one result row each; empty tables on either side work. A text of any length stays
in its row; a gram's position is held modulo 2^24, and each place that it may stand for is tried.
Other columns, whatever their names, are not read, and come back from `decontaminate`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import MOST_BYTES, checked_broadcast, let, positions, stored, table_bytes

WINDOW = 13
K = 5
SPAN = WINDOW - K + 1
#: A gram is one number: 40 bits of hash above so many bits of its position.
BITS = 24

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Contamination:
    """A document is contaminated if at least one in `one_in` of its words is hit."""

    one_in: int = 20
    max_broadcast: int = 400_000


def folded_words(text: Column) -> Column:
    """Words of digits, letters and all beyond ASCII, with A-Z (and nothing else) in lower case."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def _grams(words: Column, k: int) -> Column:
    return F.transform(positions(F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i + 1, k)))


def _keyed(words: Column, keep_position: bool) -> Column:
    """For each gram its hash in the upper bits; below, the position if wanted."""
    low = lambda i: i.bitwiseAND(F.lit((1 << BITS) - 1)) if keep_position else F.lit(0)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.transform(positions(F.size(h) - (K - 1)), lambda i: F.shiftleft(F.xxhash64(F.slice(h, i + 1, K)), BITS).bitwiseOR(low(i).cast("long"))))


def _least(keys: Column) -> Column:
    return F.transform(positions(F.size(keys) - (SPAN - 1)), lambda i: F.array_min(F.slice(keys, i + 1, SPAN)))


def _benchmark_grams(items: DataFrame) -> DataFrame:
    """(len, h, gram, before, after, items): all grams that are least in a window, ties included.

    before: the item's words before the gram, nearest first; at most WINDOW - K of either side.
    Grams with equal surroundings are one row.
    """
    w = items.filter(F.col("item_id").isNotNull()).select("item_id", folded_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    side = WINDOW - K

    def chosen(q: Column) -> Column:
        first = lambda p: F.greatest(p - (SPAN - 1), F.lit(0))
        last = lambda p, m: F.least(p, F.size(m) - 1)
        return let(
            _least(q),
            lambda m: F.filter(
                F.transform(q, lambda h, p: F.when(F.array_max(F.slice(m, first(p) + 1, last(p, m) - first(p) + 1)) == h, F.struct(F.shiftrightunsigned(h, BITS).alias("h"), p.alias("p")))),
                lambda s: s.isNotNull(),
            ),
        )

    long = w.filter(F.size("w") >= WINDOW).select("item_id", "w", F.explode(let(_keyed(F.col("w"), False), chosen)).alias("s"))
    p = F.col("s.p")
    start = F.greatest(p - side, F.lit(0))
    long = long.select(
        "item_id",
        F.lit(K).alias("len"),
        F.col("s.h").alias("h"),
        F.slice("w", p + 1, K).alias("gram"),
        F.reverse(F.slice("w", start + 1, p - start)).alias("before"),
        F.slice("w", p + K + 1, side).alias("after"),
    )
    none = F.array().cast("array<string>")
    short = w.filter(F.size("w") < WINDOW).select("item_id", (-F.size("w")).alias("len"), F.xxhash64("w").alias("h"), F.col("w").alias("gram"), none.alias("before"), none.alias("after"))
    return long.unionByName(short).groupBy("len", "h", "gram", "before", "after").agg(F.collect_set("item_id").alias("items"))


def _run(ours: Column, theirs: Column) -> Column:
    """Number of leading elements in which two arrays agree."""
    differ = F.array_position(F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(ours)).cast("int")


def _runs(words: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, n_words, document, run, items): runs of WINDOW words and more, and a row without run for each document."""
    kept = F.array_distinct(let(_keyed(F.col("w"), True), _least))
    rows = words.select("key", "w", F.explode(F.concat(F.array(F.lit(None).cast("long")), kept)).alias("x"))
    met = rows.join(grams, F.shiftrightunsigned("x", BITS) == F.col("h"), "left").filter(F.col("x").isNull() | F.col("h").isNotNull())
    # A position is known up to multiples of 2 ** BITS; where a text is that long, each is tried.
    low = F.col("x").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    tries = F.when(F.col("x").isNotNull(), F.sequence(low, F.greatest(low, F.size("w") - 1), F.lit(1 << BITS))).otherwise(F.array(F.lit(None).cast("int")))
    met = met.withColumn("p", F.explode(tries))
    side, p = WINDOW - K, F.col("p")
    start = F.greatest(p - side, F.lit(0))
    met = met.select(
        "key",
        "p",
        F.size("w").alias("n_words"),
        (F.slice("w", p + 1, K) == F.col("gram")).alias("same"),
        _run(F.reverse(F.slice("w", start + 1, p - start)), F.col("before")).alias("left"),
        _run(F.slice("w", p + K + 1, side), F.col("after")).alias("right"),
        "items",
    )
    whole = F.col("same") & (F.col("left") + K + F.col("right") >= WINDOW)
    run = F.struct((p - F.col("left")).alias("from"), (p + K + F.col("right")).alias("to"))
    return met.select("key", "n_words", p.isNull().alias("document"), F.when(whole, run).alias("run"), F.when(whole, F.col("items")).alias("items")).filter("document or run is not null")


def _short_runs(words: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """The same for occurrences of items that have n words in all; no rows without run."""
    rows = words.select("key", "w", F.posexplode(_grams(F.col("w"), n)).alias("p", "x"))
    met = rows.join(grams, F.col("x") == F.col("h")).filter(F.slice("w", F.col("p") + 1, n) == F.col("gram"))
    run = F.struct(F.col("p").alias("from"), (F.col("p") + n).alias("to"))
    return met.select("key", F.size("w").alias("n_words"), F.lit(False).alias("document"), run.alias("run"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination()) -> DataFrame:
    """key (struct of doc_id and the text's hash), copies, n_words, n_hit, items (ids in text order), contaminated; one row for each distinct key."""
    grams = stored(_benchmark_grams(benchmark), "benchmark")
    n = grams.count()
    lengths = [r[0] for r in grams.select("len").distinct().limit(WINDOW + 1).collect()]
    words = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), folded_words(F.col("text")).alias("w"))
    slices = max(1, -(-n // rule.max_broadcast), -(-table_bytes(grams) // (MOST_BYTES // 2)))
    part_of = F.pmod(F.xxhash64("gram", "before", "after"), F.lit(slices))
    parts = [grams if slices == 1 else grams.filter(part_of == i) for i in range(slices)]
    found = []
    for i, part in enumerate(parts):
        small = lambda n, part=part: checked_broadcast(part.filter(F.col("len") == n), 2 * rule.max_broadcast)[0]
        runs = _runs(words, small(K))
        found += [runs if i == 0 else runs.filter("not document"), *[_short_runs(words, small(-n), n) for n in sorted(-x for x in lengths if x < 0)]]
    rows = reduce(DataFrame.unionByName, found)

    def union_length(runs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total"))
        step = lambda a, x: F.struct(F.greatest(a["reach"], x["to"]).alias("reach"), (a["total"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], a["reach"]))).alias("total"))
        return F.aggregate(F.array_sort(runs), zero, step)["total"]

    got = rows.groupBy("key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.col("document").cast("long")).alias("copies"),
        F.collect_set("run").alias("runs"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
    )
    n_hit = union_length(F.col("runs")).cast("long")
    return got.select("key", "copies", "n_words", n_hit.alias("n_hit"), "items").withColumn("contaminated", (F.col("n_hit") > 0) & (rule.one_in * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination()) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    bad = stored(contamination(docs, benchmark, rule).filter("contaminated").select(F.col("key.doc_id").alias("__doc"), F.col("key.text_hash").alias("__hash")), "contaminated")
    bad, _ = checked_broadcast(bad, 1_000_000)
    on = docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    return docs.join(bad, on, "left_anti")
