"""Source divergence audit: how far the term use of each source lies from that of its language and of its other sources.

Smoothed shares are whole parts of 10^9, so all values are exact. Terms that a group lacks have one
share, its baseline: sums over all kept terms start from the baselines' value times their number, and
only terms that occur in either group correct it. Corrections for terms in both groups are summed over
tiles of sources (`Audit.block` a side), never written as rows. The top ranks of a group come from radix
selection: histograms over the bits of all groups' values, eight at a time, narrow each group down
to the bin of its kth value, and ties at that value are narrowed by the bytes of their names.

Cases: null text, lang and source are ''. A document is a row, whatever its doc_id; repeated rows
count each time. Groups without text or terms are there with counts of 0. A language that keeps no
term gives pairs of value 0 and no terms; one with a single source gives no pairs. An empty table
gives no rows. Texts may be of any length: a task holds one text's words and a bounded table of
counts. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, stored, tidy
from corpusloom.sources.staging import if_small
from corpusloom.sources.tables import spread

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")

@dataclass(frozen=True)
class Audit:
    #: Documents of a language that a term needs to be kept.
    min_documents: int = 10
    #: Ranks told of a group's terms.
    ranks: int = 10
    #: Rows of a group that are few enough to sort: selection narrows each group down to so many.
    sortable: int = 1000
    #: Distinct terms that a task counts before it passes its counts on.
    most_counts: int = 400_000
    #: Sources of a side of a tile; a task holds one tile of sums.
    block: int = 512


#: The value of a share p against a share q.
F_PQ = "((p - q) * (p - q)) div (p + q)"
COUNTS = "lang string, source string, term string, n long, documents long"


def _counter(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        one = 1 << 48  # a document, beside the occurrences; tables are passed on long before 2 ** 48 of them

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in groups.items():
                both = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                fixed = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(counts), np.int32))) for v in (lang, source)]
                term = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*fixed, term, pa.array(both & (one - 1)), pa.array(both >> 48)], names=["lang", "source", "term", "n", "documents"])

        seen = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = groups.setdefault((lang, source), {})
                before = len(counts)
                for term, n in Counter(TERM.findall(text.lower())).items():
                    counts[term] = counts.get(term, 0) + n + one
                size += len(counts) - before
                seen += 1
                if size >= most or seen >= 30_000:
                    yield from told()
                    groups, size, seen = {}, 0, 0
        yield from told()

    return run


def term_counts(docs: DataFrame, rule: Audit = Audit()) -> DataFrame:
    """lang, source, term, n, documents. Bytes are lower-cased, which turns A-Z alone; tasks add up before the shuffle."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = spread(rows, "text").mapInArrow(tidy(_counter(rule.most_counts)), COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)); decimals, as 10^9 n need not fit a long. Null where nothing is kept."""
    over = f"cast({total} + 2 * {kept} as decimal(20, 0))"
    return F.expr(f"1 + if({kept} > 0, cast(1000000000 * cast({n} + 2 as decimal(20, 0)) as decimal(38, 0)) div {over}, null)")


def _terms_by_tile(shares: DataFrame, block: int, many: bool) -> DataFrame:
    """lang, i, j, a, b: for each kept term the shares of its sources in blocks i and j (a list each), i <= j."""
    entry = F.struct("sid", "p", "p0")
    blocks = shares.groupBy("lang", "term", F.expr(f"sid div {block}").alias("block")).agg(F.collect_list(entry).alias("own"))
    same = blocks.select("lang", F.col("block").alias("i"), F.col("block").alias("j"), F.col("own").alias("a"), F.col("own").alias("b"))
    if not many:
        return same
    left = blocks.select("lang", "term", F.col("block").alias("i"), F.col("own").alias("a"))
    right = blocks.select("lang", "term", F.col("block").alias("j"), F.col("own").alias("b"))
    return same.unionByName(left.join(right, ["lang", "term"]).filter("i < j").select("lang", "i", "j", "a", "b"))


def _values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tiles(block: int):
    """Sums of a tile's corrections, for rows in order of tiles; pairs exist in bounded chunks of arrays only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sums = None, np.zeros((block, block), dtype=np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            a, b = np.nonzero(sums)
            if len(a):
                lang, i, j = tile
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + i * block), pa.array(b + j * block), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])
            sums[:] = 0

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)] if keys else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if keys[lo] != tile:
                    yield from told()
                    tile = keys[lo]
                for at in range(lo, hi, 256):
                    _add(sums, *(batch.column(k).slice(at, min(256, hi - at)) for k in (3, 4)), tile[1] == tile[2])
        yield from told()

    return run


def _add(sums: np.ndarray, left: pa.Array, right: pa.Array, same: bool) -> None:
    """Add f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for each term and each pair of its sources, one of either list."""
    sides = []
    for side in (left, right):
        flat = side.flatten()
        sides.append((np.diff(side.offsets.to_numpy()), *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))))
    (m, sid_a, p, p0), (k, sid_b, q, q0) = sides
    row = np.repeat(np.arange(len(m)), m)
    times, start = k[row], (np.cumsum(k) - k)[row]
    block = len(sums)
    for lo in range(0, len(row), 2048):  # at most 2,048 x block pairs at once
        t = times[lo : lo + 2048]
        one = np.repeat(np.arange(lo, lo + len(t)), t)
        other = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(start[lo : lo + 2048], t)
        if same:
            ahead = sid_a[one] < sid_b[other]
            one, other = one[ahead], other[ahead]
        a, a0, b, b0 = p[one], p0[one], q[other], q0[other]
        gain = _values(a, b) - _values(a, b0) - _values(a0, b) + _values(a0, b0)
        np.add.at(sums, (sid_a[one] % block, sid_b[other] % block), gain)


def _pair_values(shares: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), value."""
    one = groups.select("lang", F.col("sid").alias("a"), F.col("p0").alias("p"), "kept")
    two = groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("q"))
    # One row for each pair of the result: every pair of sources of a language is told.
    base = one.join(two, "lang").filter("a < b").select("lang", "a", "b", F.expr(f"coalesce(kept * ({F_PQ}), 0)").alias("value"))
    profile = shares.groupBy("lang", "sid", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    met = profile.join(two, "lang").filter("sid <> b")
    single = met.select("lang", F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b"), F.expr(f"times * ({F_PQ} - ((p0 - q) * (p0 - q)) div (p0 + q))").alias("value"))
    many = (groups.agg(F.max("sid")).head()[0] or 0) >= block
    tiles = _terms_by_tile(shares, block, many).repartition("lang", "i", "j", F.xxhash64("a")).sortWithinPartitions("lang", "i", "j")
    both = tiles.mapInArrow(tidy(_tiles(block)), "lang string, a long, b long, value long")
    # Each part combines before the shuffle: a task passes on one row for each pair that it has met.
    return base.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def top_ranked(rows: DataFrame, group: list[str], ranks: int, sortable: int = 1000) -> DataFrame:
    """`rows` (a stored table of group, item, value >= 0) with `rank`, from 1, up to `ranks`: value descending, then item by its bytes.

    A pass counts, for each group, the values that share the bits found so far by their next eight
    bits; the bin that holds the last rank gives those bits. A group is done when what lies in that
    bin and above is at most `sortable` rows, or the bin is one row, which nothing cuts further: then
    at most `ranks` rows are left, be that more than `sortable`. If a single value has more, the same
    is done by the next byte of the items, beyond what the bin's least and greatest item share. Groups
    are not null, and a group's items differ. A stored table.
    """
    scratch = Scratch()
    by = Window.partitionBy(*group)
    over = (F.col("before") + F.col("count") > sortable) & (F.col("count") > 1)

    def narrowed(counted: DataFrame, bins: Column) -> DataFrame:
        """Of each group's bins, in order, the one in which the last wanted rank falls; `before` and `need` follow."""
        counted = counted.withColumn("upto", F.sum("count").over(by.orderBy(bins))).withColumn("all", F.sum("count").over(by))
        last, above = F.least("need", "all"), F.col("upto") - F.col("count")
        found = counted.filter((F.col("upto") >= last) & (above < last))
        return found.withColumn("need", F.col("need") - above).withColumn("before", F.col("before") + above)

    top = rows.agg(F.max("value")).head()[0] or 0
    shift = max(0, -(-int(top).bit_length() // 8) * 8 - 8)
    # Bits: `low` is the bin's bits so far, `before` the rows above it, `need` the ranks still to be found in it.
    counted = rows.groupBy(*group, F.shiftright("value", shift).alias("low")).count().withColumns({"need": F.lit(ranks).cast("long"), "before": F.lit(0).cast("long")})
    told = [*group, "low", "need", "before", "count", "shift"]
    state = scratch.stored(narrowed(counted, F.desc("low")).withColumn("shift", F.lit(shift)).select(*told), "bits")
    while shift and state.filter(over).take(1):
        shift -= 8
        live = if_small(state.filter(over).select(*group, F.col("low").alias("high"), "need", "before"))
        met = rows.join(live, group).filter(F.shiftright("value", shift + 8) == F.col("high"))
        counted = met.groupBy(*group, F.shiftright("value", shift).alias("low"), "need", "before").count()
        found = narrowed(counted, F.desc("low")).withColumn("shift", F.lit(shift)).select(*told)
        state = scratch.stored(state.filter(~over).unionByName(found), "bits")
    # Ties: `head` is what the bin's items begin with, `most` the greatest of them; both in hexadecimal digits, which keep the order of bytes.
    item = F.hex(F.col("item").cast("binary"))
    told = [*group, "low", "need", "before", "count", "head", "most"]
    state = state.withColumns({"low": F.expr("shiftleft(low, shift)"), "head": F.lit(""), "most": F.lit(None).cast("string")}).select(*told)
    while state.filter(over).take(1):
        live = if_small(state.filter(over).select(*group, "low", "need", "before", "head"))
        ties = rows.join(live, group).filter(F.col("value") == F.col("low")).withColumn("hex", item).filter("substring(hex, 1, length(head)) = head")
        counted = ties.groupBy(*group, "low", "need", "before", F.expr("substring(hex, 1, length(head) + 2)").alias("cell")).agg(F.count(F.lit(1)).alias("count"), F.min("hex").alias("least"), F.max("hex").alias("most"))
        shared = F.expr("if(least = '', 0, size(filter(sequence(1, length(least) div 2), k -> substring(least, 1, 2 * k) = substring(most, 1, 2 * k))))")
        found = narrowed(counted, F.asc("cell")).withColumn("shared", shared).withColumn("head", F.expr("substring(least, 1, 2 * shared)"))
        state = scratch.stored(state.filter(~over).unionByName(found.select(*told)), "ties")
    bound = if_small(state.select(*group, "low", "most"))
    near = (F.col("value") > F.col("low")) | ((F.col("value") == F.col("low")) & (F.col("most").isNull() | (item <= F.col("most"))))
    few = rows.join(bound, group).filter(near).select(*rows.columns)
    ranked = few.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), F.asc("item")))).filter(F.col("rank") <= ranks)
    out = stored(ranked, "ranked")
    scratch.clear()
    return out


def audit(docs: DataFrame, rule: Audit = Audit()) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources of the language, and the terms that the source overuses most."""
    scratch = Scratch()
    counts = scratch.stored(term_counts(docs, rule), "counts")
    whole = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n")).filter(F.col("documents") >= rule.min_documents)
    vocabulary = scratch.stored(whole.drop("documents"), "vocabulary")
    kept = scratch.stored(counts.join(vocabulary, ["lang", "term"]), "kept")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "lang_total", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.stored(groups.select("*", number.cast("long").alias("sid"), F.lit(0).alias("none")).withColumn("p0", _share("none", "total", "kept")), "groups")
    known = if_small(groups)
    shares = kept.join(known, ["lang", "source"]).select(
        "lang", "source", "sid", "term", _share("n", "total", "kept").alias("p"), "p0", _share("lang_n", "lang_total", "kept").alias("q")
    )
    shares = scratch.stored(shares, "shares")
    terms = scratch.stored(shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(F_PQ).alias("value")), "overused")
    terms = top_ranked(terms, ["lang", "source"], rule.ranks, rule.sortable)
    pairs = _pair_values(shares, known, rule.block).select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("side"))
    names = known.select("lang", "sid", F.col("source").alias("name"))
    pairs = pairs.select("lang", "value", "side.own", "side.other")
    pairs = pairs.join(names.withColumnsRenamed({"sid": "own", "name": "source"}), ["lang", "own"]).join(names.withColumnsRenamed({"sid": "other", "name": "item"}), ["lang", "other"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", terms))]
    out = stored(parts[0].unionByName(parts[1]), "audit")
    scratch.clear()
    return out
