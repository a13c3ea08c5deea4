"""MinHash near-duplicates by an LSH forest, links confirmed on full shingle sets.

1. Each text gives its shingle set's size, a digest of the set and a MinHash signature. Equal
   sets collapse to their least doc_id, so a thousand exact copies cost one row from here on.
2. The forest has TREES orders. In each, representatives are sorted by their signature, a
   different part of it first. Rows that agree on the first DEPTH values form a region; a pair of
   similarity 0.8 shares none of the TREES regions with probability (1 - 0.8^3)^32 < 2e-10. The
   order is dealt by range, so a region of any size spreads over tasks; the region's rows come
   sorted by the longest common prefix, and a block of neighbours is as deep in the tree as the
   region is crowded. Of a block at most BLOCK rows, those that stand for others, go on to the next.
3. In a block, signatures estimate similarities. First the row that is nearest to all others is
   linked with its neighbours, then the nearest of the rest. These pairs are confirmed on the
   texts, which joins nearly all that belongs together. Pairs whose sizes rule a link out, or whose
   signatures estimate less than ESTIMATE, are left out; a pair of similarity 0.8 falls below
   ESTIMATE with probability below 1e-7.
4. A second pass looks at regions that still hold different components, whole, in blocks of rows
   against blocks of rows. Depth is adaptive: a region of more than CROWD rows is not compared but
   cut by STEP more values of the order, in as many more orders as keep the probability of missing
   a pair of similarity 0.8 below 1e-7; so rows that share a part of their text, like a site's
   pages, separate before they are compared. Regions still crowded at the last of LEVELS are
   compared all the same, so no link is given up.
   Rows with a fitting row of another component are gathered with their texts, block by block, and
   the sets of a block are intersected at once; only links that join components leave the task, so
   a crowded region never becomes a list of its pairs.
5. Components take their least doc_id.

Cases: null or empty texts have no shingles, link with nothing and are kept. Rows with null doc_id
link with nothing, have no component and are kept. Rows that share a doc_id and a text share
their result. Texts of fewer than `shingle` words are one shingle. A text may be of any length: its
shingles are hashed in slices, and its set is one row's. Other columns, whatever their names, are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, checked_broadcast, discard, stored, tidy
from corpusloom.llm.components import connected_components
from corpusloom.llm.wordstream import Words, documents, mix, multipliers

#: Words of a shingle, by the contract of op6; callers with another contract give their own.
SHINGLE = 4
PERCENT = 80
HASHES = 96
DEPTH = 3
TREES = HASHES // DEPTH
#: Least number of equal signature bytes for a pair to be proposed.
ESTIMATE = 55
#: As many make a link likely; the first pass proposes such pairs, and each row's nearest.
LIKELY = 68
#: Rows that are compared at once, and shingles of such rows: either cuts a region into parts, of which a block has two.
BLOCK = 1024
MOST_SHINGLES = 2_000_000
#: Regions of more rows are cut deeper, STEP values at a time, LEVELS times.
CROWD = 4096
STEP = 3
LEVELS = 5

_combine = cache(partial(multipliers, seed=7))
_A, _B = multipliers(HASHES, 11), multipliers(HASHES, 13)


def _shingles(h: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    by = _combine(shingle)
    if len(h) >= shingle:
        n = len(h) - shingle + 1
        g = h[:n] * by[0]
        for j in range(1, shingle):
            g = g + h[j : n + j] * by[j]
        return np.unique(mix(g))
    return mix(np.atleast_1d((h * by[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h)))) if len(h) else h


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(low, (s[k : k + 1024, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


FEATURES = "doc_id long, text_hash long, n_shingles long, digest binary, signature binary, sketch binary"


def _features(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column(0), batch.column(2)
        for row, stop, data, ends in documents(batch.column(1)):
            w = Words(data, ends, lower=True)
            sizes, digests, signatures, sketches = [], [], [], []
            for i in range(stop - row):
                s = _shingles(w.hash[w.first[i] : w.first[i + 1]], shingle)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest())
                low = _signature(s) if len(s) else None
                signatures.append(None if low is None else low.tobytes())
                sketches.append(None if low is None else low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, stop - row).cast(pa.int64()), hashes.slice(row, stop - row), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "signature", "sketch"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, HASHES)


@cache
def _orders(level: int) -> list[list[int]]:
    """The signature values that regions of a level agree on, tree by tree.

    Deeper levels take more trees, so that a pair of similarity 0.8 shares none with probability below 1e-7.
    """
    if not level:
        return [list(range(DEPTH * t, DEPTH * (t + 1))) for t in range(TREES)]
    depth = DEPTH + STEP * level
    trees = int(np.ceil(np.log(1e-7) / np.log1p(-((PERCENT / 100) ** depth))))
    rng = np.random.default_rng(1000 + level)
    return [rng.permutation(HASHES)[:depth].tolist() for _ in range(trees)]


def _regions(sig: np.ndarray, level: int = 0) -> np.ndarray:
    """For each signature the region that it falls in, tree by tree."""
    orders = _orders(level)
    out = np.empty((len(sig), len(orders)), dtype=np.uint64)
    for t, order in enumerate(orders):
        g = np.full(len(sig), (level << 32) + t + 1, dtype=np.uint64)
        for c in order:
            g = mix(g * np.uint64(0x9E3779B97F4A7C15) + sig[:, c].astype(np.uint64))
        out[:, t] = g
    return out


FOREST = "region long, deep long, id long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree the region and, as 16 bits for each of four levels, the order within."""
    for batch in batches:
        for k in range(0, len(batch), 2000):
            part = batch.slice(k, 2000)
            if not len(part):
                continue
            ids, sig = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1)).astype(np.uint64)
            deeps = []
            for t in range(TREES):
                deep = np.zeros(len(ids), dtype=np.uint64)
                for c in (np.arange(4) + DEPTH * (t + 1)) % HASHES:
                    deep = (deep << np.uint64(16)) | (sig[:, c] & np.uint64(0xFFFF))
                deeps.append(deep.view(np.int64))
            regions = _regions(sig).T.reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(regions), pa.array(np.concatenate(deeps)), pa.array(np.tile(ids, TREES))], names=["region", "deep", "id"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by region, those whose neighbour shares it; a task's first and last region may go on elsewhere."""
    held: pa.RecordBatch | None = None
    first = None
    for batch in batches:
        if not len(batch):
            continue
        if first is None:
            first = batch.column(0)[0].as_py()
        rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        region = rows.column(0).to_numpy()
        last = int(np.searchsorted(region, region[-1]))
        held = rows.slice(last).combine_chunks().to_batches()[0]
        region = region[:last]
        if last:
            same = region[1:] == region[:-1]
            keep = np.append(False, same) | np.append(same, False) | (region == first)
            yield from rows.slice(0, last).filter(pa.array(keep)).to_batches()
    if held is not None:
        yield held


PAIRS = "a long, b long"


def _agree(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Number of equal signature bytes for each row of `one` and of `other`."""
    out = np.empty((len(one), len(other)), dtype=np.uint8)
    step = max(1, 2_000_000 // (HASHES * len(other)))
    for k in range(0, len(one), step):
        out[k : k + step] = (one[k : k + step, None, :] == other[None, :, :]).sum(axis=2, dtype=np.uint8)
    return out


def _fits(equal: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (equal >= ESTIMATE) & (100 * np.minimum(size[:, None], sizes[None, :]) >= PERCENT * np.maximum(size[:, None], sizes[None, :]))


class _Region:
    """Rows (ids, sizes, signature bytes) of one region: at most BLOCK held from earlier blocks, and new."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def _all(self) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*self.rows, strict=True))

    def stars(self) -> list[tuple]:
        """Links from the rows that are near to most others; these are held, the latest ones if there are many.

        Rows near to none are not held: of a region of unlike rows nothing is.
        """
        ids, sizes, sig = self._all()
        equal = _agree(sig, sig)
        fits = _fits(equal, sizes, sizes) & (ids[:, None] != ids[None, :])
        left, out, hubs = fits.any(axis=1), [], np.zeros(len(ids), dtype=bool)
        close = np.where(fits, equal, 0).argmax(axis=1)
        a = np.flatnonzero(left)
        out.append((ids[a], ids[close[a]]))
        weight = (equal * fits).sum(axis=1, dtype=np.int64)
        for hub in np.argsort(-weight, kind="stable"):
            if left[hub]:
                b = np.flatnonzero(fits[hub] & left & (equal[hub] >= LIKELY))
                out.append((np.full(len(b), ids[hub]), ids[b]))
                hubs[hub] = True
                left[hub] = left[b] = False
        hubs = np.flatnonzero(hubs)[-BLOCK:]
        self.rows = [(ids[hubs], sizes[hubs], sig[hubs])]
        return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, deep, id, n_shingles, sketch) sorted by region and order."""
    state, at, fresh = _Region(), None, 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal fresh
        if fresh and sum(len(r[0]) for r in state.rows) > 1:
            for a, b in state.stars():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        fresh = 0

    for batch in batches:
        if not len(batch):
            continue
        region, ids, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(len(batch), HASHES)
        cuts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
            if region[lo] != at:
                yield from done()
                state.rows, at = [], region[lo]
            while lo < hi:
                take = min(hi - lo, BLOCK - fresh)
                state.rows.append((ids[lo : lo + take], sizes[lo : lo + take], sig[lo : lo + take]))
                fresh, lo = fresh + take, lo + take
                if fresh >= BLOCK:
                    yield from done()
    yield from done()


KEY = ["region", "i", "j"]
INVOLVED = "region long, i int, j int, id long, label long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal KEY, which are the first three columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield key, rows


def _involved(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block that fit a row of another component and meet it in no earlier tree that is looked at.

    Of two rows, both know in which trees of this level their region is too crowded to be.
    """
    for (region, i, j), rows in _blocks(batches):
        ids, labels, sizes, signatures, crowded = zip(*rows, strict=True)
        ids, labels, sizes = (np.array(x, dtype=np.int64) for x in (ids, labels, sizes))
        sig = np.frombuffer(b"".join(signatures), dtype="<u4").reshape(-1, HASHES)
        low, trees = sig.astype(np.uint8), _regions(sig, level)
        for k, gone in enumerate(crowded):
            if gone:
                trees[k, np.isin(trees[k].view(np.int64), gone)] = np.uint64(ids[k])
        hit = np.zeros(len(ids), dtype=bool)
        for k in range(0, len(ids), 128):
            a, b = np.nonzero(_fits(_agree(low[k : k + 128], low), sizes[k : k + 128], sizes) & (labels[k : k + 128, None] != labels[None, :]))
            a += k
            for c in range(0, len(a), 20_000):
                x, y = a[c : c + 20_000], b[c : c + 20_000]
                first = (trees[x] == trees[y]).argmax(axis=1)
                here = trees[x, first].view(np.int64) == region
                hit[x[here]] = hit[y[here]] = True
        if hit.any():
            n = int(hit.sum())
            cols = [pa.array([region] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(ids[hit]), pa.array(labels[hit])]
            yield pa.RecordBatch.from_arrays(cols, names=[*KEY, "id", "label"])


def _deeper(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Of (id, signature): the regions of a level."""
    for batch in batches:
        for k in range(0, len(batch), 1000):
            part = batch.slice(k, 1000)
            if len(part):
                regions = _regions(_matrix(part.column(1)), level)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), regions.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(regions.reshape(-1).view(np.int64)), pa.array(ids)], names=["region", "id"])


def _joining(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (KEY, id, label, text): links between components of a block, as many as join them."""
    for _, rows in _blocks(batches):
        ids, labels, texts = zip(*rows, strict=True)
        sets: list[np.ndarray] = []
        for _, _, data, ends in documents(pa.array(texts, pa.large_string())):
            w = Words(data, ends, lower=True)
            sets += [_shingles(w.hash[w.first[k] : w.first[k + 1]], shingle) for k in range(w.n)]
        size = np.array([len(x) for x in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        owner = np.repeat(np.arange(len(sets)), size)
        keep = count[column] > 1
        owner, column = owner[keep], shared[column[keep]]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for c in range(0, int(shared[-1]) + 1 if len(shared) else 0, 1024):
            here = (column >= c) & (column < c + 1024)
            dense = np.zeros((len(sets), 1024), dtype=np.float32)
            dense[owner[here], column[here] - c] = 1
            for k in range(0, len(sets), 256):
                both[k : k + 256] += dense[k : k + 256] @ dense.T
        linked = np.zeros(both.shape, dtype=bool)
        for k in range(0, len(sets), 256):
            linked[k : k + 256] = 100 * both[k : k + 256] >= PERCENT * (size[k : k + 256, None] + size[None, :] - both[k : k + 256])
        root = {x: x for x in labels}

        def top(x: int, root: dict = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            x, y = top(labels[a]), top(labels[b])
            if x != y:
                root[x] = y
                out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shingle_set(text: str, shingle: int) -> set:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*[w[j:] for j in range(shingle)], strict=False)) if len(w) >= shingle else {tuple(w)} if w else set()


def _linked(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, chunk, b, text), of each chunk first those of a itself, without b: the pairs that are links."""
    at, own = None, []
    for batch in batches:
        links = []
        for a, chunk, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _shingle_set(text, shingle)
            if b is None:
                if at != (a, chunk):
                    at, own = (a, chunk), []
                own.append(found)
            elif any(x and 100 * (both := len(x & found)) >= PERCENT * (len(x) + len(found) - both) for x in own):
                links.append((min(a, b), max(a, b)))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def _texts(ids: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text) of the documents in `ids`; other texts stay where they are while ids are few."""
    some, _ = checked_broadcast(scratch.stored(ids.select("id").distinct(), "proposed"), 1_000_000)
    return scratch.stored(docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("id"), "left_semi"), "texts")


#: Pairs of one row that are confirmed together; its text is sent once for so many.
CHUNK = 64


def _confirm(pairs: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """The pairs (a, b) that are links. Of a pair, that row is sent by chunk which is in most pairs."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, scratch)
    many = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
    many, _ = checked_broadcast(scratch.stored(many, "hubs"), 1_000_000)
    both = pairs.join(many.toDF("a", "na"), "a", "left").join(many.toDF("b", "nb"), "b", "left").fillna(0, ["na", "nb"])
    turned = F.col("nb") > F.col("na")
    parts = F.greatest(F.ceil(F.greatest("na", "nb") / CHUNK), F.lit(1)).cast("int")
    cut = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), parts.alias("parts"))
    cut = scratch.stored(cut.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("chunk"), "b"), "chunks")
    one = cut.select("a", "chunk").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    two = cut.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "chunk", "b", "text")
    met = one.unionByName(two).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return met.mapInArrow(tidy(partial(_linked, shingle=shingle)), PAIRS).distinct()


def _in_parts(rows: DataFrame) -> DataFrame:
    """`rows` (region, id, n and weight of the region, ...) with i and j: a copy for each block of two parts of the region that holds the row's part."""
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / MOST_SHINGLES), F.lit(1)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _mixed(named: DataFrame, reps: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of a level's regions with different components that may link: by block; and the (id, label) of crowded regions, if any.

    named: (region, id, label).
    """
    mixed = named.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("region", "n")
    mixed = scratch.stored(mixed, "mixed")
    own = reps.select(F.col("rep").alias("id"), "n_shingles", "signature")
    rows, left, gone = named.join(mixed, "region"), None, None
    if level < LEVELS and mixed.filter(F.col("n") > CROWD).limit(1).count():
        crowd = scratch.stored(rows.filter(F.col("n") > CROWD).groupBy("id", "label").agg(F.collect_list("region").alias("crowded")), "crowded")
        left, gone = crowd.select("id", "label"), crowd.select("id", "crowded")
        rows = rows.filter(F.col("n") <= CROWD)
    rows = rows.join(own, "id")
    rows = rows.join(gone, "id", "left") if gone is not None else rows.withColumn("crowded", F.lit(None).cast("array<long>"))
    weights = named.join(mixed, "region").join(own.select("id", "n_shingles"), "id").groupBy("region").agg(F.sum("n_shingles").alias("weight"))
    rows = _in_parts(rows.join(weights, "region")).select("region", "i", "j", "id", "label", "n_shingles", "signature", "crowded")
    found = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(tidy(partial(_involved, level=level)), INVOLVED)
    return scratch.stored(found, "involved"), left


def _rest(forest: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """Links (a, b) between the components that `labels` still holds apart."""
    named = scratch.stored(forest.select("region", "id").join(labels, "id", "left").select("region", "id", F.coalesce("label", "id").alias("label")), "labelled")
    involved, left = _mixed(named, reps, scratch, 0)
    level = 0
    while left is not None:
        level += 1
        deeper = left.join(reps.select(F.col("rep").alias("id"), "signature"), "id").select("id", "signature").mapInArrow(tidy(partial(_deeper, level=level)), "region long, id long")
        named = scratch.stored(deeper.join(left, "id").select("region", "id", "label"), "labelled")
        more, left = _mixed(named, reps, scratch, level)
        involved = involved.unionByName(more)
    texts = _texts(involved.select("id"), docs, scratch)
    met = involved.join(texts.withColumnRenamed("doc_id", "id"), "id").select(*KEY, "id", "label", "text")
    return met.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(tidy(partial(_joining, shingle=shingle)), PAIRS)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text)."""
    return _judged(docs, shingle).drop("text_hash")


def _judged(docs: DataFrame, shingle: int) -> DataFrame:
    scratch = Scratch()
    features = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidy(partial(_features, shingle=shingle)), FEATURES), "features")
    sets = features.filter("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    sets = stored(sets, "sets")
    own = features.select("doc_id", "digest", "n_shingles", "signature", "sketch").dropDuplicates(["doc_id", "digest"])
    reps = scratch.stored(own.join(sets.withColumnRenamed("digest", "set_digest"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("set_digest"))).select("rep", "n_shingles", "signature", "sketch"), "representatives")

    forest = reps.select("rep", "signature").mapInArrow(tidy(_forest), FOREST)
    forest = forest.repartitionByRange("region", "deep", "id").sortWithinPartitions("region", "deep", "id").mapInArrow(tidy(_crowded), FOREST)
    forest = scratch.stored(forest, "forest")
    ordered = forest.join(reps.select(F.col("rep").alias("id"), "n_shingles", "sketch"), "id").select("region", "deep", "id", "n_shingles", "sketch")
    pairs = ordered.repartitionByRange("region", "deep", "id").sortWithinPartitions("region", "deep", "id").mapInArrow(tidy(_stars), PAIRS).distinct()
    links = scratch.stored(_confirm(scratch.stored(pairs, "pairs"), docs, scratch, shingle), "links")
    labels = connected_components(links)
    more = scratch.stored(_rest(forest, labels, reps, docs, scratch, shingle), "links")
    if more.limit(1).count():
        labels = connected_components(links.union(more))
    scratch.clear()
    member = features.select("doc_id", "text_hash", "digest", "n_shingles").join(sets, "digest", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    out = member.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that are kept, and of rows that share a doc_id and a text one.

    Texts move only if more rows go than can be broadcast, or repeat.
    """
    judged = stored(_judged(docs, shingle).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "kept"), "judged")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    keys = judged.groupBy("__id", "__hash").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = stored(keys.filter("not kept").select("__id", "__hash"), "gone")
    again = stored(keys.filter("kept and n > 1").select("__id", "__hash"), "repeated")
    discard(judged)
    left = docs.join(checked_broadcast(gone, 1_000_000)[0], same, "left_anti")
    if not again.limit(1).count():
        return left
    again, _ = checked_broadcast(again, 1_000_000)
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").unionByName(once)
