"""Substring dedup with suffix automata of reference shards.

Within one collection (`repeated_spans`), a window of WINDOW words goes if it also starts in a
document with a smaller doc_id. Every earlier document is a reference, so automata of whole
shards could not be broadcast, and streaming all documents past all shards would be quadratic.
Shards are cut by content instead, so that a reference and all that can match it meet:

1. Each window belongs to the K-gram of it that has the least hash. Neighbouring windows with one
   such gram are a segment (at most SPAN windows). A window occurs only in segments of its gram.
2. A document's segment that equals one of an earlier document is covered whole. Segments are equal
   if the 64-bit hashes of their gram and of all their words are, 128 bits in all: among 10^13
   segments a wrong match has a probability below 10^-12. That is decided in the task that reads
   both where one does, which leaves one document for each segment and task: a passage in a third
   of all documents is no hot spot. The rest meet by gram, packed, in buckets whose number follows
   from the size of the input.
3. Grams that still have different segments of several documents are the reference shards. Their
   segments' words are fetched; in order of doc_id each is streamed past the automaton of the
   shard's earlier ones for matching statistics, then added. Lengths of WINDOW and more are spans
   to remove. Shards of more than SHARD segments are split by windows, which keeps them small; of a
   window that many segments hold, the task that fetches their words sends on the earliest alone.

Against a given reference (`match_reference`) whose shards have a proven size, automata are
broadcast and every document is streamed past each.

Cases: null or empty texts have no words and come back. Rows with null doc_id come back whole and
are no reference. Rows that share a doc_id are one document: none is a reference for the other,
and each loses what is found in any of them. Texts that lose nothing are returned unchanged. A text
of any length is cut whole, in its row. Other columns, whatever their names, come back. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.automaton import SuffixAutomaton
from corpusloom.llm.common import Scratch, checked_broadcast, split_words, stored, table_bytes, tidy
from corpusloom.llm.wordstream import Words, documents, mix, multipliers

WINDOW = 13
K = 6
SPAN = WINDOW - K + 1
SHARD = 4096
#: Segments that a task combines before they are sent.
COMBINED = 400_000

#: Bytes of input for each bucket of packed segments, which a task holds one at a time.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 1 << 21

_GRAM = multipliers(K, 17)
_BASE = int(multipliers(1, 19)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, segment hash, document, first word in it, windows) of all segments of a slice."""
    h, n = w.hash, len(w.hash)
    none = tuple(np.empty(0, dtype=t) for t in ("u8", "u8", "i8", "i8", "i8"))
    if n < WINDOW:
        return none
    grams = h[: n - K + 1] * _GRAM[0]
    for j in range(1, K):
        grams = grams + h[j : n - K + 1 + j] * _GRAM[j]
    grams = mix(grams)
    low, at = grams[: n - WINDOW + 1].copy(), np.arange(n - WINDOW + 1)
    for j in range(1, SPAN):
        other = grams[j : n - WINDOW + 1 + j]
        less = other < low
        low[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    doc = np.repeat(np.arange(w.n), np.diff(w.first))
    start = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(start):
        return none
    cut = np.flatnonzero(np.append(True, (at[start[1:]] != at[start[:-1]]) | (doc[start[1:]] != doc[start[:-1]])))
    windows = np.diff(np.append(cut, len(start)))
    begin = start[cut]
    end = begin + windows + WINDOW - 1
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
    whole = mix((prefix[end] - prefix[begin]) * _powers(_INVERSE, n)[begin] + windows.astype(np.uint64))
    return low[begin], whole, doc[begin], begin - w.first[doc[begin]], windows


PACKED = "bucket int, grams binary, wholes binary, docs binary, ats binary"


def _earliest(gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by gram, segment and document, and whether each has its segment's least document."""
    order = np.lexsort((at, doc, whole, gram))
    gram, whole, doc = gram[order], whole[order], doc[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]))
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, doc == first


def _packer(buckets: int):
    def packed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, whole, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, early = _earliest(gram, whole, doc, at)
        gram, whole, doc, at = gram[order], whole[order], doc[order], at[order]
        # What is decided here travels with the rest, marked by a gram of 0, in buckets by document.
        gram = np.where(early, np.maximum(gram, np.uint64(1)), np.uint64(0))
        place = np.where(early, gram, mix(doc.view(np.uint64))) % np.uint64(buckets)
        by = np.argsort(place, kind="stable")
        place = place[by]
        cut = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
        names = ("bucket", "grams", "wholes", "docs", "ats")
        for k in range(0, len(cut) - 1, 512):
            rows = [(int(place[a]), *(x[by[a:b]].tobytes() for x in (gram, whole, doc, at))) for a, b in zip(cut[k : k + 512], cut[k + 1 : k + 513], strict=False)]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, stop, data, ends in documents(batch.column(1)):
                gram, whole, doc, start, windows = _segments(Words(data, ends, lower=False))
                if len(gram):
                    parts.append((gram, whole, ids[row:stop][doc], start * 16 + windows))
                    held += len(gram)
                if held >= COMBINED:
                    yield from packed(parts)
                    parts, held = [], 0
        if held:
            yield from packed(parts)

    return run


FOUND = "shard long, doc_id long, at long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed segments sorted by bucket: covered segments (shard 0), and those of grams with several documents."""

    def solved(blobs: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, whole, doc, at = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*blobs, strict=True), ("<u8", "<u8", "<i8", "<i8"), strict=True))
        done = gram == 0
        out = [(np.zeros(int(done.sum()), dtype=np.int64), doc[done], at[done])]
        gram, whole, doc, at = gram[~done], whole[~done], doc[~done], at[~done]
        if len(gram):
            order, early = _earliest(gram, whole, doc, at)
            gram, doc, at = gram[order], doc[order], at[order]
            out.append((np.zeros(int((~early).sum()), dtype=np.int64), doc[~early], at[~early]))
            gram, doc, at = gram[early], doc[early], at[early]
            new = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            several = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new)
            keep = np.repeat(several, np.diff(np.append(new, len(gram))))
            out.append((gram[keep].view(np.int64), doc[keep], at[keep]))
        shard, doc, at = (np.concatenate(x) for x in zip(*out, strict=True))
        for k in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (shard, doc, at)], names=["shard", "doc_id", "at"])

    bucket, blobs = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != bucket and blobs:
                yield from solved(blobs)
                blobs = []
            bucket = row[0]
            blobs.append(row[1:])
    if blobs:
        yield from solved(blobs)


PIECES = "shard long, part int, doc_id long, start long, words string"
#: Windows of split shards that a task gathers before it sends them.
GATHERED = 100_000
#: What is decided already is dealt by document into so many parts of shard 0, without words.
DECIDED = 1 << 20


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of wanted segments (text, array<struct<shard, at, parts>>), or of their windows where a shard is split."""
    import xxhash

    split: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}

    def sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 20_000):
            cols = list(zip(*rows[k : k + 20_000], strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], names=["shard", "part", "doc_id", "start", "words"])

    def earliest() -> list[tuple]:
        """The windows gathered: words go with the earliest document of each alone, the others are decided."""
        rows = []
        for (shard, part, window), held in split.items():
            least = min(held)[0]
            rows += [(shard, part, d, s, window) if d == least else (0, d % DECIDED, d, s, None) for d, s in held]
        split.clear()
        return rows

    held = 0
    for batch in batches:
        rows = []
        for doc, text, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            for want in wants:
                start, n, parts = want["at"] >> 4, want["at"] & 15, want["parts"]
                if parts == 1:
                    rows.append((want["shard"], 0, doc, start, b" ".join(words[start : start + n + WINDOW - 1])))
                else:
                    for s in range(start, start + n):
                        window = b" ".join(words[s : s + WINDOW])
                        split.setdefault((want["shard"], xxhash.xxh3_64_intdigest(window) % parts, window), []).append((doc, s))
                    held += n
            if held >= GATHERED:
                rows, held = rows + earliest(), 0
        yield from sent(rows)
    yield from sent(earliest())


def _covered(lengths: list[int]) -> list[tuple[int, int]]:
    """Runs (first window, windows) of windows whose last word ends a match of WINDOW words."""
    out: list[list[int]] = []
    for i, n in enumerate(lengths):
        if n >= WINDOW:
            s = i - WINDOW + 1
            if out and out[-1][0] + out[-1][1] == s:
                out[-1][1] += 1
            else:
                out.append([s, 1])
    return [(a, b) for a, b in out]


COVERED = "doc_id long, at long"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, part and document: each document's segments against those of earlier ones."""
    key, doc, waiting = None, None, []
    automaton, known = SuffixAutomaton(), set()
    docs, ats = [], []
    for batch in batches:
        for shard, part, d, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words is None:
                docs.append(d)
                ats.append(start * 16 + 1)
                continue
            if (shard, part) != key:
                key, doc, waiting = (shard, part), d, []
                automaton, known = SuffixAutomaton(), set()
            elif d != doc:
                for x in waiting:
                    if x not in known:
                        known.add(x)
                        automaton.add(x.split(" "))
                doc, waiting = d, []
            if known:
                w = words.split(" ")
                runs = [(0, len(w) - WINDOW + 1)] if words in known else _covered(automaton.matching(w))
                for s, n in runs:
                    docs.append(d)
                    ats.append((start + s) * 16 + n)
            waiting.append(words)
        if len(docs) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int64())], names=["doc_id", "at"])
            docs, ats = [], []
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int64())], names=["doc_id", "at"])


def _only(docs: DataFrame, ids: DataFrame, max_ids: int) -> DataFrame:
    """The rows of `docs` whose doc_id is in `ids`, without moving texts if there are few enough ids."""
    some, _ = checked_broadcast(ids, max_ids)
    return docs.join(some, "doc_id", "left_semi")


def repeated_spans(docs: DataFrame, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, spans): windows to remove, each as 16 * first word + number of windows; a stored table."""
    spark = docs.sparkSession
    size = table_bytes(docs)  # of a table that is not read from files it is not known, and beyond all bounds
    buckets = max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, size // BUCKET_BYTES) if size < 1 << 60 else 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    sent = texts.mapInArrow(tidy(_packer(buckets)), PACKED).repartition("bucket").sortWithinPartitions("bucket")
    scratch = Scratch()
    found = scratch.stored(sent.mapInArrow(tidy(_meet), FOUND), "found")

    wanted = found.filter("shard != 0")
    hot = scratch.stored(wanted.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD), "hot")
    hot, _ = checked_broadcast(hot, 1_000_000)
    parts = F.coalesce(F.ceil(F.col("n") / SHARD), F.lit(1)).cast("int")
    wants = wanted.join(hot, "shard", "left").groupBy("doc_id").agg(F.collect_list(F.struct("shard", "at", parts.alias("parts"))).alias("wants"))
    wants = scratch.stored(wants, "wanted")
    pieces = _only(texts, wants.select("doc_id"), max_broadcast_ids).join(wants, "doc_id").select("doc_id", "text", "wants").mapInArrow(tidy(_fetch), PIECES)
    streamed = pieces.repartition("shard", "part").sortWithinPartitions("shard", "part", "doc_id").mapInArrow(tidy(_stream), COVERED)
    spans = found.filter("shard = 0").select("doc_id", "at").unionByName(streamed)
    out = stored(spans.groupBy("doc_id").agg(F.collect_list("at").alias("spans")), "spans")
    scratch.clear()
    return out


def _cut(text: str, spans: list[int]) -> tuple[int, int, str]:
    """(words, words removed, what is left with its own blanks)."""
    pieces = PIECE.findall(text.encode("utf-8", "surrogatepass"))
    edge = np.zeros(len(pieces) + 1, dtype=np.int64)
    for s in spans:
        first = min(s >> 4, len(pieces))
        edge[first] += 1
        edge[min(first + (s & 15) + WINDOW - 1, len(pieces))] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    left = b"".join([p for p, g in zip(pieces, gone.tolist(), strict=True) if not g])
    return len(pieces), int(gone.sum()), left.decode("utf-8", "surrogatepass")


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column passes through; text and spans become n_words, n_removed and kept_text."""
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            done = [_cut(t or "", s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            n, gone, left = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["row", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """row (all columns of `docs`, without text), n_words, n_removed, kept_text for each row of `docs`."""
    spans = repeated_spans(docs, max_broadcast_ids)
    ids, small = checked_broadcast(spans.select("doc_id"), max_broadcast_ids)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if small:
        same = rows.join(ids, "doc_id", "left_anti")
        cut = rows.join(ids, "doc_id", "left_semi").join(spans, "doc_id")
    else:
        both = rows.join(spans, "doc_id", "left")
        same, cut = both.filter("spans is null").drop("spans"), both.filter("spans is not null")
    kind = rows.schema["row"].dataType.simpleString()
    cut = cut.select("row", "text", "spans").mapInArrow(tidy(_cutter), f"row {kind}, n_words long, n_removed long, kept_text string")
    same = same.select("row", F.size(split_words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"))
    return cut.unionByName(same)


def match_reference(docs: DataFrame, shards: list[list[str]], max_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text after spans of any reference shard are removed.

    shards: lists of reference texts; each list has at most `max_words` words, which bounds what
    is broadcast. Every document is streamed past every automaton.
    """
    for texts in shards:
        if (n := sum(len(t.split()) for t in texts)) > max_words:
            raise ValueError(f"a shard has {n} words; at most {max_words} are broadcast")
    spark = docs.sparkSession
    shared = []
    for texts in shards:
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t.encode("utf-8", "surrogatepass").split())
        shared.append(spark.sparkContext.broadcast((automaton.step, automaton.back, automaton.size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for b in shared:
            a = SuffixAutomaton()
            a.step, a.back, a.size = b.value
            automata.append(a)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = [16 * s + 1 for a in automata for first, n in _covered(a.matching(words)) for s in range(first, first + n)]
                out.append(_cut(text or "", runs))
            n, gone, left = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_text string")


def remove_from(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut out of text (n_chars follows, if there); emptied documents go."""
    cut = remove_repeats(docs).filter("not (n_words > 0 and n_removed = n_words)")
    changed = F.col("n_removed") > 0
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("kept_text").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return cut.select(*out)
