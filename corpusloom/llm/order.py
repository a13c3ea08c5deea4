"""Training-order materialisation: a keyed permutation of all sequences, written as fixed-stride shards.

A document's ids and END are cut into sequences of LENGTH, the last filled up with END. Sequences
are numbered in reading order: one pass counts those of each partition, the second numbers them.
A Feistel network over the next even power of two, walked in cycles until it stays below their
number, gives each its slot; whoever has the key can compute either way for any sequence.
Slots are dealt by range, computed from the counted total, so nothing is sampled: a task takes the
next shards in order, and shard s holds the slots from s * per_shard on, one file a shard, one
record a slot in slot order, all of one size. A reader seeks to any slot and reads on from there.
Shards grow with the total, from 4096 slots up to 65,536, so their number stays manageable.

Records: sequence, document and start as signed 64-bit, the number of ids that are not filling as
unsigned 32-bit, LENGTH ids as unsigned 16-bit, a closing line feed; all little-endian. Files are
written by Spark's text writer, so commits are atomic and any Hadoop file system will do.

Only the number of sequences and a digest of each partition's rows, in order, come to the driver. A
partition that gives other rows, or the same in another order, in the second pass than in the first
fails the job rather than write wrong slots; write an input that is not read from files first.
Which sequence has which number depends on how the table's files are cut into partitions; the
permutation of the numbers does not.

Cases: null text is empty and gives one sequence of END; null doc_id comes back as null; rows are
cut one by one, so repeated rows repeat; an empty table writes no shard. A text of any length is
cut in its row, runs of blanks of any length too. Other columns are not read. Tokenizers with
more than 65,536 ids are refused.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, tidy
from corpusloom.llm.lengths import rank_encoder
from corpusloom.llm.rank_ids import blank_runs, rank_ids
from corpusloom.llm.wordstream import mix

HEAD = "<qqqI"
HEAD_SIZE = struct.calcsize(HEAD)
NO_ID = -(1 << 63)
ROUNDS = 6


@dataclass(frozen=True)
class Layout:
    """per_shard: slots of a shard; by default a power of two that follows from the total."""

    key: int = 20_240_601
    length: int = 512
    per_shard: int | None = None
    end: int = 50256

    def shard_slots(self, total: int) -> int:
        return self.per_shard or min(1 << 16, max(1 << 12, 1 << (total // 10_000).bit_length()))

    @property
    def stride(self) -> int:
        return HEAD_SIZE + 2 * self.length + 1


def _bits(n: int) -> int:
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        tweak = mix(np.atleast_1d(np.uint64((key * 64 + r) & (1 << 64) - 1)))
        if back:
            left, right = right ^ (mix(left ^ tweak) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ tweak) & mask)
    return (left << h) | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Each of 0, ..., n - 1 to its slot, or back."""
    half = _bits(n)
    out = _rounds(x.astype(np.uint64), half, key, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _rounds(out[far], half, key, back)
    return out.astype(np.int64)


class _Digest:
    """A digest of rows (doc_id, text) in order."""

    def __init__(self) -> None:
        self.held = xxhash.xxh3_64()

    def add(self, doc: int | None, text: str | None) -> bytes:
        """Takes a row in; returns the text's own digest."""
        own = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
        self.held.update(struct.pack("<q", NO_ID if doc is None else doc) + own)
        return own

    def value(self) -> int:
        return self.held.intdigest() - (1 << 63)


#: Bytes of records that a task writes, while tasks number fewer than MOST_TASKS.
TASK_BYTES = 1 << 26
MOST_TASKS = 20_000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, bool]]:
    """doc_id, text, whether it holds two blanks in a row."""
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blank_runs(part.column(1)), strict=True)


def write_order(docs: DataFrame, path: str, tokenizer: tuple[str, str], layout: Layout = Layout()) -> int:
    """Write the shards of all sequences of `docs` below `path`; returns the number of sequences."""
    if (ids := max(rank_encoder(*tokenizer).max_token_value, layout.end)) >= 1 << 16:
        raise ValueError(f"records hold ids of 16 bits; the tokenizer has {ids}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    length, end, key = layout.length, layout.end, layout.key

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, n, digest = rank_ids(*tokenizer).ids, {}, 0, _Digest()
        for doc, text, runs in _rows(batches):
            own = digest.add(doc, text)
            if own not in known:  # copies are counted once; so many digests are kept
                if len(known) >= 100_000:
                    known.clear()
                known[own] = len(encode(text or "", runs)) // length + 1
            n += known[own]
        cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([digest.value()], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "n", "digest"])

    with small_batches(spark):
        counts = {r["part"]: (r["n"], r["digest"]) for r in rows.mapInArrow(tidy(count), "part int, n long, digest long").collect()}
    total, first = 0, {}
    for part in sorted(counts):
        first[part], total = total, total + counts[part][0]
    per_shard = layout.shard_slots(total)
    shards = max(1, -(-total // per_shard))
    tasks = min(MOST_TASKS, shards, max(1, -(-total * layout.stride // TASK_BYTES)))
    shared = spark.sparkContext.broadcast((first, counts))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, (n_counted, known) = shared.value[0][part], shared.value[1][part]
        stop, digest, encode = at + n_counted, _Digest(), rank_ids(*tokenizer).ids
        out: list[bytes] = []
        filling = np.full(length, end, dtype="<u2").tobytes()

        def done() -> pa.RecordBatch:
            slots = permute(np.arange(at - len(out), at), total, key)
            shard = slots // per_shard
            return pa.RecordBatch.from_arrays([pa.array((shard * tasks // shards).astype(np.int32)), pa.array(shard), pa.array(slots), pa.array(out, pa.binary())], names=["task", "shard", "slot", "record"])

        for doc, text, runs in _rows(batches):
            digest.add(doc, text)
            ids = encode(text or "", runs)
            n = len(ids) + 1
            raw = ids.astype("<u2").tobytes() + filling[2 * (len(ids) % length) :]
            for s in range(0, n, length):
                out.append(struct.pack(HEAD, at, NO_ID if doc is None else doc, s, min(length, n - s)) + raw[2 * s : 2 * (s + length)])
                at += 1
            if len(out) >= 2000:
                yield done()
                out = []
        if at != stop or digest.value() != known:
            raise RuntimeError(f"partition {part} gave other rows than when it was counted")
        if out:
            yield done()

    made = rows.mapInArrow(tidy(records), "task int, shard long, slot long, record binary").repartitionById(tasks, "task").sortWithinPartitions("shard", "slot")
    with small_batches(spark):
        made.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/shards")
    about = asdict(layout) | {"per_shard": per_shard, "sequences": total, "stride": layout.stride}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return total


def read_order(spark: SparkSession, path: str, from_slot: int = 0, digest: bool = False) -> DataFrame:
    """slot, shard, offset (bytes into the shard's file), sequence_id, doc_id, start, n_tokens, tokens (binary), from a slot on.

    With `digest`, tokens_crc32 in place of tokens. Shards before the slot's are not opened.
    """
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    layout = Layout(**{k: about[k] for k in ("key", "length", "per_shard", "end")})
    stride, per_shard = layout.stride, layout.per_shard
    schema = "slot long, shard long, offset long, sequence_id long, doc_id long, start long, n_tokens long, " + ("tokens_crc32 long" if digest else "tokens binary")
    if not about["sequences"]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{path}/shards").select(F.col("shard").cast("long").alias("shard"), "content")
    files = files.filter(F.col("shard") >= from_slot // per_shard)

    record = np.dtype([("sequence", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<u4"), ("ids", "u1", 2 * layout.length), ("close", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                whole = np.frombuffer(data, dtype=record)
                first = max(0, from_slot - shard * per_shard)
                for k in range(first, len(whole), 2000):
                    some = whole[k : k + 2000]
                    base = np.arange(k, k + len(some))
                    tokens = [t[: 2 * m] for t, m in zip(some["ids"], some["n"].tolist(), strict=True)]
                    told = pa.array([zlib.crc32(t) for t in tokens], pa.int64()) if digest else pa.array([t.tobytes() for t in tokens], pa.binary())
                    cols = [base + shard * per_shard, np.full(len(base), shard), base * stride, some["sequence"], pa.array(some["doc"], mask=some["doc"] == NO_ID), some["start"], some["n"].astype(np.int64)]
                    arrays = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in cols]
                    yield pa.RecordBatch.from_arrays([*arrays, told], names=[c.split()[0] for c in schema.split(", ")])

    return files.mapInArrow(tidy(run), schema)
