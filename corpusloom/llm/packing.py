"""Packing by power-of-two decomposition.

A document's ids (its tokens, then END) are cut into pieces of LENGTH and then into one piece for
each binary digit of what is left, longest first. A piece is a sequence of its own whose length is
a power of two, so no sequence crosses documents and none is padded. Pieces of equal length form
a bucket; batches are drawn within one.

Documents are handled one by one where they are read: nothing is shuffled.

Cases: null text is empty and gives the single piece of END; rows are packed one by one, so
repeated rows and ids, and rows with null doc_id, give pieces of their own; empty tables work. A
text of any length is packed in its row; other columns are not read. Sequence ids are unique, but
which piece has which depends on how the table's files are cut into partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import tidy
from corpusloom.llm.encoder import encoder, public_path

LENGTH = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; `length` is a power of two."""
    out = [(s, length) for s in range(0, n - length + 1, length)]
    at = n - n % length
    for k in range(length.bit_length() - 2, -1, -1):
        if n & 1 << k:
            out.append((at, 1 << k))
            at += 1 << k
    return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    tokenizer: the path of a tokenizer file, the same on all executors.
    """
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for k in range(0, len(batch), 2500):
                part = batch.slice(k, 2500)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    rows += [(doc, s, m, ids[4 * s : 4 * (s + m)], n) for s, m in pieces(n, length)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), PIECES)
    return out.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a CRC in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def with_digests(packed: DataFrame) -> DataFrame:
    """The pieces with their ids and the CRC of these."""
    return packed.withColumn("ids_crc32", F.crc32("ids"))


def production_tokenizer() -> str:
    return public_path(TOKENIZER)


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
