"""Token counts by an exact length histogram.

Each text is encoded once, where it is read; what leaves the task is a count for each length. From
the histogram, suffix sums answer for every context limit how many documents are longer, how many
tokens all hold up to the limit, and where quantiles lie. Sums run over blocks of lengths first
and within blocks after, so no task needs the whole histogram in order.

Cases: null text is empty and has length 0; rows are counted one by one, so repeated rows count
as often as they are there; an empty table gives an empty histogram. A text of any length is
encoded whole; other columns, but for those grouped by, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import checked_broadcast, stored, tidy

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Lengths that are summed together first.
BLOCK = 256

_LOADED: dict[tuple[str, str], object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_encoder(path: str, pattern: str):
    """An encoder from a file of ranks; `pattern` cuts texts into words."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _LOADED[path, pattern]


def production_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def length_histogram(docs: DataFrame, tokenizer: tuple[str, str], group: Sequence[str] = ()) -> DataFrame:
    """(group columns, length, n_docs)."""
    path, pattern = tokenizer
    kept = [F.col(f"`{g}`") for g in group]
    rows = docs.select(*[c.alias(f"g{i}") for i, c in enumerate(kept)], F.col("text").cast("string").alias("text"))
    at = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n, pa.int64())], names=[*batch.schema.names[:at], "length"])

    schema = ", ".join([*[f"g{i} {rows.schema[f'g{i}'].dataType.simpleString()}" for i in range(at)], "length long"])
    counted = rows.mapInArrow(tidy(run), schema).groupBy(*[f"g{i}" for i in range(at)], "length").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(group)], "length", "n_docs")


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit, by sums over all documents.

    length, n_docs, docs_longer, docs_fitting, tokens_total, tokens_fitting (of documents that
    fit), tokens_truncated (all documents cut to the limit), quantile (part of documents that fit).
    """
    h = stored(histogram.groupBy("length").agg(F.sum("n_docs").alias("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)), "histogram")
    tokens = F.col("n_docs") * F.col("length")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("docs_after")
    above = F.coalesce(F.sum(tokens).over(within), F.lit(0)) + F.col("tokens_after")
    blocks, _ = checked_broadcast(stored(blocks, "blocks"), 1_000_000)
    s = h.join(blocks, F.col("block") == F.col("b")).withColumns({"docs_longer": longer, "above": above})
    return s.select(
        "length",
        "n_docs",
        "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_fitting"),
        F.col("all_tokens").alias("tokens_total"),
        (F.col("all_tokens") - F.col("above")).alias("tokens_fitting"),
        (F.col("all_tokens") - F.col("above") + F.col("docs_longer") * F.col("length")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def length_quantile(limits: DataFrame, part: float) -> DataFrame:
    """length: the least limit that at least `part` of the documents fit."""
    return limits.filter(F.col("quantile") >= part).agg(F.min("length").alias("length"))
