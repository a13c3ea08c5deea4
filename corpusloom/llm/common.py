"""Pieces that several operators share: shared storage, checked broadcasts, in-row bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let, positions
from corpusloom.sources import staging
from corpusloom.sources.staging import discard, run_folder, table_bytes

__all__ = ["discard", "let", "positions", "run_folder", "table_bytes"]

#: Rows that go to a Python worker at once while a table is stored: whole texts make them large.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(run: Callable) -> Callable:
    """`run` over Arrow batches, giving memory back when a task ends: idle workers would keep it."""

    def wrapped(batches):
        import ctypes

        import pyarrow

        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError, TypeError):
                pass  # another C library keeps its own ways

    return wrapped


def batch_by_text(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For jobs whose last plan hands whole texts to Python workers: at most so many at once from now on."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside hand Python workers at most BATCH_ROWS rows at once."""
    was = spark.conf.get(_BATCH)
    if 0 < int(was) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends at the files."""
    with small_batches(df.sparkSession):
        return staging.stored(df, name)


class Scratch:
    """Stored tables that only an operator's own steps read: `clear` them once its last step is stored."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        while self.tables:
            discard(self.tables.pop())


#: Bytes of a table's files beyond which it is not broadcast, whatever its rows.
MOST_BYTES = 128 << 20


def checked_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint if it has at most `max_rows` rows, by a count, and MOST_BYTES bytes, and whether it has one.

    Give a `stored` table: the count then reads only file footers.
    """
    small = table_bytes(df) <= MOST_BYTES and df.count() <= max_rows
    return (F.broadcast(df) if small else df), small


#: Bytes that separate words, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]"


def split_words(text: Column) -> Column:
    """Maximal runs of `[^\\x20\\x09-\\x0D]`; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), lambda w: w != "")
