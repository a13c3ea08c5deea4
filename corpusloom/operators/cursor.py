"""Pages of a scored scan by cursor: a page reads the parts that it lies in, whatever its number.

The scan is frozen: written once, in ranges of falling score and rising key, with a small table of the
ranges' ends. Rows that are appended to the source later change no page. A cursor is the score and
key of the last row that was given.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.window import Window

#: Missing scores come last.
LAST = float("-inf")


@dataclass(frozen=True)
class Frozen:
    rows: DataFrame
    #: (part, rows, score and key of its last row), in order; one row for each range.
    parts: tuple[tuple[int, int, float, int], ...]
    key: str
    score: str

    @property
    def total(self) -> int:
        return sum(n for _, n, _, _ in self.parts)


def freeze(scores: DataFrame, path: str, key: str = "doc_id", score: str = "score") -> Frozen:
    """`scores` (key: a number that is not null and occurs once, score, ...) as it is now, below `path`."""
    order = [F.coalesce(F.col(score).cast("double"), F.lit(LAST)).desc(), F.col(key).asc()]
    rows = scores.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    rows.write.partitionBy("_part").parquet(f"{path}/rows")
    scores.sparkSession.createDataFrame([], scores.schema).write.parquet(f"{path}/schema")
    return thaw(scores.sparkSession, path, key, score)


def thaw(spark: SparkSession, path: str, key: str = "doc_id", score: str = "score") -> Frozen:
    """A scan that was frozen before."""
    inside = spark.read.parquet(f"{path}/schema").schema
    rows = spark.read.schema(StructType([*inside.fields]).add("_part", IntegerType())).parquet(f"{path}/rows")
    at = F.coalesce(F.col(score).cast("double"), F.lit(LAST))
    ends = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-at).alias("s"), F.col(key).alias("k"))).alias("end"))
    parts = tuple((r["_part"], r["n"], -r["end"]["s"], r["end"]["k"]) for r in ends.orderBy("_part").collect())
    return Frozen(rows, parts, key, score)


def page_after(frozen: Frozen, cursor: tuple[float, int] | None = None, size: int = 30) -> DataFrame:
    """The next `size` rows behind the cursor (None: the first); of the ranges only those that can hold them are read."""
    at = F.coalesce(F.col(frozen.score).cast("double"), F.lit(LAST))
    order = [at.desc(), F.col(frozen.key).asc()]
    behind = (lambda s, k: True) if cursor is None else (lambda s, k: (-s, k) > (-cursor[0], cursor[1]))
    wanted, whole = [], 0
    for part, n, last_score, last_key in frozen.parts:
        if behind(last_score, last_key) and whole < size:
            whole += n if wanted or cursor is None else 0  # of the first range some rows may lie before the cursor
            wanted.append(part)
    rows = frozen.rows.filter(F.col("_part").isin(wanted))
    if cursor is not None:
        score, key = F.lit(float(cursor[0])), F.lit(cursor[1])
        rows = rows.filter((at < score) | ((at == score) & (F.col(frozen.key) > key)))
    return rows.orderBy(*order).limit(size).drop("_part")


def all_pages(frozen: Frozen, size: int = 30) -> DataFrame:
    """Every row with `page`, the number, from 0, of the page on which who goes from cursor to cursor meets it.

    A row's place is its place in its range, of which each is one task's, behind the rows of the ranges before.
    """
    spark = frozen.rows.sparkSession
    before = [0, *itertools.accumulate(n for _, n, _, _ in frozen.parts)]
    starts = spark.createDataFrame([(p[0], b) for p, b in zip(frozen.parts, before, strict=False)], "_part int, _before long")
    at = F.coalesce(F.col(frozen.score).cast("double"), F.lit(LAST))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(at.desc(), F.col(frozen.key).asc())) - 1
    rows = frozen.rows.withColumn("_place", place).join(F.broadcast(starts), "_part")  # one row for each range
    return rows.withColumn("page", F.floor((F.col("_before") + F.col("_place")) / size).cast("int")).drop("_part", "_place", "_before")


def cursor_of(frozen: Frozen, rows: list) -> tuple[float, int] | None:
    """The cursor behind a page's collected rows; None where there are none."""
    if not rows:
        return None
    last = rows[-1]
    return (LAST if last[frozen.score] is None else float(last[frozen.score]), last[frozen.key])
