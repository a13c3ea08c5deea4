"""A stated query set against all rows, in blocks whose size is checked before they are broadcast."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 20_000


def against_all(queries: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """`run` of the broadcast queries; of more than `most` rows, block by block of a hash of their key."""
    n = queries.count()
    blocks = max(1, -(-n // (most // 2))) if n > most else 1
    if blocks == 1:
        return run(F.broadcast(queries))
    part = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [run(F.broadcast(queries.filter(part == i))) for i in range(blocks)])
