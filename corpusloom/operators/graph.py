"""Connected components of a table of links, without a driver's or a task's view of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.staging import discard, if_small, stored

#: Where labels that move are too many to be broadcast, each is joined in so many parts.
SALTS = 32


def _renamed(rows: DataFrame, column: str, by: str, names: DataFrame) -> DataFrame:
    """`rows` with `column` replaced by its name (via, far), where it has one.

    Rows that keep theirs, however many, meet nothing if the names are few enough to be broadcast; else
    a value that many rows carry is split by `by`, an expression that tells these rows apart.
    """
    near = if_small(names)
    on = F.col(column) == F.col("via")
    if near is names:
        near = names.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        on = on & (F.pmod(F.xxhash64(by), F.lit(SALTS)) == F.col("part"))
    return rows.join(near, on, "left").withColumn(column, F.coalesce("far", column)).select(*rows.columns)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in `links` (a, b): label is the least id of its component; a stored table.

    In each round each id that has a lesser neighbour takes the least one, the trees that this makes are
    followed to their roots, by halves, and links are drawn between roots: those inside one tree go. So
    links are met once or twice, not in every round. Least neighbours combine before the shuffle, so a
    hub is no hot spot. Each step is written and read again.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    live = edges.filter("a != b")
    while live.take(1):
        up = stored(live.groupBy("b").agg(F.min("a").alias("far")).withColumnRenamed("b", "via"), "up")
        while True:
            new = stored(_renamed(up.select(F.col("via").alias("own"), F.col("far").alias("to"), F.col("far").alias("was")), "to", "own", up), "up")
            changed = new.filter("to != was").take(1)
            discard(up)
            up = new.select(F.col("own").alias("via"), F.col("to").alias("far"))
            if not changed:
                break
        before, labels = labels, stored(_renamed(labels, "label", "id", up), "labels")
        discard(before)
        drawn = _renamed(_renamed(live, "a", "b", up), "b", "a", up).filter("a != b")
        new = stored(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(edges)
        discard(up)
        edges = live = new
    discard(edges)
    return labels
