"""Named Parquet tables below one folder (`<root>/<name>.parquet`, a file or a folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name`; any path that Spark's readers open, so remote stores work too."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` by hash of their key where their files give fewer tasks than there are cores.

    For work that costs more than moving a row does. A large table has tasks enough and stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows._jdf.toJavaRDD().getNumPartitions() < cores else rows
