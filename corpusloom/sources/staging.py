"""Tables between the steps of a job: written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` as the session has it.

    Unset, it becomes a temporary folder, but only where one process does all the work.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


_RUNS: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """A folder for this application's own tables below the shared one; it is deleted when Python ends."""
    path = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _delete(jvm, settings, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(settings).delete(p, True)
    except (Py4JError, OSError):
        pass  # the JVM has ended already


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends at the files."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a `stored` table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def table_bytes(df: DataFrame) -> int:
    """What the optimizer takes a table to hold in memory, from its files and the columns that are read.

    Files are compressed, so a broadcast may be some times as large.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """`df` with a broadcast hint if its rows, counted, and its bytes are within the bounds.

    Give a `stored` table: the count then reads only file footers.
    """
    return F.broadcast(df) if table_bytes(df) <= max_bytes and df.count() <= max_rows else df
