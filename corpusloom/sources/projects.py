"""Projects over one or more corpora: collecting, keyed side tables, deletion, files for later steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.plans import boolean
from corpusloom.sources.records import upserted

SHARED_QUERY = boolean.EVERYTHING


def collected(sources: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all sources with their name in `source`, and what went wrong with the others."""
    frames, wrong = [], {}
    for name, read in sources.items():
        try:
            frames.append(read().withColumn("source", F.lit(name)))
        except Exception as e:  # a source that fails leaves the others alone
            wrong[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), wrong


def project_documents(corpora: Mapping[str, Callable[[], DataFrame]], query: str, **kw) -> tuple[DataFrame | None, dict[str, str]]:
    """Scored hits of every source; a null text is no document."""
    return collected({name: (lambda read=read: search.scored(read(), query, **kw)) for name, read in corpora.items()})


def save_project(hits: DataFrame, project: int, documents: str, scores: str) -> None:
    """Append documents and their scores by project and document, so several sources add up."""
    rows = hits.withColumn("project_id", F.lit(project))
    rows.drop("score").write.mode("append").partitionBy("project_id").parquet(documents)
    rows.select("project_id", "doc_id", "score").write.mode("append").partitionBy("project_id").parquet(scores)


def side_table(spark: SparkSession, path: str, schema: str, project: int | None = None) -> DataFrame:
    """A keyed side table, of one project if wanted; empty if it is not there."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows if project is None else rows.filter(F.col("project_id") == project)


def cleaned_corpus(docs: DataFrame, prepared: str = "prepared") -> DataFrame:
    """Documents with something left after cleaning."""
    return docs.filter(F.coalesce(F.col(prepared), F.lit("")) != "")


def new_inputs(records: DataFrame, done: DataFrame, key: str = "record_key") -> DataFrame:
    """Keyed records that have no input file yet."""
    return records.filter(F.coalesce(F.col(key), F.lit("")) != "").join(done.select(key), key, "left_anti")


def merged_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Many JSON files as one table; write it with `coalesce(1)` for a single file."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def load(records: DataFrame, target: str, key: str = "record_key") -> int:
    """Write records below `target` by key, the last of each, and return how many it then has.

    Whole states are written side by side (`state=1`, `state=2`, ...) and a state counts once it is
    complete, so a job that is lost on the way leaves the state before; older ones are then deleted.
    """
    spark = records.sparkSession
    number, old = current_state(spark, target)
    upserted(records.limit(0) if old is None else old, records, key).write.mode("overwrite").parquet(f"{target.rstrip('/')}/state={number + 1}")
    folder, files = _folder(spark, target)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("state=") and int(name[6:]) <= number:
            files.delete(status.getPath(), True)
    return current_state(spark, target)[1].count()


def _folder(spark: SparkSession, target: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def current_state(spark: SparkSession, target: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the latest complete state of a loaded table; 0 and none if there is none."""
    folder, files = _folder(spark, target)
    done = [0]
    if files.exists(folder):
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("state=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(name[6:]))
    return max(done), spark.read.parquet(f"{target.rstrip('/')}/state={max(done)}") if max(done) else None


def whole_project(corpora: Mapping[str, Callable[[], DataFrame]], project: int, documents: str, scores: str, query: str = SHARED_QUERY, since: date = date(2000, 1, 1), until: date | None = None, day: str = "decision_date") -> dict[str, str]:
    """A project of all documents of a range of days (from 2000 to today by default), or of a query's; returns what went wrong by source."""
    hits, wrong = project_documents(corpora, query, begin=since, end=until or date.today(), day=day)
    if hits is not None:
        save_project(hits, project, documents, scores)
    return wrong


def deleted(tables: Mapping[str, DataFrame], project: int, shared: tuple[int, ...] = ()) -> dict[str, DataFrame]:
    """Every table without a project's rows; a shared project stays."""
    from corpusloom.operators.selection import without_project

    return {name: without_project(t, project, shared) for name, t in tables.items()}


def without_finished(tables: Mapping[str, DataFrame], projects: DataFrame, shared: tuple[int, ...] = (), status: str = "completed") -> dict[str, DataFrame]:
    """Every table without the rows of projects (project_id, status) that are finished; shared ones stay."""
    gone = projects.filter((F.col("status") == status) & ~F.col("project_id").isin(*shared)).select("project_id")
    return {name: t.join(gone, "project_id", "left_anti") for name, t in tables.items()}


def estimated_new(corpora: Mapping[str, DataFrame], query: str, since, until, day: str) -> DataFrame:
    """Hits of all sources in a range of days."""
    counts = [search.count_matching(c, query, begin=since, end=until, day=day) for c in corpora.values()]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))
