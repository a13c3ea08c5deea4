"""Selections with three states (yes, no, maybe) and their versions, which form a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.joins import nearest_points

LIMIT_REFINEMENTS = LIMIT_ITERATIONS = 15
STATE = ["doc_id", "to_display", "is_initial", "is_check"]


def marked(choice: DataFrame, yes: list[int] = (), no: list[int] = (), maybe: list[int] = ()) -> DataFrame:
    """yes, then no, then maybe (null) by document."""
    c = F.when(F.col("doc_id").isin(*yes), F.lit(True)) if yes else F.when(F.lit(False), F.lit(True))
    if no:
        c = c.when(F.col("doc_id").isin(*no), F.lit(False))
    if maybe:
        c = c.when(F.col("doc_id").isin(*maybe), F.lit(None).cast("boolean"))
    return choice.withColumn("is_check", c.otherwise(F.col("is_check")))


def all_marked(choice: DataFrame, state: bool | None) -> DataFrame:
    return choice.withColumn("is_check", F.lit(state).cast("boolean"))


def unchecked_hidden(choice: DataFrame) -> DataFrame:
    return choice.withColumn("to_display", F.col("to_display") & F.coalesce(F.col("is_check"), F.lit(True)))


def snapshot(choice: DataFrame) -> DataFrame:
    """(doc_id, state, is_initial, to_display) with state `yes`, `no` or `maybe`: an iteration's rows.

    Kept by iteration as rows, not as arrays, so a selection of any size is never one row.
    """
    state = F.when(F.col("is_check"), "yes").when(~F.col("is_check"), "no").otherwise("maybe")
    return choice.select("doc_id", state.alias("state"), "is_initial", "to_display")


def snapshot_counts(snap: DataFrame) -> DataFrame:
    """One row: documents in each state, initial ones, and those shown."""
    return snap.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("yes", "no", "maybe")], F.count_if("is_initial").alias("initial"), F.count_if("to_display").alias("shown"))


def restored(snap: DataFrame) -> DataFrame:
    """The selection that a snapshot holds: what was marked no is hidden."""
    s = F.col("state")
    return snap.select("doc_id", (s != "no").alias("to_display"), "is_initial", F.when(s == "yes", True).when(s == "no", False).alias("is_check"))


def iterated(choice: DataFrame, points: DataFrame, excluded: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The next selection and its excluded ids: documents marked no are hidden and excluded, and
    neighbours of those marked yes join unless excluded or there already."""
    hidden = unchecked_hidden(choice)
    gone = excluded.select("doc_id").union(choice.filter(~F.col("is_check")).select("doc_id")).distinct()
    yes = choice.filter("is_check").select("doc_id")
    near = nearest_points(points, yes, k).select(F.col("neighbour").alias("doc_id")).distinct()
    fresh = near.join(gone, "doc_id", "left_anti").join(choice.select("doc_id"), "doc_id", "left_anti")
    added = fresh.select("doc_id", F.lit(True).alias("to_display"), F.lit(False).alias("is_initial"), F.lit(None).cast("boolean").alias("is_check"))
    return hidden.select(*STATE).unionByName(added), gone


def next_iteration(iterations: DataFrame, refinement: int, choice: DataFrame, points: DataFrame, excluded: DataFrame, parent: int | None = None, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One more iteration of a refinement: (iterations, its selection, its excluded ids).

    iterations: (refinement_id, id, parent). What came after the parent (the last one if none is
    given) goes; the new iteration gets the next id. `excluded` are the parent's.
    """
    own = iterations.filter(F.col("refinement_id") == refinement)
    last = own.agg(F.max("id")).first()[0]
    if last is None:
        raise ValueError(f"refinement {refinement} has no iteration")
    parent = last if parent is None else parent
    kept = pruned_after(iterations, refinement, parent)
    refuse_more(kept.filter(F.col("refinement_id") == refinement), LIMIT_ITERATIONS, "iterations")
    rows, gone = iterated(choice, points, excluded, k)
    top = iterations.agg(F.max("id")).first()[0]
    added = iterations.sparkSession.createDataFrame([(refinement, top + 1, parent)], iterations.select("refinement_id", "id", "parent").schema)
    return kept.select("refinement_id", "id", "parent").unionByName(added), rows, gone


def next_refinement(refinements: DataFrame, project: int, filters: str, origin: int | None = None) -> DataFrame:
    """Refinements (project_id, id, filters, origin) and a new one of a project, unless it has LIMIT_REFINEMENTS of them."""
    refuse_more(refinements.filter(F.col("project_id") == project), LIMIT_REFINEMENTS, "refinements")
    top = refinements.agg(F.max("id")).first()[0] or 0
    rows = refinements.select("project_id", "id", "filters", "origin")
    return rows.unionByName(refinements.sparkSession.createDataFrame([(project, top + 1, filters, origin)], rows.schema))


def refuse_more(rows: DataFrame, most: int, what: str) -> None:
    """An error once there are as many rows as may be."""
    if rows.limit(most).count() >= most:
        raise ValueError(f"there are {most} {what} already")


def pruned_after(iterations: DataFrame, refinement: int, keep: int) -> DataFrame:
    """Iterations without those from the refinement's last one up its parents to `keep`, which stays.

    As in a walk from the last one: if `keep` is not among its parents, all of them but the root go.
    """
    own = iterations.filter(F.col("refinement_id") == refinement)
    last = own.agg(F.max("id")).first()[0]
    if last is None:
        return iterations
    chain = lineage(own, last).join(own.select("id", "parent"), "id")
    at = chain.filter(F.col("id") == keep).select(F.min("depth").alias("upto"))
    gone = chain.crossJoin(F.broadcast(at)).filter((F.col("depth") < F.coalesce("upto", F.lit(2**31 - 1))) & F.col("parent").isNotNull())
    return iterations.join(gone.select("id"), "id", "left_anti")


def without_iteration(iterations: DataFrame, refinement: int, gone: int) -> tuple[DataFrame, int | None]:
    """Iterations without one, and the id of its parent; an unknown one and a root stay (None)."""
    found = iterations.filter((F.col("refinement_id") == refinement) & (F.col("id") == gone)).first()
    if found is None or found["parent"] is None:
        return iterations, None
    return iterations.filter(F.col("id") != gone), found["parent"]


def reset(iterations: DataFrame, refinement: int) -> tuple[DataFrame, int | None]:
    """Iterations after a walk from the refinement's last one to its root, and the root; what is passed goes."""
    own = iterations.filter(F.col("refinement_id") == refinement)
    last = own.agg(F.max("id")).first()[0]
    if last is None:
        return iterations, None
    root = lineage(own, last).orderBy(F.desc("depth")).first()["id"]
    return pruned_after(iterations, refinement, root), root


def all_displayed(choice: DataFrame) -> DataFrame:
    return choice.withColumn("to_display", F.lit(True))


def lineage(iterations: DataFrame, start: int) -> DataFrame:
    """(id, depth) from an iteration up to its root, by a recursive query over (id, parent)."""
    return iterations.sparkSession.sql(
        """WITH RECURSIVE up(id, parent, depth) AS (
              SELECT id, parent, 0 FROM {tree} WHERE id = {start}
              UNION ALL
              SELECT i.id, i.parent, up.depth + 1 FROM {tree} i JOIN up ON i.id = up.parent)
            SELECT id, depth FROM up""",
        tree=iterations.select("id", "parent"),
        start=int(start),
    )


def parents(iterations: DataFrame) -> DataFrame:
    return iterations.filter("parent is not null").select("parent").distinct()


def listed(iterations: DataFrame, active: int) -> DataFrame:
    """(id, ordinal, is_root, is_active, is_parent)."""
    from pyspark.sql.window import Window

    up = parents(iterations).withColumn("is_parent", F.lit(True))
    rows = iterations.withColumn("ordinal", F.row_number().over(Window.partitionBy("project_id").orderBy("id")))
    rows = rows.join(up.withColumnRenamed("parent", "id"), "id", "left")
    return rows.select("id", "ordinal", F.col("parent").isNull().alias("is_root"), (F.col("id") == active).alias("is_active"), F.coalesce("is_parent", F.lit(False)).alias("is_parent"))


def without_project(table: DataFrame, project: int, shared: tuple[int, ...] = ()) -> DataFrame:
    """Rows of all other projects; a shared project is never deleted."""
    return table if project in shared else table.filter(~F.col("project_id").eqNullSafe(project))


def exported(choice: DataFrame, docs: DataFrame, topics: DataFrame, least: int = 20) -> DataFrame:
    """Checked rows with their metadata; cluster and first ten topic words once there are enough documents."""
    rows = choice.filter("is_check").select("doc_id").join(docs, "doc_id")
    if docs.count() < least:
        return rows
    words = F.array_join(F.slice(F.split("topic", ", "), 1, 10), ", ")
    return rows.join(topics.select("doc_id", F.col("cluster_id").alias("number_cluster"), words.alias("topic")), "doc_id", "left")
