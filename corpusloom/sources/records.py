"""Nested decision records: reading, renaming, dates, keyed writes, and remote feeds."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.sources.staging import if_small, stored

#: Source fields and their names here.
ROOT_FIELDS = {
    "resume": "summary", "normes": "standards", "proc_year": "procedure_year", "parties": "parties_involved", "recours": "appeals",
    "publieinternet": "published_internet", "rectification": "correction", "cle_fiche": "record_key", "datedecision": "decision_date",
    "procedure": "procedure_type", "decision": "decision_type", "importance": "importance", "n_ext_proc": "external_procedure_number",
    "document": "document", "nature": "nature", "dt_decision": "decision_date", "coll_nom": "collector_name", "relations": "relations",
    "source": "source", "fichierword": "word_file", "arretdeprincipe": "stopped_from_begin", "n_ext_jur_attr": "external_jurisdiction_attribute",
    "resultat": "result", "document_text": "document_text", "descripteurs": "descriptors", "id": "id",
}
APPEAL_FIELDS = {
    "date_fin": "end_date", "type_recours": "appeal_type", "t_modif": "modification_time", "oper_modif": "modified_by", "etat_action": "action_status",
    "cle_fiche": "record_key", "resultat": "result", "oper_creat": "created_by", "ts_creat": "creation_timestamp", "chambre": "chamber",
    "d_modif": "modification_date", "type": "case_type", "date_debut": "start_date", "cle_decis_recours": "decision_appeal_key", "no_decis": "decision_number",
    "no_atf": "atf_number", "ts_modif": "modification_timestamp", "nature": "case_nature", "cle_action": "action_key", "no_procedure": "procedure_number",
}
APPEAL_DATES = ("end_date", "start_date", "modification_date")
APPEAL_TIMES = ("creation_timestamp", "modification_timestamp")

RAW = StructType(
    [StructField(k, ArrayType(StructType([StructField(a, StringType()) for a in APPEAL_FIELDS])) if k == "recours" else StringType()) for k in ROOT_FIELDS]
)


def read_records(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """JSON lines with the schema given; a broken line stops the scan, or is dropped if lenient."""
    if PurePosixPath(path).suffix not in (".jsonl", ".json") and "*" not in path:
        raise ValueError(f"not a .json or .jsonl file: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder):
        raise FileNotFoundError(path)
    return spark.read.schema(RAW).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value) of text files, lines counted from 1.

    A file may be read in several blocks; a line's number is its place in its block plus the lines
    of the file's blocks before, whose counts are one small table. Files are taken not to change.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = if_small(stored(blocks.withColumn("before", before).select("file", "block", "first", "before"), "blocks"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_number"), "value")


def numbered_records(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """(file, line_number, record, bad) of JSON lines; `bad` is the line where it is no JSON of the schema, else null."""
    whole = StructType([*schema.fields, StructField("_bad", StringType())])
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad"}))
    record = F.when(F.col("r._bad").isNull(), F.struct(*[F.col(f"r.{f.name}") for f in schema.fields]))
    return parsed.select("file", "line_number", record.alias("record"), F.col("r._bad").alias("bad"))


def bad_lines(numbered: DataFrame) -> DataFrame:
    """(file, line_number, bad): what a lenient scan leaves out."""
    return numbered.filter("bad is not null").select("file", "line_number", "bad")


def field_names(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """All keys of a JSON-lines file; an error if there are more than `most`."""
    rows = spark.read.text(path).select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("k"))
    found = [r["k"] for r in rows.distinct().orderBy("k").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} keys")
    return found


def key_types(records: DataFrame, value: str = "value") -> DataFrame:
    """(key, types): the kinds of value that each key of JSON objects has, sorted."""
    rows = records.select(F.try_parse_json(value).alias("v"))
    each = records.sparkSession.sql("SELECT f.key, schema_of_variant(f.value) AS kind FROM {rows} AS t, LATERAL variant_explode(t.v) AS f", rows=rows)
    return each.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("types"))


def field_types(records: DataFrame, value: str = "value") -> DataFrame:
    """The common schema of JSON texts as one string."""
    return records.agg(F.schema_of_variant_agg(F.try_parse_json(value)).alias("schema"))


def translated(raw: DataFrame, legacy: bool = False) -> DataFrame:
    """Fields renamed; missing ones are null, a missing list of appeals is empty, others go.

    The date is that of the later field, or the earlier one's where it is missing; `legacy` lets
    the later field overwrite even where it is missing.
    """
    have = set(raw.columns)
    get = lambda k: F.col(k) if k in have else F.lit(None).cast("string")
    day = get("dt_decision") if legacy else F.coalesce(get("dt_decision"), get("datedecision"))
    out = [get(k).alias(v) for k, v in ROOT_FIELDS.items() if k not in ("recours", "datedecision", "dt_decision")]
    kind = "array<struct<" + ",".join(f"{v}:string" for v in APPEAL_FIELDS.values()) + ">>"
    renamed = F.transform("recours", lambda a: F.struct(*[a[k].cast("string").alias(v) for k, v in APPEAL_FIELDS.items()])) if "recours" in have else F.lit(None).cast(kind)
    return raw.select(*out, day.alias("decision_date"), F.coalesce(renamed, F.array().cast(kind)).alias("appeals"))


def day(text: Column, strict: bool = False) -> Column:
    """dd.MM.yyyy as yyyy-MM-dd; a bad date is null, or an error if strict."""
    return F.date_format(F.to_date(text, "dd.MM.yyyy") if strict else F.try_to_date(text, "dd.MM.yyyy"), "yyyy-MM-dd")


def moment(text: Column, strict: bool = False) -> Column:
    pattern = "dd/MM/yy HH:mm:ss.SSSSSS"
    return F.date_format(F.to_timestamp(text, pattern) if strict else F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def normalized(records: DataFrame, strict: bool = False) -> DataFrame:
    """Dates of records and appeals in one form; nothing else changes."""

    def appeal(a: Column) -> Column:
        part = lambda v: day(a[v], strict) if v in APPEAL_DATES else moment(a[v], strict) if v in APPEAL_TIMES else a[v]
        return F.struct(*[part(v).alias(v) for v in APPEAL_FIELDS.values()])

    return records.withColumn("decision_date", day(F.col("decision_date"), strict)).withColumn("appeals", F.transform("appeals", appeal))


def upserted(old: DataFrame, new: DataFrame, key: str = "record_key", create_only: bool = False, order: str | None = None) -> DataFrame:
    """Rows of both by key: the new replace the old, or only add to them. New rows without key go.

    Of new rows with one key the one of greatest `order` counts; without, the last one read.
    """
    fresh = new.filter(F.col(key).isNotNull()).withColumn("_n", F.col(order) if order else F.monotonically_increasing_id())
    columns = [F.col(f"`{c}`") for c in new.columns]
    fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*columns), "_n").alias("_r")).select("_r.*")
    if create_only:
        return old.unionByName(fresh.join(old.select(key), key, "left_anti").select(*old.columns))
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def upsert_counts(old: DataFrame, new: DataFrame, key: str = "record_key") -> DataFrame:
    """created, overwritten, without_key."""
    known = old.select(F.col(key).alias("_k")).distinct()
    rows = new.join(known, F.col(key) == F.col("_k"), "left")
    has = F.col(key).isNotNull()
    return rows.agg(F.count_if(has & F.col("_k").isNull()).alias("created"), F.count_if(F.col("_k").isNotNull()).alias("overwritten"), F.count_if(~has).alias("without_key"))


def filled(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def feed_records(hits: DataFrame, collector: str, source: str = "value") -> DataFrame:
    """Feed hits (JSON texts) as records; without signature or text they go.

    Attachments may be an object or a list, case numbers a text or a list, abstracts one of four.
    """
    v = F.try_parse_json(F.col(source))
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    numbers = F.coalesce(F.array_join(get("$.Num", "array<string>"), ";"), get("$.Num"))
    text = filled(get("$.attachment.content"), get("$.attachment[0].content"))
    summary = filled(get("$.Abstract[0].Text"), get("$.Abstract"), get("$.Leitsatz"), get("$.Rechtsgebiet"))
    rows = hits.select(
        get("$.Signatur").alias("record_key"), get("$.Spider").alias("spider"), get("$.Datum").alias("decision_date"), get("$.Sprache").alias("language"),
        numbers.alias("procedure_type"), text.alias("document_text"), summary.alias("summary"), F.lit(collector).alias("collector_name"),
    )
    return rows.filter((F.coalesce(F.trim("record_key"), F.lit("")) != "") & F.col("document_text").isNotNull())


def feed_scan(records: DataFrame, spiders: list[str] = (), language: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    if spiders:
        records = records.filter(F.col("spider").isin(*spiders))
    if language:
        records = records.filter(F.col("language") == language)
    if since:
        records = records.filter(F.col("decision_date") >= since)
    return records.limit(limit) if limit is not None else records


def write_feed(records: DataFrame, path: str) -> None:
    """Feed records as Parquet by spider and language: `feed_scan` of what is read back opens the folders that it asks for alone."""
    records.write.mode("append").partitionBy("spider", "language").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_inputs(records: DataFrame, path: str, key: str = "record_key") -> DataFrame:
    """Write a JSON file for each keyed record that has none below `path` yet; returns those that it wrote."""
    spark = records.sparkSession
    try:
        done = spark.read.schema(f"`{key}` string, body string").json(path).select(F.col(key).cast("string"))
    except AnalysisException:
        done = spark.createDataFrame([], f"`{key}` string")
    fresh = records.filter(F.coalesce(F.col(key), F.lit("")) != "").join(done, key, "left_anti")
    fresh = stored(fresh.dropDuplicates([key]), "inputs")
    fresh.select(F.col(key), F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("body")).write.mode("append").partitionBy(key).json(path)
    return fresh


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def indices_to_restore(snapshots: DataFrame, there: DataFrame) -> DataFrame:
    """(name, index): the latest snapshot's indices (an array) that are not there (index)."""
    return latest_snapshot(snapshots).select("name", F.explode("indices").alias("index")).join(there.select("index"), "index", "left_anti").select("name", "index")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("start_time"), "name").limit(1)
