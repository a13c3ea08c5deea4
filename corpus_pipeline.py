"""Training-data pipeline over `documents`: one operator a stage, each written before the next reads it.

Cases: null, empty and blank texts fail the base rules and go at once. Of rows that share a doc_id
and a text one stays; of rows that share a doc_id only, all that are no near copies. Texts may be of
any length. Nulls in other columns and extra columns come through all stages but the last, which
returns pieces. An empty table gives no pieces; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, neardup, packing, quality, substring
from corpusloom.llm.common import batch_by_text, discard, small_batches, stored
from corpusloom.sources.tables import read_table

#: Words of a shingle in the near-duplicate stage; the contract of op6, which takes four, binds that query alone.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near copies."""
    return neardup.keep_one(docs, SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; n_chars follows, emptied documents go."""
    return substring.remove_from(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat the benchmark."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each a sequence of its own."""
    batch_by_text(spark)
    return packing.with_digests(packing.pack(docs, packing.production_tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]
#: Robust estimates and tokenizers cannot be stated in SQL; a test runs a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one is written."""
    docs, held = read_table(spark, sf_dir, "documents"), None
    with small_batches(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            if held is not None:
                discard(held)
            held = docs
    return docs
