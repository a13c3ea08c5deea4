"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontaminate, divergence, langid, lengths, lines, neardup, oracles, order, packing, quality, substring, urls, whitening
from corpusloom.llm.common import run_folder, split_words, stored
from corpusloom.sources.tables import read_table


def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return lengths.context_limits(lengths.length_histogram(read_table(spark, root, "documents"), lengths.production_tokenizer()))


def op2_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").select("doc_id", "text", "lang")
    learned = docs.filter(~langid.held_out(F.col("doc_id"))).dropna()
    found = stored(langid.predict(docs, langid.train(learned)), "languages")
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, root, "documents"))


def op4_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, root, "documents"), read_table(spark, root, "benchmark"))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        F.col("key.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, root, "documents"))


def op5_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    cut = substring.remove_repeats(read_table(spark, root, "documents"))
    kept = F.sha2(F.array_join(split_words(F.col("kept_text")), " "), 256)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", kept.alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, root: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, root, "pages"))


def op8_training_order(spark: SparkSession, root: str) -> DataFrame:
    path = f"{run_folder(spark)}/order-{uuid.uuid4().hex}"
    order.write_order(read_table(spark, root, "documents"), path, lengths.production_tokenizer())
    return order.read_order(spark, path, digest=True)


#: A conversation whose texts hold the template's own marks.
MARKS = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '%s' AS text UNION ALL SELECT -1L, 1L, 'assistant', '%s'" % (MARKS, MARKS))
    done = chat.format_chats(chat.conversation_records(rows.unionByName(own)))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_packing(spark: SparkSession, root: str) -> DataFrame:
    return stored(packing.digests(packing.pack(read_table(spark, root, "documents"), packing.production_tokenizer())), "pieces")


def op11_embedding_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whitened_components(read_table(spark, root, "embeddings"))


def op12_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    cut = lines.keep_lines(read_table(spark, root, "documents").select("doc_id", "text"))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit(read_table(spark, root, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_url_filters": op7_url_filters,
    "op8_training_order": op8_training_order,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}
#: The others rest on tokenizers, trained models or iterated estimates; tests hold them against brute force.
ORACLE = {
    "op4_decontamination": oracles.OP4,
    "op5_substring_dedup": oracles.OP5,
    "op6_near_duplicates": oracles.OP6,
    "op9_chat_formatting": oracles.op9(MARKS),
    "op12_line_dedup": oracles.OP12,
    "op13_source_divergence": oracles.OP13,
}
