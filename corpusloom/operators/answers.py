"""Answers per document: caches, validity, normal forms, and prompts within a budget.

Models are callables of a batch of texts; the defaults are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.functions.text import answer_key, document_key, without_nul
from corpusloom.operators.ranking import by_percent
from corpusloom.operators.vectors import section_best
from corpusloom.sources.staging import if_small, stored

NO_CONTEXT = "No relevant information found."
#: Answers that say nothing, in lower case.
INVALID = ("", "réponse non disponible", "no content available.", "no content available", "error generating response.")


def invalid_exact(answer: Column, values: Sequence[str] = INVALID) -> Column:
    return F.lower(F.trim(F.coalesce(answer, F.lit("")))).isin(*values)


def invalid_prefix(answer: Column, prefixes: Sequence[str]) -> Column:
    out = answer.isNull()
    for p in prefixes:
        out = out | answer.startswith(p)
    return out


def invalid_marker(answer: Column, markers: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m))


def placeholder_list(texts: Column, placeholders: Sequence[str] = ("", "...", "-", "n/a")) -> Column:
    return F.forall(texts, lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))).isin(*placeholders))


def cache_misses(docs: DataFrame, query: str, cache: DataFrame) -> DataFrame:
    """Documents whose key for the query is not in the cache, with the key."""
    keyed = docs.withColumn("key", answer_key(F.lit(query), F.col("doc_id")))
    return keyed.join(cache.select("key"), "key", "left_anti")


def faithfulness_key(question: str, answer: str, context: Sequence[str], model: str) -> str:
    body = json.dumps({"question": question, "answer": answer, "context": list(context), "model": model}, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(body.encode()).hexdigest()


def answered(docs: DataFrame, query: str, cache: DataFrame, model: Callable[[str, list[str]], list[str]], kept: Sequence[str] = ()) -> DataFrame:
    """(doc_id, kept..., key, answer, cached): cached answers, and the model's for the rest; no text gives NO_CONTEXT.

    Documents stay where they are unless the cache is too large for a broadcast.
    """
    keyed = docs.withColumn("key", answer_key(F.lit(query), F.col("doc_id")))
    known = stored(cache.select("key", "answer"), "cache")
    hits = keyed.join(if_small(known), "key").select("doc_id", *kept, "key", "answer", F.lit(True).alias("cached"))

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts.fillna("").tolist()
            filled = [t for t in given if t.strip()]
            said = iter(model(query, filled) if filled else ())
            # Not by assignment to a Series: that pads all answers to the longest one's length.
            yield pd.Series([next(said) if t.strip() else NO_CONTEXT for t in given], index=texts.index, dtype=object)

    rest = keyed.join(if_small(known.select("key")), "key", "left_anti").select("doc_id", *kept, "key", ask("text").alias("answer"), F.lit(False).alias("cached"))
    return hits.unionByName(rest)


def first_valid(answers: DataFrame, valid: Column, most: int, order: str = "doc_id") -> DataFrame:
    """Answers in order (by a column without repeats) up to and with the `most`-th valid one; all if there are fewer.

    Where that one stands is a top-k of the valid answers' keys, and the rest a filter.
    """
    first = answers.filter(valid).select(order).orderBy(order).limit(most)
    cut = first.agg(F.max(order).alias("_cut"), F.count(F.lit(1)).alias("_found"))
    return answers.crossJoin(F.broadcast(cut)).filter((F.col("_found") < most) | (F.col(order) <= F.col("_cut"))).drop("_cut", "_found")


def confident(answers: DataFrame, least: float = 0.0) -> DataFrame:
    return answers.filter(F.col("confidence_score") >= least)


def faithfulness(answers: DataFrame, scorer: Callable[[Column, Column], Column], invalid: Column) -> DataFrame:
    """Adds `faithfulness`: 0 for invalid answers and undefined scores; without context the citation is it."""
    context = F.when(F.size("citation_context") > 0, F.col("citation_context")).otherwise(F.array("citation"))
    score = scorer(F.col("answer"), context)
    return answers.withColumn("faithfulness", F.when(invalid | score.isNull() | F.isnan(score), F.lit(0.0)).otherwise(score))


def overlap_scorer(answer: Column, context: Column) -> Column:
    """Part of an answer's words that its context holds."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    own = words(answer)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words(F.array_join(context, " ")))) / F.size(own)).otherwise(F.lit(0.0))


def any_path(record: Column, paths: Sequence[str]) -> Column:
    """The first of several spellings of a field that a variant holds."""
    return F.coalesce(*[F.try_variant_get(record, p, "string") for p in paths])


#: How the two classes are spelt.
MAJEURES = ("majeures", "majeure", "Majeures", "Majeure")
MINEURES = ("mineures", "mineure", "Mineures", "Mineure")


def text_list(record: Column, names: Sequence[str]) -> Column:
    """The texts under the first spelling that is there: a list's, or a single one; trimmed, without blank ones."""
    found = F.lit(None).cast("array<string>")
    for n in reversed(names):
        path = f"$['{n}']"
        one, many = F.try_variant_get(record, path, "string"), F.try_variant_get(record, path, "array<string>")
        found = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), found)
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))


def classes(answer: Column) -> Column:
    """struct(majeures, mineures) of a JSON answer, whatever the spelling of its fields."""
    v = F.try_parse_json(answer)
    return F.struct(text_list(v, MAJEURES).alias("majeures"), text_list(v, MINEURES).alias("mineures"))


#: A model of texts: an answer for each of a list.
Model = Callable[[list[str]], list[str]]


def asked(text: Column, model: Model, tries: int = 3, wait_s: float = 1.0) -> Column:
    """A model's answers to texts, batch by batch; a call that fails is repeated after waits that double."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(insistent(model, texts.fillna("").tolist(), tries, wait_s), index=texts.index)

    return run(text)


def insistent(model: Model, texts: list[str], tries: int = 3, wait_s: float = 1.0) -> list[str]:
    """The model's answers; of `tries` calls all but the last may fail."""
    for k in range(tries - 1):
        try:
            return model(texts)
        except Exception:  # whatever the model's own errors are; the last try's comes out
            time.sleep(wait_s * 2**k)
    return model(texts)


def classification_key(raw: Column, doc_id: Column, engine: str) -> Column:
    """Key of a document's classification by an engine: its raw key, or its number where that is blank."""
    return F.concat(F.lit("classify_doc_"), document_key(raw, doc_id), F.lit(f"_{engine}"))


def classified(documents: DataFrame, cache: DataFrame, engine: str, by_sentences: Callable[[Column], Column], by_slices: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, key, results, path): `cached`, else `sentences` where that gives results, else `slices`.

    documents: (doc_id, raw_document_id, text); cache: (key, results), an array. Both classifiers
    turn a text into an array; slices are asked for only where sentences give none.
    """
    keyed = documents.withColumn("key", classification_key(F.col("raw_document_id"), F.col("doc_id"), engine))
    known = cache.select("key", "results").filter(F.size("results") > 0)
    hits = keyed.join(known, "key").select("doc_id", "key", "results", F.lit("cached").alias("path"))
    first = keyed.join(known.select("key"), "key", "left_anti").withColumn("results", by_sentences(F.col("text")))
    first = stored(first.select("doc_id", "key", "text", "results"), "by-sentences")
    some = F.coalesce(F.size("results") > 0, F.lit(False))
    done = first.filter(some).select("doc_id", "key", "results", F.lit("sentences").alias("path"))
    rest = first.filter(~some).select("doc_id", "key", by_slices(F.col("text")).alias("results"), F.lit("slices").alias("path"))
    return hits.unionByName(done).unionByName(rest)


#: Sections of answers and context.
MAJOR_SECTION, SUBSUMPTION = "Majeure", "Mineure-Subsommation"
NO_SUMMARY = '{"summary": "No relevant context was found.", "key_elements": [], "law_articles": []}'
FAILED_SUMMARY = '{"summary": "Error getting answer from openai", "key_elements": [], "law_articles": []}'


def section_answers(documents: DataFrame, chunks: DataFrame, query: Sequence[float] | Column, question: str, model: Model, scores: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, citation_context, answer, valid): one answer for each document from its best chunks by section.

    documents: (doc_id, record_key); of more than `most` those of best score count. The context is
    a map of section to texts, best first; the model is asked with question and context, once for
    each document, and answers JSON. valid: JSON with something in a section.
    """
    if most is not None:
        documents = documents.join(scores.select("doc_id", "score"), "doc_id", "left").orderBy(F.col("score").desc_nulls_last(), "doc_id").limit(most).drop("score") if scores is not None else documents.orderBy("doc_id").limit(most)
    best = section_best(chunks.join(documents.select("record_key"), "record_key", "left_semi"), query)
    texts = best.groupBy("record_key", "section").agg(F.array_sort(F.collect_list(F.struct("section_place", "text"))).alias("t"))
    maps = texts.groupBy("record_key").agg(F.map_from_entries(F.collect_list(F.struct("section", F.transform("t", lambda x: without_nul(x["text"]))))).alias("citation_context"))
    rows = documents.join(maps, "record_key", "left").withColumn("citation_context", F.coalesce("citation_context", F.create_map().cast("map<string,array<string>>")))
    prompt = F.concat(F.lit(question + "\n\n"), context_of(F.col("citation_context")))
    answered_rows = rows.select("doc_id", "citation_context", without_nul(asked(prompt, model)).alias("answer"))
    sections = F.from_json("answer", "map<string,string>")
    filled = F.exists(F.map_values(sections), lambda v: ~F.coalesce(v, F.lit("")).isin("", "[]", "{}", "null"))
    return answered_rows.withColumn("valid", F.coalesce(filled, F.lit(False)))


def summary_of_sections(answers: DataFrame, question: str, model: Model, budget: int = 100_000) -> DataFrame:
    """One row, (summary_answer, valid_answer_count): the model's summary of valid answers' subsumptions and major premises.

    Parts go into the prompt in order of doc_id while the characters before them are within the
    budget; a fixed summary where there is none, another where the model's is not JSON.
    """
    valid = answers.filter("valid")
    sub = F.array_join(text_list(F.try_parse_json("answer"), (SUBSUMPTION,)), "\n")
    part = F.concat_ws("\n", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), sub), F.array_join(F.coalesce(F.try_element_at("citation_context", F.lit(MAJOR_SECTION)), F.array().cast("array<string>")), "\n"))
    # Enough rows to pass the budget if each had a single character.
    rows = valid.select(F.lit(1).alias("g"), "doc_id", part.alias("part"), F.length(part).alias("size")).orderBy("doc_id").limit(budget + 1)
    fitting = prompt_parts(rows, "g", "doc_id", "size", budget)
    prompt = fitting.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "part"))), lambda x: x["part"]), "\n\n").alias("prompt"), F.count(F.lit(1)).alias("n"))
    told = prompt.withColumn("told", F.when(F.col("n") > 0, asked(F.concat(F.lit(question + "\n\n"), F.col("prompt")), model)))
    summary = F.when(F.col("n") == 0, F.lit(NO_SUMMARY)).when(F.try_parse_json("told").isNull(), F.lit(FAILED_SUMMARY)).otherwise(F.col("told"))
    return told.select(summary.alias("summary_answer")).crossJoin(valid.agg(F.count(F.lit(1)).alias("valid_answer_count")))


def run_answers(documents: DataFrame, question: str, cache: DataFrame, model: Callable[[str, list[str]], list[str]], scorer: Callable[[Column, Column], Column], most_valid: int | None = None, least: float = 0.0, step: Callable[[str], None] = lambda _: None) -> dict[str, DataFrame]:
    """A whole run of the generic pipeline: `answers` with scores, `valid` ones over the confidence, and their `counts`.

    documents: (doc_id, text, citation, citation_context). `step` hears each step's name.
    """
    step("questioning_documents")
    rows = answered(documents, question, cache, model, ["citation", "citation_context"])
    if most_valid is not None:  # else answers are written once, with their scores
        rows = first_valid(stored(rows, "answers"), ~invalid_exact(F.col("answer")), most_valid)
    step("scoring_answers")
    scored = stored(faithfulness(rows, scorer, invalid_exact(F.col("answer"))).withColumnRenamed("faithfulness", "confidence_score"), "scored")
    step("generating_statistics")
    valid = confident(scored.filter(~invalid_exact(F.col("answer"))), least)
    counts = scored.agg(F.count(F.lit(1)).alias("num_documents"), F.count_if((F.col("confidence_score") != 0) & (F.col("confidence_score") >= least)).alias("valid_answer_count"))
    step("completed")
    return {"answers": scored, "valid": valid, "counts": counts}


def cluster_context(elements: DataFrame, chunks: DataFrame, cluster: int, tokens: Column, limit: int) -> DataFrame:
    """One row, `context`: chunks of a cluster's documents, likeliest documents first, while the tokens before are within the limit. Chunks without tokens say nothing and go."""
    own = elements.filter(F.col("cluster_id") == cluster).select("doc_id", "prob")
    rows = own.join(chunks, "doc_id").select(F.lit(1).alias("g"), F.struct((-F.col("prob")).alias("p"), "doc_id", "position").alias("at"), "text", tokens.alias("n"))
    kept = prompt_parts(rows.filter("n > 0").orderBy("at").limit(limit + 1), "g", "at", "n", limit)
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("context"))


def summary(context: DataFrame, instruction: str, model: Model) -> DataFrame:
    """Adds `summary`: the model's answer to an instruction and a context; the fixed message where there is none."""
    blank = F.trim("context") == ""
    return context.withColumn("summary", F.when(blank, F.lit(NO_CONTEXT)).otherwise(asked(F.concat(F.lit(instruction + "\n\n"), "context"), model)))


def considered(answers: DataFrame, considerations: Sequence[str], judge: Callable[[Column, str], Column]) -> DataFrame:
    """(doc_id, consideration, supported) of every answer and consideration of a stated list; `judge` says which answers support one."""
    each = F.array(*[F.struct(F.lit(c).alias("consideration"), judge(F.col("answer"), c).alias("supported")) for c in considerations])
    return answers.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.consideration", F.coalesce("c.supported", F.lit(False)).alias("supported"))


def closed_category(answer: Column) -> Column:
    """`oui`, `non`, `peut_etre` or `mixte` by how an answer begins; a stand-in for a model."""
    low = F.lower(F.trim(answer))
    yes, no = low.rlike(r"^(oui|yes|ja|sì)\b"), low.rlike(r"^(non|no|nein)\b")
    both = low.rlike(r"\b(oui|yes)\b") & low.rlike(r"\b(non|no)\b")
    return F.when(both, "mixte").when(yes, "oui").when(no, "non").otherwise("peut_etre")


def context_of(sections: Column, skipped: Sequence[str] = ("Majeure",)) -> Column:
    """Text of a map of section to texts, without the skipped ones; a fixed message if empty."""
    kept = F.map_entries(F.map_filter(sections, lambda k, _: ~k.isin(*skipped)))
    body = F.array_join(F.flatten(F.transform(kept, lambda e: e["value"])), "\n")
    return F.when(F.trim(body) == "", F.lit(NO_CONTEXT)).otherwise(body)


def prompt_parts(rows: DataFrame, group: str, order: str, tokens: str, limit: int) -> DataFrame:
    """Rows in order while the tokens before them are within the limit; the one that crosses it stays."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("tokens_before", F.coalesce(F.sum(tokens).over(w), F.lit(0))).filter(F.col("tokens_before") <= limit)


def latest(rows: DataFrame, group: str, order: str) -> DataFrame:
    best = rows.groupBy(group).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return best.select("r.*")


def consideration_model(n: int) -> StructType:
    return StructType([StructField(f"argument_{k}", BooleanType()) for k in range(1, n + 1)])


def question_kind(question: Column) -> Column:
    """`closed` if a question asks for yes or no, else `open`; a stand-in for a model."""
    return F.when(F.lower(F.trim(question)).rlike(r"^(est-ce|is|are|does|do|did|can|has|have|was|were|peut|doit|faut)\b"), "closed").otherwise("open")


def incremental(old: DataFrame, new: DataFrame, key: str = "doc_id", legacy: bool = False) -> DataFrame:
    """Old rows and the new ones that are not there yet; `legacy` repeats those of the shared day."""
    fresh = new if legacy else new.join(old.select(key), key, "left_anti")
    return old.unionByName(fresh)


def flattened(record: Column) -> Column:
    """A map of a JSON object's values as texts without NUL characters; nested values are JSON."""
    return F.transform_values(F.from_json(record, "map<string,string>"), lambda _, v: without_nul(v))


CONSIDERATIONS = "array<struct<text:string,frequency:bigint,percent:double,procedure_types:array<string>>>"


def parsed_summary(text: Column) -> Column:
    """struct(summary, regle_droit, considerations) of a JSON answer; what is missing or broken has a default.

    Considerations are structs with trimmed texts, the greatest percent first.
    """
    v = F.try_parse_json(text)
    found = F.coalesce(F.try_variant_get(v, "$.considerations", CONSIDERATIONS), F.array().cast(CONSIDERATIONS))
    filled = F.transform(
        found,
        lambda c: F.struct(
            F.trim(F.coalesce(c["text"], F.lit(""))).alias("text"),
            F.coalesce(c["frequency"], F.lit(0).cast("long")).alias("frequency"),
            F.coalesce(c["percent"], F.lit(0.0)).alias("percent"),
            F.coalesce(c["procedure_types"], F.array().cast("array<string>")).alias("procedure_types"),
        ),
    )
    whole = F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.when(v.isNull(), text), F.lit(""))
    rule = F.coalesce(F.try_variant_get(v, "$.regle_droit", "string"), F.lit(""))
    return F.struct(whole.alias("summary"), rule.alias("regle_droit"), by_percent(filled).alias("considerations"))


def history(rags: DataFrame, project: int) -> DataFrame:
    """A project's question runs, newest first."""
    return rags.filter(F.col("project_id") == project).orderBy(F.desc("created_at"), F.desc("rag_id"))


def current_run(rags: DataFrame, answers: DataFrame, rag_id: int) -> DataFrame:
    """One row for a run: its fields, the parsed summary, and flags from its first answer.

    rags: (rag_id, query, summary_answer, ...); answers: (rag_id, doc_id, confidence_score, citation_context variant).
    """
    first = of_project(answers, rag_id).agg(F.min_by(F.struct(F.col("confidence_score").isNotNull().alias("has_confidence_score"), F.schema_of_variant("citation_context").startswith("OBJECT").alias("has_section_ans")), "doc_id").alias("f"))
    rows = rags.filter(F.col("rag_id") == rag_id).withColumn("parsed", parsed_summary(F.col("summary_answer"))).crossJoin(first)
    flag = lambda name: F.coalesce(F.col("f")[name], F.lit(False)).alias(name)
    return rows.select("*", F.col("parsed.*"), flag("has_confidence_score"), flag("has_section_ans")).drop("parsed", "f")


def run_context(rags: DataFrame, answers: DataFrame, choice: DataFrame, project: int, rag_id: int | None = None) -> dict[str, DataFrame]:
    """What a workspace shows of a project: `history`, the `current` run if one is asked for, and the `documents` that are marked yes."""
    out = {"history": history(rags, project), "documents": choice.filter("is_check").select("doc_id")}
    return out if rag_id is None else out | {"current": current_run(rags.filter(F.col("project_id") == project), answers, rag_id)}


def reference_table(rows: Column, documents: Column) -> Column:
    """Summary rows (struct with `reference`, numbers in a text) with `references`, their known documents.

    documents: a map of doc_id to procedure type.
    """
    kind = lambda d: F.try_element_at(documents, d)
    numbers = lambda r: F.transform(F.regexp_extract_all(r["reference"], F.lit(r"(\d{1,18})"), F.lit(1)), lambda d: d.cast("long"))
    return F.transform(rows, lambda r: F.struct(r["text"].alias("text"), F.transform(F.filter(numbers(r), lambda d: kind(d).isNotNull()), lambda d: F.struct(d.alias("doc_id"), kind(d).alias("procedure_type"))).alias("references")))


def supported_only(considerations: DataFrame) -> DataFrame:
    return considerations.filter(F.col("frequency") > 0)


def of_project(answers: DataFrame, rag_id: int) -> DataFrame:
    return answers.filter(F.col("rag_id") == rag_id)


def valid_json(text: Column) -> Column:
    """The text, or an error payload where it is not JSON."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit('{"error": "invalid JSON"}'))
