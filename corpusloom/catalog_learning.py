"""More queries of the catalogue: searches over a stored index, and models learned from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import _bm25, corpus, query, texts
from corpusloom.functions import classify, languages, tagging
from corpusloom.operators import postings, vector_index
from corpusloom.sources.staging import run_folder
from corpusloom.sources.tables import read_table

# Search over an index that is written once a session for each folder of tables.

_WRITTEN: dict[tuple[str, str], postings.Index] = {}


def index_of(spark: SparkSession, root: str) -> postings.Index:
    key = (spark.sparkContext.applicationId, root)
    if key not in _WRITTEN:
        _WRITTEN[key] = postings.write_index(corpus(spark, root), f"{run_folder(spark)}/index-{uuid.uuid4().hex}", kept=["source", "decision_date"])
    return _WRITTEN[key]


@query("q_index_bool_and", "SELECT doc_id, source FROM {padded} WHERE (contains(p, ' this ') OR contains(p, ' with ')) AND contains(p, ' from ')")
def q_index_bool_and(spark, root):
    return postings.found(index_of(spark, root), "(this OR with) AND from").select(F.col("id").alias("doc_id"), "source")


@query("q_index_phrase", "SELECT doc_id FROM {padded} WHERE contains(p, ' of the ') AND NOT contains(p, ' ble ')")
def q_index_phrase(spark, root):
    return postings.found(index_of(spark, root), '"of the" NOT ble').select(F.col("id").alias("doc_id"))


@query("q_index_bm25", _bm25(("this", "with", "from"), "(tf0 > 0 OR tf1 > 0) AND tf2 > 0 AND NOT list_contains(tokens, 'ble')").replace("LIMIT 20", ""))
def q_index_bm25(spark, root):
    return postings.scored(index_of(spark, root), "(this OR with) AND from NOT ble").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("q_index_top20", _bm25(("this", "with", "from"), "(tf0 > 0 OR tf1 > 0) AND tf2 > 0 AND NOT list_contains(tokens, 'ble')"))
def q_index_top20(spark, root):
    return postings.top(index_of(spark, root), "(this OR with) AND from NOT ble", 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# Languages by character n-grams, learned from all documents that name theirs.

_LETTERS = r"regexp_extract_all(lower(coalesce({text}, '')), '\p{{L}}+')"


@query(
    "x_language_grams",
    f"""WITH w AS MATERIALIZED (SELECT doc_id, lang, w, count(*) AS n FROM (SELECT doc_id, lang, unnest({_LETTERS.format(text='text')}) AS w FROM documents) GROUP BY doc_id, lang, w),
       g AS MATERIALIZED (SELECT w, k, substring(' ' || w || ' ', s, k) AS gram FROM (SELECT w, k, unnest(range(1, length(w) + 4 - k)) AS s FROM (SELECT DISTINCT w FROM w), (SELECT unnest(range(1, 6)) AS k))),
       og AS MATERIALIZED (SELECT * FROM g WHERE gram <> ' '),
       c AS MATERIALIZED (SELECT lang, k, gram, sum(n) AS n FROM (SELECT lang, w, sum(n) AS n FROM w WHERE lang IS NOT NULL GROUP BY lang, w) JOIN og USING (w) GROUP BY lang, k, gram),
       v AS (SELECT k, count(DISTINCT gram) AS v FROM c GROUP BY k),
       f AS MATERIALIZED (SELECT lang, k, ln(0.5 / (sum(n) + 0.5 * any_value(v.v))) AS floor FROM c JOIN v USING (k) GROUP BY lang, k),
       s AS MATERIALIZED (SELECT og.w, f.lang, sum(ln(1 + coalesce(c.n, 0) / 0.5) + f.floor) AS s, count(*) FILTER (og.k = 3 AND c.n > 0) AS seen, count(*) FILTER (og.k = 3) AS telling
             FROM og JOIN f USING (k) LEFT JOIN c ON c.lang = f.lang AND c.gram = og.gram GROUP BY og.w, f.lang),
       d AS (SELECT doc_id, s.lang AS found, sum(n * s) AS s, sum(n * seen) AS seen, sum(n * telling) AS telling FROM w JOIN s USING (w) GROUP BY doc_id, s.lang),
       b AS (SELECT doc_id, arg_max(found, s) AS found, arg_max(seen / telling, s) AS known FROM d GROUP BY doc_id)
       SELECT doc_id, CASE WHEN known >= 0.5 THEN found END AS language FROM documents LEFT JOIN b USING (doc_id)""",
)
def x_language_grams(spark, root):
    docs = texts(spark, root)
    return languages.detect(docs, languages.learn_languages(docs)).select("doc_id", "language")


# Tags in context: a turn's words by the language that their neighbours speak, learned from documents.


def _tagged_documents(spark: SparkSession, root: str) -> DataFrame:
    rows = texts(spark, root).filter("lang is not null")
    return rows.select("doc_id", F.col("lang").alias("tag"), F.posexplode(languages.letter_words(F.col("text"))).alias("i", "word"))


def _turn_words(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "conversations").filter("turn < 1000")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), languages.letter_words(F.col("text")).alias("tokens"))


_TAGGED = f"""t AS MATERIALIZED (SELECT lang AS tag, unnest(w) AS word FROM (SELECT lang, {_LETTERS.format(text='text')} AS w FROM documents WHERE lang IS NOT NULL)),
       e AS MATERIALIZED (SELECT word, tag, count(*) AS n FROM t GROUP BY word, tag), whole AS MATERIALIZED (SELECT tag, sum(n) AS n FROM e GROUP BY tag),
       kinds AS (SELECT count(DISTINCT word) AS k FROM e), voc AS MATERIALIZED (SELECT DISTINCT word FROM e),
       d AS (SELECT lang AS tag, len({_LETTERS.format(text='text')}) AS n FROM documents WHERE lang IS NOT NULL),
       starts AS (SELECT whole.tag, ln((0.1 + coalesce(x.n, 0)) / (SELECT count(*) FILTER (n > 0) + 0.1 * (SELECT count(*) FROM whole) FROM d)) AS s FROM whole LEFT JOIN (SELECT tag, count(*) AS n FROM d WHERE n > 0 GROUP BY tag) x USING (tag)),
       moves AS MATERIALIZED (SELECT a.tag AS a, b.tag AS b, ln((0.1 + CASE WHEN a.tag = b.tag THEN x.n ELSE 0 END) / (x.n + 0.1 * (SELECT count(*) FROM whole))) AS m
             FROM whole a JOIN whole b ON true JOIN (SELECT tag, coalesce(sum(n - 1) FILTER (n > 0), 0) AS n FROM d GROUP BY tag) x ON x.tag = a.tag),
       ws AS MATERIALIZED (SELECT voc.word, whole.tag, ln((coalesce(e.n, 0) + 0.1) / (whole.n + 0.1 * ((SELECT k FROM kinds) + 1))) AS s FROM voc JOIN whole ON true LEFT JOIN e ON e.word = voc.word AND e.tag = whole.tag),
       rare AS (SELECT word FROM e GROUP BY word HAVING sum(n) <= 10),
       few AS MATERIALIZED (SELECT suffix, tag, sum(n) AS n FROM (SELECT substring(word, length(word) - k + 1, k) AS suffix, tag, n FROM (SELECT word, tag, n, unnest(range(0, least(length(word), 4) + 1)) AS k FROM e SEMI JOIN rare USING (word))) GROUP BY suffix, tag),
       base AS (SELECT suffix, sum(n) AS n FROM few GROUP BY suffix),
       sfx AS MATERIALIZED (SELECT base.suffix, whole.tag, ln((coalesce(few.n, 0) + 0.1) / (base.n + 0.1 * (SELECT count(*) FROM whole))) - ln(whole.n) AS s FROM base JOIN whole ON true LEFT JOIN few ON few.suffix = base.suffix AND few.tag = whole.tag)"""


@query(
    "x_tagged_words",
    f"""WITH RECURSIVE {_TAGGED},
       q AS MATERIALIZED (SELECT conv_id * 1000 + turn AS doc_id, {_LETTERS.format(text='text')} AS w FROM conversations WHERE turn < 1000),
       qt AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM q),
       new AS MATERIALIZED (SELECT word, substring(word, length(word) - max(k) + 1, max(k)) AS suffix FROM (SELECT word, unnest(range(0, least(length(word), 4) + 1)) AS k FROM (SELECT DISTINCT word FROM qt ANTI JOIN voc USING (word)))
             WHERE substring(word, length(word) - k + 1, k) IN (SELECT suffix FROM base) GROUP BY word),
       em AS MATERIALIZED (SELECT qt.doc_id, qt.i, x.tag, x.s FROM qt JOIN (SELECT word, tag, s FROM ws UNION ALL SELECT new.word, sfx.tag, sfx.s FROM new JOIN sfx USING (suffix)) x USING (word)),
       v(doc_id, i, tag, s, path) AS (SELECT em.doc_id, em.i, em.tag, em.s + starts.s, [em.tag] FROM em JOIN starts USING (tag) WHERE em.i = 1
             UNION ALL SELECT v.doc_id, v.i + 1, em.tag, max(v.s + moves.m) + any_value(em.s), arg_max(list_append(v.path, em.tag), v.s + moves.m)
             FROM v JOIN em ON em.doc_id = v.doc_id AND em.i = v.i + 1 JOIN moves ON moves.a = v.tag AND moves.b = em.tag GROUP BY v.doc_id, v.i, em.tag),
       best AS (SELECT doc_id, arg_max(path, (i, s)) AS path FROM v GROUP BY doc_id)
       SELECT q.doc_id, coalesce(array_to_string(path, ' '), '') AS tags FROM q LEFT JOIN best USING (doc_id)""",
)
def x_tagged_words(spark, root):
    tagger = tagging.learn_tags(_tagged_documents(spark, root))
    found = tagging.tagged_tokens(_turn_words(spark, root), tagger)
    return found.select("doc_id", F.array_join(F.transform("words", lambda w: w["tag"]), " ").alias("tags"))


# Classes of turns by weights that the tables give: how much oftener a word is in a language's documents.


@query(
    "t_weighed",
    f"""WITH e AS MATERIALIZED (SELECT lang AS label, w AS feature, count(*) AS n FROM (SELECT lang, unnest({_LETTERS.format(text='text')}) AS w FROM documents WHERE lang IS NOT NULL) GROUP BY lang, w),
       labels AS (SELECT label, ln(count(*)) AS b FROM (SELECT lang AS label FROM documents WHERE lang IS NOT NULL) GROUP BY label),
       q AS MATERIALIZED (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_LETTERS.format(text='text')}) AS w FROM conversations) GROUP BY conv_id, turn, w),
       z AS (SELECT q.conv_id, q.turn, labels.label, any_value(labels.b) + coalesce(sum(q.n * 0.01 * ln(1 + e.n)), 0) AS z FROM q JOIN labels ON true LEFT JOIN e ON e.feature = q.w AND e.label = labels.label GROUP BY q.conv_id, q.turn, labels.label),
       s AS (SELECT conv_id, turn, label, exp(z - max(z) OVER (PARTITION BY conv_id, turn)) AS x FROM z)
       SELECT conv_id, turn, arg_max(label, x) AS label, round(max(x) / sum(x), 6) AS confidence FROM s GROUP BY conv_id, turn""",
)
def t_weighed(spark, root):
    docs = texts(spark, root).filter("lang is not null")
    weights = docs.select(F.col("lang").alias("label"), F.explode(languages.letter_words(F.col("text"))).alias("feature")).groupBy("feature", "label").count()
    weights = weights.select("feature", "label", (F.log(1 + F.col("count")) * 0.01).alias("weight"))
    intercepts = docs.groupBy(F.col("lang").alias("label")).agg(F.log(F.count(F.lit(1))).alias("intercept"))
    features = read_table(spark, root, "conversations").select("conv_id", "turn", F.explode(languages.letter_words(F.col("text"))).alias("feature")).groupBy("conv_id", "turn", "feature").agg(F.count(F.lit(1)).alias("n"))
    best = F.array_max(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    return classify.weighed(features, weights, intercepts, ["conv_id", "turn"]).select("conv_id", "turn", best["label"].alias("label"), F.round(best["p"], 6).alias("confidence"))


@query("t_classified")
def t_classified(spark, root):
    """Turns by the language of their words, from a model of the documents' lines."""
    lines = texts(spark, root).filter("lang is not null").select(F.col("lang").alias("label"), F.explode(F.split("text", "\n")).alias("sentence"))
    classes = classify.fit_classes(lines, how=classify.Fitting(cells=1 << 12, steps=8))
    turns = read_table(spark, root, "conversations").select("conv_id", "turn", F.col("text").alias("sentence"))
    best = F.array_max(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    return classify.classified(turns, classes).select("conv_id", "turn", best["label"].alias("label"), F.round(best["p"], 3).alias("confidence"))


# An index of vectors.


@query("v_index_topk")
def v_index_topk(spark, root):
    """The 30 chunks most alike to each of a stated set of chunks, by inverted lists and codes; recall is measured in a test."""
    chunks = read_table(spark, root, "embeddings")
    index = vector_index.build_index(chunks, f"{run_folder(spark)}/vectors-{uuid.uuid4().hex}", kept=["label"])
    asked = chunks.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search_vectors(index, asked, 30).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "place")
