"""All queries of the engine by name, with the DuckDB SQL that gives the same rows.

The tables at hand stand in for decision records: `corpus` adds a date, norms, descriptors and a
result to `documents`, each by one expression that both engines share in meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import legal, passages, phrases, text
from corpusloom.operators import answers, clustering, facets, joins, ranking, search, selection, stats, vectors
from corpusloom.sources import records
from corpusloom.sources.staging import stored
from corpusloom.sources.tables import read_table, spread
from corpusloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NORMS = ("CO.336c.al1.letb", "LPAC.20", "Cst.29.al2", "LPA.46", "LPAC.22")
WORDS = ("POLICE", "MOTIF", "NOTIFICATION", "DELAI")
RESULTS = ("REJETE", "ADMIS", "")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use {corpus}, {tokens} and {padded}."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.replace("{corpus}", CORPUS).replace("{tokenized}", TOKENIZED).replace("{elements}", ELEMENTS).replace("{padded}", PADDED)
        return f

    return add


def _duck(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INTEGER) + 1]"


CORPUS = f"""(SELECT doc_id, text, lang, source, n_chars,
  DATE '2000-01-01' + CAST((doc_id * 37) % 8766 AS INTEGER) AS decision_date,
  {_duck(NORMS, 'doc_id % 5')} || ';' || {_duck(NORMS, '(doc_id + 2) % 5')} AS standards,
  {_duck(WORDS, 'doc_id % 4')} || ';' || {_duck(WORDS, '(doc_id + 1) % 4')} AS descriptors,
  {_duck(RESULTS, 'doc_id % 3')} AS result FROM documents)"""
TOKENIZED = "(SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens FROM documents)"
PADDED = "(SELECT *, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS p FROM " + CORPUS + ")"
ELEMENTS = "(SELECT vec_id AS doc_id, label AS cluster_id, CAST(embedding[1] AS DOUBLE) AS pos_x, CAST(embedding[2] AS DOUBLE) AS pos_y FROM embeddings)"


def corpus(spark: SparkSession, root: str) -> DataFrame:
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    k = F.col("doc_id")
    return texts(spark, root).withColumns(
        {
            "decision_date": F.date_add(F.lit(date(2000, 1, 1)), F.pmod(k * 37, F.lit(8766)).cast("int")),
            "standards": F.concat_ws(";", pick(NORMS, k), pick(NORMS, k + 2)),
            "descriptors": F.concat_ws(";", pick(WORDS, k), pick(WORDS, k + 1)),
            "result": pick(RESULTS, k),
        }
    )


def tokenized(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select("doc_id", "lang", text.index_tokens(F.col("text")).alias("tokens"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """`documents` over all cores, for queries that work on whole texts."""
    return spread(read_table(spark, root, "documents"), "doc_id")


def elements(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("embedding")
    return read_table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"), F.get(e, F.lit(0)).cast("double").alias("pos_x"), F.get(e, F.lit(1)).cast("double").alias("pos_y"))


def choice(spark: SparkSession, root: str) -> DataFrame:
    """Three-valued selection: quality 1 is yes, 0 is no, no label is maybe."""
    labels = read_table(spark, root, "labels")
    docs = read_table(spark, root, "documents").select("doc_id", "lang")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("to_display"), (F.col("lang") == "en").alias("is_initial"), (F.col("quality") == 1).alias("is_check"))


CHOICE = "(SELECT doc_id, coalesce(toxic = 0, true) AS to_display, lang = 'en' AS is_initial, quality = 1 AS is_check FROM documents LEFT JOIN labels USING (doc_id))"


# Boolean search.


@query("q_bool_and", "SELECT doc_id, source FROM {padded} WHERE (contains(p, ' this ') OR contains(p, ' with ')) AND contains(p, ' from ')")
def q_bool_and(spark, root):
    return search.matching(corpus(spark, root), "(this OR with) AND from").select("doc_id", "source")


@query("q_bool_or_not_hoist", "SELECT doc_id FROM {padded} WHERE (contains(p, ' this ') OR contains(p, ' with ')) AND NOT contains(p, ' ble ')")
def q_bool_or_not_hoist(spark, root):
    return search.matching(corpus(spark, root), "this OR with NOT ble").select("doc_id")


@query("q_bool_left_to_right", "SELECT doc_id FROM {padded} WHERE (contains(p, ' this ') OR contains(p, ' with ')) AND contains(p, ' from ') AND NOT contains(p, ' of the ')")
def q_bool_left_to_right(spark, root):
    return search.matching(corpus(spark, root), 'this OR with AND from NOT "of the"').select("doc_id")


@query("q_phrase", "SELECT doc_id FROM {padded} WHERE contains(p, ' of the ')")
def q_phrase(spark, root):
    return search.matching(corpus(spark, root), '"of the"').select("doc_id")


@query("q_date_range", "SELECT doc_id, decision_date FROM {padded} WHERE decision_date BETWEEN DATE '2005-01-01' AND DATE '2015-12-31' AND contains(p, ' the ')")
def q_date_range(spark, root):
    return search.matching(corpus(spark, root), "the", date(2005, 1, 1), date(2015, 12, 31), day="decision_date").select("doc_id", "decision_date")


@query("q_count_by_source", "SELECT source, count(*) AS n FROM {padded} WHERE contains(p, ' und ') OR contains(p, ' et ') GROUP BY source")
def q_count_by_source(spark, root):
    return search.matching(corpus(spark, root), "und OR et").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("q_preview", "SELECT count(*) AS total, count(*) >= 20 AS can_cluster, count(*) > 0 AS can_continue FROM {padded} WHERE contains(p, ' para ')")
def q_preview(spark, root):
    return search.preview(corpus(spark, root), "para")


def _bm25(terms: tuple[str, ...], where: str) -> str:
    tf = ", ".join(f"len(list_filter(tokens, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(terms)))
    return f"""WITH t AS (SELECT doc_id, tokens, len(tokens) AS dl, {tf} FROM {{tokenized}} WHERE len(tokens) >= 0),
      s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM t)
      SELECT doc_id, round({part}, 6) AS score FROM t, s WHERE {where} ORDER BY {part} DESC, doc_id LIMIT 20"""


@query("q_bm25_top20", _bm25(("this", "with", "from"), "(tf0 > 0 OR tf1 > 0) AND tf2 > 0 AND NOT list_contains(tokens, 'ble')"))
def q_bm25_top20(spark, root):
    hits = search.scored(corpus(spark, root), "(this OR with) AND from NOT ble")
    return search.top(hits, 20).select("doc_id", F.round("score", 6).alias("score"))


@query("q_history", "SELECT o_orderkey AS project_id, o_orderpriority AS query FROM orders WHERE regexp_matches(o_orderpriority, '(?i)urg') ")
def q_history(spark, root):
    projects = read_table(spark, root, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderpriority").alias("query"))
    return search.history(projects, ["URG"])


# Facets.

FACETS = {
    "Norm": facets.pattern("standards"),
    "Descriptor": facets.pattern("descriptors"),
    "Result": facets.result("result"),
    "chamber": facets.equals("source"),
    "year_range": facets.years("decision_date"),
    "Keyword": facets.pattern("text"),
}


@query(
    "u_union_intersect_exclude",
    """SELECT doc_id FROM {corpus} WHERE ((standards ILIKE '%LPAC_20%' AND (result = '' OR result = 'ADMIS'))
      OR (source = 'src1' AND decision_date BETWEEN DATE '2003-01-01' AND DATE '2010-12-31')) AND NOT (descriptors ILIKE '%police%')""",
)
def u_union_intersect_exclude(spark, root):
    chosen = {
        "filter-union-0": {"Norm": ["LPAC.20"], "Result": ["NO RESULT", "ADMIS"]},
        "filter-union-1": {"chamber": ["src1"], "year_range": ["2003-2010"]},
        "filter-exclude-0": {"Descriptor": ["police"]},
    }
    return facets.filtered(corpus(spark, root), chosen, FACETS).select("doc_id")


@query("u_empty_facet_ignored", "SELECT doc_id FROM {corpus} WHERE result = 'REJETE'")
def u_empty_facet_ignored(spark, root):
    return facets.filtered(corpus(spark, root), {"filter-union-0": {"Norm": ["XYZ.1"], "Result": ["REJETE"]}}, FACETS).select("doc_id")


@query("u_facet_options", "SELECT DISTINCT trim(unnest(string_split(descriptors, ';'))) AS value FROM {corpus}")
def u_facet_options(spark, root):
    return facets.options(corpus(spark, root), "descriptors")


@query(
    "u_clustered_base",
    "SELECT d.doc_id FROM documents d WHERE (SELECT count(*) FROM documents) < 20 OR d.doc_id IN (SELECT vec_id FROM embeddings)",
)
def u_clustered_base(spark, root):
    return facets.with_clusters_only(read_table(spark, root, "documents"), elements(spark, root), 20, True).select("doc_id")


# Lookups.


@query("j_score_left_join", "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), CAST('-inf' AS DOUBLE)) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def j_score_left_join(spark, root):
    scores = read_table(spark, root, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return joins.with_scores(read_table(spark, root, "documents").select("doc_id"), scores)


@query("j_topic_scores", "SELECT vec_id AS doc_id, 'topic ' || label AS topic, 100.0 * CAST(quality AS DOUBLE) AS percent FROM embeddings JOIN labels ON vec_id = doc_id")
def j_topic_scores(spark, root):
    e = elements(spark, root)
    clusters = e.select("cluster_id").distinct().withColumn("topic", F.concat(F.lit("topic "), F.col("cluster_id").cast("string")))
    return joins.topic_scores(e, clusters, read_table(spark, root, "labels").select("doc_id", F.col("quality").cast("double").alias("prob")))


@query("j_overlap_conflicts", "SELECT doc_id, quality AS left_value, toxic AS right_value FROM labels WHERE quality IS DISTINCT FROM toxic OR quality IS NULL")
def j_overlap_conflicts(spark, root):
    labels = read_table(spark, root, "labels")
    return joins.conflicts(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query(
    "j_rekey_last_wins",
    """SELECT p_type AS decision_type, arg_max(p_partkey, p_partkey) AS record_key, count(*) AS n,
       CAST(arg_max(p_partkey, p_partkey) AS VARCHAR) || '|s|' || p_size AS chunk_id FROM part GROUP BY p_type, p_size""",
)
def j_rekey_last_wins(spark, root):
    part = read_table(spark, root, "part")
    names = part.select("p_type", "p_size", "p_partkey").withColumn("decision_type", F.concat_ws("#", "p_type", F.col("p_size").cast("string"))).withColumn("record_key", F.col("p_partkey").cast("string"))
    vecs = part.groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).withColumns({"decision_type": F.concat_ws("#", "p_type", F.col("p_size").cast("string")), "section": F.lit("s"), "position": F.col("p_size")})
    out = joins.rekeyed(vecs, names, "p_partkey")
    return out.select(F.col("p_type").alias("decision_type"), F.col("record_key").cast("long").alias("record_key"), "n", "chunk_id")


@query("j_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_missing(spark, root):
    return joins.missing(read_table(spark, root, "documents").select("doc_id"), read_table(spark, root, "labels"))


@query(
    "r_knn10",
    """SELECT doc_id, neighbour, round(d2, 9) AS d2, place FROM (SELECT q.doc_id, p.doc_id AS neighbour,
        pow(p.pos_x - q.pos_x, 2) + pow(p.pos_y - q.pos_y, 2) AS d2,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY pow(p.pos_x - q.pos_x, 2) + pow(p.pos_y - q.pos_y, 2), p.doc_id) AS place
      FROM {elements} p JOIN {elements} q ON p.doc_id <> q.doc_id WHERE q.doc_id % 20 = 0) WHERE place <= 10""",
)
def r_knn10(spark, root):
    e = elements(spark, root)
    out = joins.nearest_points(e, e.filter("doc_id % 20 = 0"))
    return out.select("doc_id", "neighbour", F.round("d2", 9).alias("d2"), F.col("place").cast("long").alias("place"))


# Counts and summaries.


@query("g_cluster_counts", "SELECT r_regionkey AS cluster_id, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def g_cluster_counts(spark, root):
    clusters = read_table(spark, root, "region").select(F.col("r_regionkey").alias("cluster_id"))
    return stats.cluster_counts(clusters, read_table(spark, root, "nation").select(F.col("n_regionkey").alias("cluster_id"), F.col("n_nationkey").alias("doc_id")))


@query("g_centroids", "SELECT cluster_id, round(avg(pos_x), 6) AS mean_x, round(avg(pos_y), 6) AS mean_y, count(*) AS n FROM {elements} GROUP BY cluster_id")
def g_centroids(spark, root):
    return stats.centroids(elements(spark, root)).withColumns({c: F.round(c, 6) for c in ("mean_x", "mean_y")})


@query("g_status_counters", f"SELECT count(*) FILTER (is_check) AS chosen, count(*) FILTER (is_initial) AS initial, count(*) FILTER (to_display AND NOT is_initial) AS neighbours, count(*) FILTER (to_display) AS visible FROM {CHOICE}")
def g_status_counters(spark, root):
    return stats.selection_counts(choice(spark, root))


@query("g_group_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def g_group_count(spark, root):
    return read_table(spark, root, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("g_terms_agg_nested", "SELECT value, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split(standards, ';')) AS value FROM {corpus}) GROUP BY value")
def g_terms_agg_nested(spark, root):
    return stats.term_counts(corpus(spark, root), "doc_id", text.multi_values(F.col("standards")))


@query("g_distinct_keys", "SELECT count(DISTINCT nullif(result, '')) AS n FROM {corpus}")
def g_distinct_keys(spark, root):
    return stats.distinct_keys(corpus(spark, root), "result")


@query("g_token_lengths", "SELECT CAST(max(greatest(1, length(text) // 4)) AS BIGINT) AS longest, count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> ''")
def g_token_lengths(spark, root):
    return stats.token_lengths(read_table(spark, root, "documents"), "text", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long"))


@query("g_score_summary", "SELECT round_even(avg(l_discount), 3) AS mean, round_even(median(l_discount), 3) AS median, round_even(stddev_samp(l_discount), 3) AS deviation, round_even(100 * avg(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 2) AS percent FROM lineitem")
def g_score_summary(spark, root):
    return stats.score_summary(read_table(spark, root, "lineitem"), "l_discount", 0.05)


@query(
    "g_polar_stats",
    "SELECT " + ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{x}, round_even(100.0 * count(*) FILTER (lang = '{x}') / count(*), 2) AS p_{x}" for x in ("en", "fr", "de")) + ", count(*) AS total FROM documents",
)
def g_polar_stats(spark, root):
    return stats.polar_answers(read_table(spark, root, "documents"), "lang", ("en", "fr", "de"))


@query(
    "g_consideration_support",
    """WITH r AS (SELECT doc_id, source AS consideration, coalesce(quality = 1, false) AS supported FROM documents JOIN labels USING (doc_id)),
       f AS (SELECT consideration, count(*) FILTER (supported) AS frequency FROM r GROUP BY consideration)
       SELECT consideration, frequency, s.doc_id FROM f LEFT JOIN (SELECT DISTINCT consideration, doc_id FROM r WHERE supported) s USING (consideration)""",
)
def g_consideration_support(spark, root):
    return stats.consideration_support(support_rows(spark, root))


def support_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents").join(read_table(spark, root, "labels"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("consideration"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("supported"))


@query("g_progress", "SELECT o_orderstatus, CAST(trunc(100.0 * count(*) FILTER (o_totalprice > 100000) / count(*)) AS INTEGER) AS percent FROM orders GROUP BY o_orderstatus")
def g_progress(spark, root):
    rows = read_table(spark, root, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("done"), F.count(F.lit(1)).alias("n"))
    return rows.select("o_orderstatus", stats.progress(F.col("done"), F.col("n")).alias("percent"))


@query("g_noise_summary", "SELECT count(*) FILTER (label = 0) AS noise, round_even(100.0 * count(*) FILTER (label = 0) / count(*), 2) AS percent, count(DISTINCT nullif(label, 0)) AS clusters FROM embeddings")
def g_noise_summary(spark, root):
    return stats.noise_summary(elements(spark, root).withColumn("cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id"))))


@query("g_corpus_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM {tokenized}) GROUP BY term")
def g_corpus_terms(spark, root):
    return stats.corpus_counts(tokenized(spark, root))


# Orders, pages, ranks.


@query("r_topk_per_cluster", "SELECT cluster_id, doc_id, round(pos_x, 6) AS pos_x, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos_x DESC, doc_id) AS place FROM {elements}) WHERE place <= 10")
def r_topk_per_cluster(spark, root):
    return ranking.top_per_group(elements(spark, root), "cluster_id", "pos_x", 10).select("cluster_id", "doc_id", F.round("pos_x", 6).alias("pos_x"), F.col("place").cast("long").alias("place"))


@query(
    "r_representative",
    """SELECT cluster_id, doc_id, round(d, 6) AS distance FROM (SELECT e.*, sqrt(pow(pos_x - cx, 2) + pow(pos_y - cy, 2)) AS d FROM {elements} e
       JOIN (SELECT cluster_id, avg(pos_x) AS cx, avg(pos_y) AS cy FROM {elements} GROUP BY cluster_id) USING (cluster_id))
       QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY d, doc_id) = 1""",
)
def r_representative(spark, root):
    return ranking.representatives(elements(spark, root)).withColumn("distance", F.round("distance", 6))


@query(
    "r_cluster_order",
    """SELECT cluster_id, topic, n, CASE WHEN topic = 'unclassified papers' THEN -1 ELSE row_number() OVER (PARTITION BY topic = 'unclassified papers' ORDER BY n DESC, topic, cluster_id) END AS "order"
       FROM (SELECT label AS cluster_id, CASE WHEN label = 0 THEN 'unclassified papers' ELSE 'topic ' || label END AS topic, count(*) AS n FROM embeddings GROUP BY label)""",
)
def r_cluster_order(spark, root):
    topic = F.when(F.col("cluster_id") == 0, ranking.NOISE_TOPIC).otherwise(F.concat(F.lit("topic "), F.col("cluster_id").cast("string")))
    rows = elements(spark, root).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"topic": topic, "project_id": F.lit(1)})
    return ranking.cluster_order(rows).select("cluster_id", "topic", "n", F.col("order").cast("long").alias("order"))


@query(
    "r_page",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 30",
)
def r_page(spark, root):
    return ranking.page(read_table(spark, root, "documents").select("doc_id", "n_chars"), 2, [F.desc("n_chars"), F.asc("doc_id")])


@query("r_history_sort", "SELECT c_custkey AS project_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def r_history_sort(spark, root):
    counts = read_table(spark, root, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.by_history(read_table(spark, root, "customer").select(F.col("c_custkey").alias("project_id")), counts, True)


@query("r_iteration_snapshot", f"SELECT doc_id, CASE WHEN is_check THEN 'yes' WHEN NOT is_check THEN 'no' ELSE 'maybe' END AS state, is_initial, to_display FROM {CHOICE}")
def r_iteration_snapshot(spark, root):
    return selection.snapshot(choice(spark, root))


@query(
    "r_snapshot_counts",
    f"""SELECT count(*) FILTER (is_check) AS yes, count(*) FILTER (NOT is_check) AS no, count(*) FILTER (is_check IS NULL) AS maybe,
        count(*) FILTER (is_initial) AS initial, count(*) FILTER (to_display) AS shown FROM {CHOICE}""",
)
def r_snapshot_counts(spark, root):
    return selection.snapshot_counts(selection.snapshot(choice(spark, root)))


@query(
    "r_iterate",
    f"""WITH c AS {CHOICE}, e AS {{elements}}, near AS (SELECT doc_id FROM (SELECT p.doc_id, row_number() OVER (PARTITION BY q.doc_id
          ORDER BY pow(p.pos_x - q.pos_x, 2) + pow(p.pos_y - q.pos_y, 2), p.doc_id) AS place FROM e p JOIN e q ON p.doc_id <> q.doc_id JOIN c ON c.doc_id = q.doc_id AND is_check) WHERE place <= 10)
        SELECT doc_id, to_display AND coalesce(is_check, true) AS to_display, is_initial, is_check FROM c
        UNION ALL SELECT DISTINCT doc_id, true, false, CAST(NULL AS BOOLEAN) FROM near WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
)
def r_iterate(spark, root):
    none = spark.createDataFrame([], "doc_id long")
    return selection.iterated(choice(spark, root), elements(spark, root), none)[0]


@query(
    "r_topic_labels",
    """WITH t AS (SELECT doc_id, unnest(tokens) AS term FROM {tokenized}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
       df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS docs FROM documents),
       raw AS (SELECT doc_id, term, tf * (ln((1.0 + docs) / (1.0 + df)) + 1) AS r FROM tf JOIN df USING (term), n),
       w AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS tfidf FROM raw),
       e AS (SELECT vec_id AS doc_id, label AS cluster_id FROM embeddings), size AS (SELECT cluster_id, count(*) AS size FROM e GROUP BY cluster_id),
       m AS (SELECT cluster_id, term, round(sum(tfidf) / any_value(size), 9) AS weight FROM w JOIN e USING (doc_id) JOIN size USING (cluster_id) GROUP BY cluster_id, term),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS place FROM m)
       SELECT cluster_id, string_agg(term, ', ' ORDER BY place) AS topic FROM ranked WHERE place <= 30 GROUP BY cluster_id""",
)
def r_topic_labels(spark, root):
    return ranking.topic_labels(phrases.tfidf(tokenized(spark, root)), elements(spark, root).select("doc_id", "cluster_id"))


# Words, phrases, weights.


@query("x_tokens", "SELECT doc_id, array_to_string(list_filter(tokens, lambda t: length(t) BETWEEN 2 AND 15), ' ') AS tokens FROM {tokenized}")
def x_tokens(spark, root):
    return texts(spark, root).select("doc_id", F.array_join(text.simple_tokens(F.col("text")), " ").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS_FR)


@query("x_stopwords", f"SELECT doc_id, array_to_string(list_filter(tokens, lambda t: NOT list_contains([{_STOP}], t)), ' ') AS words FROM {{tokenized}}")
def x_stopwords(spark, root):
    return tokenized(spark, root).select("doc_id", F.array_join(text.without(F.col("tokens"), text.STOP_WORDS_FR), " ").alias("words"))


_PROFILE = ", ".join(f"len(list_filter(tokens, lambda t: list_contains([{', '.join(repr(w) for w in ws)}], t))) AS n_{lang}" for lang, ws in text.PROFILES.items())


def _cleaned(text_: str) -> str:
    """The cleaning passes in DuckDB, whose patterns have neither back-references nor Unicode blanks of their own."""
    blank = "[\\t-\\r \\x{85}\\p{Z}]"
    full = blank.replace("[", "[^", 1)
    out = text_
    for pattern, put in ((f"{full}*@{full}*{blank}?", ""), (f"{blank}+", " "), ("_", ""), (f"https?://{full}+", ""), (f"www\\.*[\\r\\n]*{full}+", "")):
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    for c in " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out = f"regexp_replace({out}, '{c}{{3,}}', '{c}{c}', 'g')"
    return out


@query(
    "x_clean",
    f"""SELECT doc_id, nullif(array_to_string(list_filter(regexp_extract_all(lower({_cleaned('text')}), '[\\p{{L}}\\p{{N}}_]+'),
        lambda t: length(t) BETWEEN 2 AND 15 AND NOT list_contains([{_STOP}], t)), ' '), '') AS cleaned FROM documents""",
)
def x_clean(spark, root):
    return texts(spark, root).select("doc_id", text.clean_document(F.col("text"), text.STOP_WORDS_FR).alias("cleaned"))


@query(
    "x_language",
    f"SELECT doc_id, CASE WHEN greatest(n_fr, n_de, n_it, n_en) = 0 THEN NULL WHEN n_fr >= greatest(n_de, n_it, n_en) THEN 'fr' WHEN n_de >= greatest(n_it, n_en) THEN 'de' WHEN n_it >= n_en THEN 'it' END AS found FROM (SELECT doc_id, {_PROFILE} FROM {{tokenized}})",
)
def x_language(spark, root):
    return texts(spark, root).select("doc_id", text.detected_language(F.col("text")).alias("found"))


def _merging(source: str, step: str) -> str:
    """CTEs of one pass of phrase merging: pairs{step}, pmi{step} and words{step} (doc_id, i, w), from such words."""
    return f"""seq{step} AS MATERIALIZED (SELECT doc_id, row_number() OVER o AS i, w AS a, lead(w) OVER o AS b FROM {source} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
       uni{step} AS MATERIALIZED (SELECT a AS w, count(*) AS n FROM seq{step} GROUP BY a), size{step} AS MATERIALIZED (SELECT count(*) AS nw, count(b) AS np FROM seq{step}),
       pairs{step} AS MATERIALIZED (SELECT a, b, count(*) AS n FROM seq{step} WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
       pmi{step} AS MATERIALIZED (SELECT * FROM (SELECT p.a, p.b, p.n, (CAST(p.n AS DOUBLE) / np) / ((CAST(x.n AS DOUBLE) / nw) * (CAST(y.n AS DOUBLE) / nw)) AS ratio
         FROM pairs{step} p JOIN uni{step} x ON x.w = p.a JOIN uni{step} y ON y.w = p.b, size{step}) WHERE ratio >= 2),
       hits{step} AS MATERIALIZED (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM seq{step} SEMI JOIN pmi{step} USING (a, b)),
       kept{step} AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM hits{step}) WHERE k % 2 = 1),
       words{step} AS MATERIALIZED (SELECT s.doc_id, s.i, CASE WHEN k.i IS NULL THEN s.a ELSE s.a || '_' || s.b END AS w FROM seq{step} s
         LEFT JOIN kept{step} k ON k.doc_id = s.doc_id AND k.i = s.i LEFT JOIN kept{step} t ON t.doc_id = s.doc_id AND t.i = s.i - 1 WHERE t.i IS NULL)"""


_WORDS = "words0 AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM {tokenized})"


@query("x_bigram_pmi", f"WITH {_WORDS}, {_merging('words0', '1')} SELECT a, b, n, round(log2(ratio), 4) AS pmi FROM pmi1")
def x_bigram_pmi(spark, root):
    return phrases.pmi_bigrams(tokenized(spark, root)).withColumn("pmi", F.round("pmi", 4))


@query(
    "x_ngram_merge",
    f"""WITH {_WORDS}, {_merging('words0', '1')}, {_merging('words1', '2')}, text AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM words2 GROUP BY doc_id)
       SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN text USING (doc_id)""",
)
def x_ngram_merge(spark, root):
    return phrases.ngrams(tokenized(spark, root)).select("doc_id", F.array_join("tokens", " ").alias("words"))


@query(
    "x_df_prune",
    """WITH t AS (SELECT doc_id, tokens, len(tokens) AS n FROM {tokenized}), w AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS i FROM t),
       df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term), v AS (SELECT term FROM df WHERE length(term) >= 2 AND df >= 2 AND df <= 0.7 * (SELECT count(*) FROM documents)),
       k AS (SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS words FROM w SEMI JOIN v USING (term) GROUP BY doc_id)
       SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN k USING (doc_id)""",
)
def x_df_prune(spark, root):
    docs = tokenized(spark, root)
    return phrases.pruned(docs, phrases.vocabulary(docs)).select("doc_id", F.array_join("tokens", " ").alias("words"))


@query(
    "x_tfidf",
    """WITH t AS (SELECT doc_id, unnest(tokens) AS term FROM {tokenized}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
       df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS r FROM tf JOIN df USING (term))
       SELECT doc_id, term, tf, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM raw""",
)
def x_tfidf(spark, root):
    return phrases.tfidf(tokenized(spark, root)).withColumn("tfidf", F.round("tfidf", 6))


# Sentences, sections, citations.


@query("t_after_marker", "SELECT doc_id, CASE WHEN position('the' IN text) > 0 THEN regexp_replace(substr(text, position('the' IN text) + 3), '^\\n+', '') ELSE text END AS tail FROM documents")
def t_after_marker(spark, root):
    return texts(spark, root).select("doc_id", text.after_marker(F.col("text"), "the").alias("tail"))


@query("t_sentences")
def t_sentences(spark, root):
    return texts(spark, root).select("doc_id", F.posexplode(passages.merged_sentence_array(F.col("text"))).alias("place", "sentence"))


@query("t_chunks")
def t_chunks(spark, root):
    return texts(spark, root).select("doc_id", F.posexplode(passages.chunk_array(F.col("text"))).alias("place", "chunk"))


@query(
    "t_coarse_sentences",
    """SELECT doc_id, len(list_filter(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n FROM documents""",
)
def t_coarse_sentences(spark, root):
    return texts(spark, root).select("doc_id", F.size(text.coarse_sentences(F.col("text"))).cast("long").alias("n"))


@query(
    "t_islands",
    """SELECT doc_id, section, min(id) AS first_id, count(*) AS n, string_agg(sentence, chr(10) ORDER BY id) AS text FROM
       (SELECT conv_id AS doc_id, role AS section, turn AS id, text AS sentence, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations)
       GROUP BY doc_id, section, island""",
)
def t_islands(spark, root):
    rows = read_table(spark, root, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("section"), F.col("turn").alias("id"), F.col("text").alias("sentence"))
    return passages.section_runs(rows).withColumn("n", F.col("n").cast("long"))


@query(
    "t_norm_refs",
    """SELECT doc_id, token, CASE token WHEN 'CO.336c.al1.letb' THEN 'CO art. 336c al. 1 let. b' WHEN 'Cst.29.al2' THEN 'Cst art. 29 al. 2' ELSE replace(token, '.', ' art. ') END AS label,
       CASE token WHEN 'CO.336c.al1.letb' THEN 'https://www.fedlex.admin.ch/eli/cc/27/317_321_377/fr#art_336c' WHEN 'Cst.29.al2' THEN 'https://www.fedlex.admin.ch/eli/cc/1999/404/fr#art_29'
         WHEN 'LPA.46' THEN 'https://silgeneve.ch/legis/data/rsg_e5_10.htm' ELSE 'https://silgeneve.ch/legis/data/rsg_b5_05.htm' END AS url
       FROM (SELECT doc_id, unnest(string_split(standards, ';')) AS token FROM {corpus})""",
)
def t_norm_refs(spark, root):
    return corpus(spark, root).select("doc_id", F.explode(legal.norms(F.col("standards"))).alias("n")).select("doc_id", "n.token", "n.label", "n.url")


# Vectors and clusters.

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(
    "v_cosine_topk",
    f"""SELECT query_id, vec_id, round(s, 6) AS similarity, place FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS s,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')}, 9) DESC, e.vec_id) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE place <= 5""",
)
def v_cosine_topk(spark, root):
    e = read_table(spark, root, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    out = vectors.nearest_of_each(e, queries, 5)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query(
    "v_section_top8",
    f"""WITH s AS (SELECT vec_id AS chunk_id, vec_id // 50 AS record_key, label AS section, {_COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS s FROM embeddings),
        d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY s DESC, chunk_id) <= 10)
        SELECT chunk_id, record_key, section, round(s, 6) AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY record_key, section ORDER BY s DESC, chunk_id) <= 8""",
)
def v_section_top8(spark, root):
    e = read_table(spark, root, "embeddings")
    first = e.filter("vec_id = 0").first()["embedding"]
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 50).alias("record_key"), F.col("label").alias("section"), "embedding")
    return vectors.section_best(chunks, first).select("chunk_id", "record_key", "section", F.round("similarity", 6).alias("similarity"))


@query("v_clusters")
def v_clusters(spark, root):
    weights = phrases.weighed_terms(tokenized(spark, root)).withColumnRenamed("raw", "tfidf")  # vectors are brought to length 1 anyway
    points = stored(clustering.document_vectors(weights, 64), "vectors")
    return clustering.kmeans(points, clustering.Trial(8, 64)).withColumn("prob", F.round("prob", 6))


@query("v_embedded")
def v_embedded(spark, root):
    rows = vectors.embedded(read_table(spark, root, "benchmark"), "text", vectors.hashed_embedding(16))
    return rows.select("item_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


# Answers, caches, versions.


@query("a_keys", "SELECT doc_id, sha256('which?::' || doc_id) AS key FROM documents")
def a_keys(spark, root):
    return read_table(spark, root, "documents").select("doc_id", text.answer_key(F.lit(" which? "), F.col("doc_id")).alias("key"))


@query("a_cache_misses", "SELECT doc_id, sha256('which?::' || doc_id) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a_cache_misses(spark, root):
    cache = read_table(spark, root, "labels").select(text.answer_key(F.lit("which?"), F.col("doc_id")).alias("key"))
    return answers.cache_misses(read_table(spark, root, "documents").select("doc_id"), "which?", cache)


@query("a_sanitize", "SELECT doc_id, replace(text, chr(0), '') AS text FROM documents")
def a_sanitize(spark, root):
    return texts(spark, root).select("doc_id", text.without_nul(F.col("text")).alias("text"))


@query(
    "a_incremental",
    """WITH d AS (SELECT doc_id, n_chars, decision_date FROM {corpus}), old AS (SELECT doc_id, n_chars FROM d WHERE decision_date <= DATE '2012-06-01')
       SELECT * FROM old UNION ALL SELECT doc_id, 10 * n_chars FROM d WHERE decision_date >= DATE '2010-01-01' AND doc_id NOT IN (SELECT doc_id FROM old)""",
)
def a_incremental(spark, root):
    return answers.incremental(*versions(spark, root))


@query(
    "a_incremental_legacy",
    """WITH d AS (SELECT doc_id, n_chars, decision_date FROM {corpus})
       SELECT doc_id, n_chars FROM d WHERE decision_date <= DATE '2012-06-01' UNION ALL SELECT doc_id, 10 * n_chars FROM d WHERE decision_date >= DATE '2010-01-01'""",
)
def a_incremental_legacy(spark, root):
    return answers.incremental(*versions(spark, root), legacy=True)


def versions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """An old version of a project and a newer fetch, whose ranges of days overlap and whose lengths differ."""
    docs = corpus(spark, root).select("doc_id", "n_chars", "decision_date")
    old = docs.filter(F.col("decision_date") <= F.lit(date(2012, 6, 1))).select("doc_id", "n_chars")
    return old, docs.filter(F.col("decision_date") >= F.lit(date(2010, 1, 1))).select("doc_id", (10 * F.col("n_chars")).alias("n_chars"))


@query(
    "a_prompt_budget",
    "SELECT source, doc_id, before AS tokens_before FROM (SELECT source, doc_id, coalesce(CAST(sum(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM documents) WHERE before <= 4000",
)
def a_prompt_budget(spark, root):
    rows = read_table(spark, root, "documents").withColumn("tokens", F.floor(F.col("n_chars") / 4).cast("long"))
    return answers.prompt_parts(rows, "source", "doc_id", "tokens", 4000).select("source", "doc_id", "tokens_before")


SAID = ("Réponse non disponible", " No content available. ", "error GENERATING response.", "", "  ", "The appeal is admitted", "no content")
INVALID_SAID = "('', 'réponse non disponible', 'no content available.', 'no content available', 'error generating response.')"


@query("a_invalid", f"SELECT doc_id, lower(trim({_duck(SAID, 'doc_id % 7')})) IN {INVALID_SAID} AS invalid FROM documents")
def a_invalid(spark, root):
    return said(spark, root).select("doc_id", answers.invalid_exact(F.col("answer")).alias("invalid"))


@query(
    "a_invalid_kinds",
    f"SELECT doc_id, starts_with(a, 'No') OR starts_with(a, 'R') AS by_prefix, contains(lower(a), 'error') OR contains(lower(a), 'disponible') AS by_marker FROM (SELECT doc_id, {_duck(SAID, 'doc_id % 7')} AS a FROM documents)",
)
def a_invalid_kinds(spark, root):
    """The two looser ways to tell that an answer says nothing: how it begins, and what it holds."""
    answer = F.col("answer")
    return said(spark, root).select("doc_id", answers.invalid_prefix(answer, ("No", "R")).alias("by_prefix"), answers.invalid_marker(answer, ("Error", "disponible")).alias("by_marker"))


def said(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, answer): valid and invalid answers by turns."""
    return read_table(spark, root, "documents").select("doc_id", F.get(F.array(*[F.lit(x) for x in SAID]), F.pmod("doc_id", F.lit(len(SAID))).cast("int")).alias("answer"))


@query("a_latest", "SELECT o_custkey AS project_id, max(o_orderkey) AS rag_id FROM orders GROUP BY o_custkey")
def a_latest(spark, root):
    rows = read_table(spark, root, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("rag_id"))
    return answers.latest(rows, "project_id", "rag_id")


# Records and events.


@query(
    "s_etl_nested",
    "SELECT CAST(o_orderkey AS VARCHAR) AS record_key, strftime(o_orderdate, '%Y-%m-%d') AS decision_date, count(*) AS n_appeals, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_start FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate",
)
def s_etl_nested(spark, root):
    items = read_table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.date_format("l_shipdate", "dd.MM.yyyy").alias("date_debut"), *[F.lit(None).cast("string").alias(k) for k in records.APPEAL_FIELDS if k != "date_debut"])).alias("recours"))
    raw = read_table(spark, root, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("cle_fiche"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("datedecision"), "recours")
    done = records.normalized(records.translated(raw))
    return done.select("record_key", "decision_date", F.size("appeals").cast("long").alias("n_appeals"), F.array_min(F.transform("appeals", lambda a: a["start_date"])).alias("first_start"))


@query("s_upsert", "SELECT c_custkey AS record_key, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) ELSE c_acctbal END AS amount FROM customer")
def s_upsert(spark, root):
    old = read_table(spark, root, "customer").select(F.col("c_custkey").alias("record_key"), F.col("c_acctbal").alias("amount"))
    new = read_table(spark, root, "orders").select(F.col("o_custkey").alias("record_key"), F.col("o_totalprice").alias("amount"))
    return records.upserted(old, new, order="amount")


@query("s_upsert_counts", "SELECT count(*) FILTER (quality IS NULL) AS created, count(*) FILTER (quality IS NOT NULL) AS overwritten, CAST(0 AS BIGINT) AS without_key FROM documents LEFT JOIN labels USING (doc_id)")
def s_upsert_counts(spark, root):
    return records.upsert_counts(read_table(spark, root, "labels"), read_table(spark, root, "documents"), "doc_id")


@query("s_scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def s_scan_documents(spark, root):
    return read_table(spark, root, "documents").select("doc_id", "lang", "source", "n_chars")


@query("s_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s_event_windows(spark, root):
    return ingest.windowed_counts(read_table(spark, root, "events")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("h_highlight")
def h_highlight(spark, root):
    return texts(spark, root).select("doc_id", text.highlighted(F.col("text"), ("the", "of"), "hit").alias("marked"))


@query("h_topic_options", "SELECT label || ': topic ' || label AS value, 'topic ' || label AS title FROM (SELECT DISTINCT label FROM embeddings)")
def h_topic_options(spark, root):
    from corpusloom.operators import render

    clusters = elements(spark, root).select(F.concat(F.lit("topic "), F.col("cluster_id").cast("string")).alias("topic"), F.col("cluster_id").alias("order")).distinct()
    return render.topic_options(clusters)


@query("j_first_by_type", "SELECT o_orderpriority AS procedure_type, min(o_orderkey) AS doc_id FROM orders GROUP BY o_orderpriority")
def j_first_by_type(spark, root):
    return joins.first_by_type(read_table(spark, root, "orders").select(F.col("o_orderpriority").alias("procedure_type"), F.col("o_orderkey").alias("doc_id")))


@query("r_top_documents", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 10")
def r_top_documents(spark, root):
    scores = read_table(spark, root, "labels").select("doc_id", F.col("quality").alias("score"))
    return ranking.top_documents(read_table(spark, root, "documents").select("doc_id"), scores).select("doc_id", F.coalesce("score", F.lit(-1)).alias("quality"))


@query(
    "q_html_text",
    "SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS n FROM pages",
)
def q_html_text(spark, root):
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+", " ")
    return read_table(spark, root, "pages").select("page_id", F.length(bare).cast("long").alias("n"))


FLAGSHIP = "q_bm25_top20"

from corpusloom import catalog_learning, catalog_workspace  # noqa: E402, F401  (register their queries)
