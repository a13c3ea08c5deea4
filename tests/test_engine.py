"""Facets, records, passages, selections, answers, clusters and streams on small fixtures."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import legal, passages, phrases, text
from corpusloom.operators import answers, clustering, facets, joins, ranking, selection, stats, vectors
from corpusloom.sources import records
from corpusloom.streaming import ingest


@pytest.fixture(scope="module")
def decisions(spark):
    """Permits of a harbour: a permit of year y cites y - 2000 of the rules QX.1 to QX.9, every third has no outcome, every fifth no date."""
    rows = []
    for k in range(1, 13):
        rules = ";".join(f"QX.{j}" for j in range(1, 10) if (k + j) % 4 == 0)
        goods = ";".join(g for j, g in enumerate(["GRAIN", "TIMBER", "SALT FISH", "COAL"]) if (k >> j) & 1)
        rows.append((k, rules or None, goods, [None, "granted", "refused"][k % 3], f"P-{k:03}", None if k % 5 == 0 else date(2000 + k, 1 + k % 12, 3)))
    return spark.createDataFrame(rows, "doc_id int, standards string, descriptors string, result string, decision_type string, day date").withColumn("topic", F.when(F.col("doc_id") % 2 == 0, "harbour, cargo").otherwise("quay, crane"))


FACETS = {"Topic": facets.topic("topic"), "Norm": facets.pattern("standards"), "Result": facets.result("result"), "No": facets.equals("decision_type"), "year_range": facets.years("day"), "D": facets.pattern("descriptors")}


def cites(k, j):
    return (k + j) % 4 == 0


@pytest.mark.parametrize(
    ("chosen", "fits"),
    [
        ({}, lambda k: True),
        ({"filter-union-0": {"Topic": ["4 : Harbour"]}}, lambda k: k % 2 == 0),
        ({"filter-union-0": {"Norm": ["qx.3"]}}, lambda k: cites(k, 3)),
        ({"filter-union-0": {"Norm": ["QX.1", "QX.2"], "year_range": ["2003-2009"]}}, lambda k: (cites(k, 1) or cites(k, 2)) and 3 <= k <= 9 and k % 5),
        ({"filter-union-0": {"D": ["no such"], "year_range": ["2007"]}}, lambda k: k == 7),
        ({"filter-union-0": {"D": ["no such"]}}, lambda k: False),
        ({"filter-union-0": {"No": ["P-004"]}, "filter-union-1": {"Result": ["refused"]}}, lambda k: k == 4 or k % 3 == 2),
        ({"filter-union-0": {"Topic": ["crane"]}, "filter-exclude-0": {"D": ["salt.fish"], "No": ["P-001"]}}, lambda k: k % 2 == 1 and not k & 4 and k != 1),
        ({"filter-exclude-0": {"Norm": ["QX"]}}, lambda k: not any(cites(k, j) for j in range(1, 10))),
    ],
)
def test_facets(decisions, chosen, fits):
    got = sorted(r["doc_id"] for r in facets.filtered(decisions, chosen, FACETS).collect())
    assert got == [k for k in range(1, 13) if fits(k)]


def test_payloads(decisions):
    assert facets.parse_payload({"filter-union-0": '{"a": ["b"]}', "other": '{"a": []}', "filter-x": "{}", "filter-y": "no", "filter-z": ""}) == {"filter-union-0": {"a": ["b"]}}
    assert facets.payload_from_client([("union", "Norm", "x", 0), ("union", "Norm", "y", 0), ("exclude", "D", "z", 1)]) == {"filter-union-0": {"Norm": ["x", "y"]}, "filter-exclude-1": {"D": ["z"]}}
    assert facets.rendered({"filter-union-0": {"a": ["x"], "b": ["y", "z"]}, "filter-exclude-0": {"c": ["w"]}}) == ("(a: x<b> AND </b>b: y<b> AND </b>b: z)", "(c: w)")
    assert 'title="salt, tide">Topic 3</span>' in facets.rendered({"filter-union-0": {"Topic": ["3: salt, tide"]}})[0]
    shown = facets.with_tips("topic 1, Topic 11 <b title='Topic 1'>", {"Topic 1": "one", "Topic 11": "Topic 1"})
    assert shown.count("<span") == 2 and 'title="one">topic 1</span>, ' in shown and 'title="Topic 1">Topic 11</span>' in shown and shown.endswith("<b title='Topic 1'>")
    assert facets.with_tips("a", {}) == "a"
    assert [r["value"] for r in facets.options(decisions.filter("doc_id in (5, 6)"), "descriptors").collect()] == ["GRAIN", "SALT FISH", "TIMBER"]


def test_citations(spark):
    df = spark.createDataFrame([("CO.336c.al1.letb",), ("art. 336c al. 1 let. b CO",), ("Art. 336c OR",), ("LPA.46",), ("XYZ.1",), ("",), (None,)], "t string")
    got = [r["r"] for r in df.select(legal.reference(F.col("t")).alias("r")).collect()]
    assert got[0]["label"] == got[1]["label"] == "CO art. 336c al. 1 let. b"
    assert got[0]["url"] == got[1]["url"] == "https://www.fedlex.admin.ch/eli/cc/27/317_321_377/fr#art_336c"
    assert got[2]["code"] == "OR" and got[2]["article"] == "336c"
    assert got[3]["url"] == "https://silgeneve.ch/legis/data/rsg_e5_10.htm" and got[4]["url"] is None and got[4]["label"] == "XYZ art. 1"
    assert got[5] is None and got[6] is None


def test_records(spark, tmp_path):
    raw = {"cle_fiche": "3265672", "datedecision": "16.05.2023", "normes": "LPA.65", "query": "x", "recours": [{"date_debut": "21.11.2022", "ts_creat": "25/11/22 05:15:32.348287", "chambre": "4", "index": 3}]}
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps(raw) + "\n" + json.dumps({"cle_fiche": "2"}) + "\n")
    df = records.normalized(records.translated(records.read_records(spark, str(path))))
    rows = {r["record_key"]: r for r in df.collect()}
    one = rows["3265672"]
    assert one["decision_date"] == "2023-05-16" and one["standards"] == "LPA.65" and "query" not in df.columns
    assert one["appeals"][0]["start_date"] == "2022-11-21" and one["appeals"][0]["creation_timestamp"] == "2022-11-25 05:15:32.348287" and one["appeals"][0]["chamber"] == "4"
    assert rows["2"]["appeals"] == [] and rows["2"]["decision_date"] is None
    assert records.translated(records.read_records(spark, str(path)), legacy=True).filter("decision_date is not null").count() == 0
    assert records.field_names(spark, str(path)) == ["cle_fiche", "datedecision", "normes", "query", "recours"]
    with pytest.raises(ValueError):
        records.read_records(spark, "a.csv")
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"cle_fiche": "1"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        records.read_records(spark, str(bad)).collect()
    assert records.read_records(spark, str(bad), lenient=True).count() == 1


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "record_key string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5), (None, 6)], "record_key string, v int")
    assert {tuple(r) for r in records.upserted(old, new, order="v").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {tuple(r) for r in records.upserted(old, new, create_only=True, order="v").collect()} == {("a", 1), ("b", 2), ("c", 5)}
    assert records.upsert_counts(old, new).first().asDict() == {"created": 1, "overwritten": 2, "without_key": 1}


def test_feed(spark):
    hits = [
        {"Signatur": "s1", "Spider": "x", "Datum": "2020-01-02", "Num": ["a", "b"], "attachment": {"content": "t"}, "Abstract": [{"Text": "sum"}]},
        {"Signatur": "s2", "Num": "c", "attachment": [{"content": "u"}], "Rechtsgebiet": "field"},
        {"Signatur": "s3", "attachment": {"content": " "}},
        {"attachment": {"content": "v"}},
    ]
    rows = records.feed_records(spark.createDataFrame([(json.dumps(h),) for h in hits], "value string"), "feed").orderBy("record_key").collect()
    assert [(r["record_key"], r["procedure_type"], r["document_text"], r["summary"]) for r in rows] == [("s1", "a;b", "t", "sum"), ("s2", "c", "u", "field")]


def test_passages(spark):
    for blank in (" ", "\n", "\n\n", " \t ", "\\n", "\\t"):
        assert passages.unwrapped(f"deux{blank}mots") == "deux mots"
    assert passages.unwrapped("\\u00e0 5\u00a0km\u00a0; \u00a0 vu") == "\u00e0 5\u00a0km\u00a0; vu"
    assert passages.repaired("\u00e2\u0080\u0099 \u00c3\u00a2 \u00c3") == "\u2019 â à" and passages.repaired("\u00c3\u00a2", legacy=True) == "à\u00a2"
    # Generated clauses: an end in front of a capital, a digit or a quote parts two; what protects or joins does not.
    clauses = [f"{w} {k} {'x' * (1 + k)}" for k, w in enumerate(["Rouge", "Vert", "Bleu", "Gris"])]
    for mark in (".", "!", "?", "..."):
        assert passages.sentences(" ".join(c + mark for c in clauses)) == [c + mark for c in clauses]
    for joined in ("Selon l'art. 77 YY ceci", "Il y a 3.14 m ici", "Soit (cf. n. 4. Et plus) tout", "Un point. encore", "Suite; Autre"):
        assert passages.sentences(f"{joined}. {clauses[0]}.") == [f"{joined}.", f"{clauses[0]}."]
    assert passages.sentences("8. 8.1 Ouverture. Clos.") == ["8. 8.1 Ouverture.", "Clos."]
    assert passages.plain_sentences("M. Quai parle. Oui.\nArt. 8. Non. Fin") == ["M. Quai parle.", "Oui.", "Art. 8. Non.", "Fin"]
    assert passages.headed_sentences("Objet\nEN FAIT\nB. La grue\nse lève. Bien.\nEN DROIT\nDu 01.02.1999, p. ex. cela. Bon.") == ["Objet", "EN FAIT\n\nB.", "La grue se lève.", "Bien.", "EN DROIT\n\nDu 01.02.1999, p. ex. cela.", "Bon."]
    long = "c" * 70 + " d e f g h i j."
    assert passages.merge_short(["a b.", long, "EN DROIT", long, "x."]) == [f"a b. {long}", f"EN DROIT {long} x."]
    chunks = passages.packed_chunks([f"sentence number {k} of the text." for k in range(60)], most=50, overlap=10)
    assert all(passages.token_estimate(c) <= 60 for c in chunks) and len(chunks) > 5 and chunks[1].startswith(chunks[0][-40:])
    assert passages.packed_chunks(["ab cd " * 20], most=10, overlap=0)[0] == "ab cd ab cd ab cd ab cd ab cd"
    for n in range(1, 8):
        assert passages.packed_chunks([f"n{k}." for k in range(n)], most=400, overlap=0) == [" ".join(f"n{k}." for k in range(n))]
    plain = ["Art. 1. Le test. M. Dupont. Fin.\nSuite", "Voir p. 3. Le 2.5. Zone 4. Encore 1. Non? Oui! C.fam. Bref", "  ", None]
    column = spark.createDataFrame([(t,) for t in plain], "t string").select(passages.plain_sentence_column(F.col("t")))
    assert [r[0] for r in column.collect()] == [passages.plain_sentences(t or "") for t in plain]
    assert passages.packed_chunks(["a.", "b" * 30], most=100) == ["a. " + "b" * 30]
    parts = passages.split_recursively("word " * 600, 1000, 200)
    assert all(len(p) <= 1000 for p in parts) and len(parts) >= 3
    df = spark.createDataFrame([(1, "A", 1, "a"), (1, "A", 2, "b"), (1, "A", 4, "d"), (1, "B", 3, "c")], "doc_id int, section string, id int, sentence string")
    assert sorted(tuple(r) for r in passages.section_runs(df).collect()) == [(1, "A", 1, 2, "a\nb"), (1, "A", 4, 1, "d"), (1, "B", 3, 1, "c")]
    assert passages.line_differences("a\nb", "a\nc") == ["- b", "+ c"]
    r = spark.range(1).select(passages.reconciled(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]), F.array(F.lit(1), F.lit(2), F.lit(9)), F.array(F.lit(2))).alias("r")).first()["r"]
    assert r["majeure"] == [1] and r["mineure"] == [2, 3, 4]


def test_text(spark):
    df = spark.createDataFrame([("Mail a.b@c.ch  see_this http://x.y/z www.foo aaaaab   end EN DROIT\n\nrest",)], "t string")
    row = df.select(text.cleaned(F.col("t")).alias("c"), text.after_marker(F.col("t")).alias("a"), text.highlighted(F.lit('<a href="the">the The then</a>'), ["the"], "x").alias("h"), text.highlighted(F.lit("Contrat <span>contrat</span> (a.b)"), ["contrat", "a.b"], colour="#abc").alias("k")).first()
    assert row["k"].count("<span style=") == 2 and row["a"] == "rest" and "@" not in row["c"] and "http" not in row["c"] and "aab" in row["c"]
    assert row["h"] == '<a href="the">the <span class="x">The</span> then</a>'
    assert df.select(text.clean_document(F.lit(" . "))).first()[0] is None


def test_phrases(spark):
    df = spark.createDataFrame([(1, ["new", "york", "new", "york", "city"]), (2, ["new", "york"]), (3, [])], "doc_id int, tokens array<string>")
    pairs = spark.createDataFrame([("new", "york"), ("york", "new")], "a string, b string")
    got = {r["doc_id"]: r["tokens"] for r in phrases.merged(df, pairs).collect()}
    assert got == {1: ["new_york", "new_york", "city"], 2: ["new_york"], 3: []}
    norms = phrases.tfidf(df).groupBy("doc_id").agg(F.round(F.sum(F.col("tfidf") * F.col("tfidf")), 9).alias("n")).collect()
    assert all(r["n"] == 1 for r in norms)


def test_selection(spark):
    choice = spark.createDataFrame([(k, True, True, None) for k in range(1, 5)], "doc_id int, to_display boolean, is_initial boolean, is_check boolean")
    c = selection.marked(choice, yes=[1], no=[2])
    assert {r["doc_id"]: r["state"] for r in selection.snapshot(c).collect()} == {1: "yes", 2: "no", 3: "maybe", 4: "maybe"}
    assert selection.snapshot_counts(selection.snapshot(c)).first().asDict() == {"yes": 1, "no": 1, "maybe": 2, "initial": 4, "shown": 4}
    points = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 30)], "doc_id int, pos_x double, pos_y double")
    new, gone = selection.iterated(c, points, spark.createDataFrame([(6,)], "doc_id int"), k=6)
    assert sorted(r["doc_id"] for r in new.collect()) == [1, 2, 3, 4, 5, 7] and sorted(r["doc_id"] for r in gone.collect()) == [2, 6]
    assert [r["to_display"] for r in new.orderBy("doc_id").collect()] == [True, False, True, True, True, True]
    back = selection.restored(selection.snapshot(c))
    assert {(r["doc_id"], r["is_check"]) for r in back.collect()} == {(1, True), (2, False), (3, None), (4, None)}
    tree = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 2, 1), (4, 1, 1)], "id int, parent int, project_id int")
    assert sorted(tuple(r) for r in selection.lineage(tree, 3).collect()) == [(1, 2), (2, 1), (3, 0)]
    assert [(r["ordinal"], r["is_root"], r["is_parent"]) for r in selection.listed(tree, 3).orderBy("id").collect()] == [(1, True, True), (2, False, True), (3, False, False), (4, False, False)]


def test_ranking(spark):
    rows = spark.range(25).withColumnRenamed("id", "doc_id")
    assert [r["doc_id"] for r in ranking.page(rows, 99, [F.asc("doc_id")], 10).collect()] == [20, 21, 22, 23, 24]
    got = ranking.batches(rows, 10, "doc_id").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [10, 10, 5]
    support = spark.createDataFrame([("c", 2, 1), ("c", 2, 2), ("d", 0, None)], "consideration string, frequency int, doc_id int")
    docs = spark.createDataFrame([(1, "A/1"), (2, "B/2")], "doc_id int, procedure_type string")
    assert {r["consideration"]: (r["percent"], r["types"]) for r in ranking.supporting_types(support, docs, 3).collect()} == {"c": (66.7, ["A/1", "B/2"]), "d": (0.0, ["Inconnu"])}


def test_answers(spark):
    docs = spark.createDataFrame([(1, "text one"), (2, ""), (3, "text three")], "doc_id int, text string")
    cache = docs.filter("doc_id = 1").select(text.answer_key(F.lit("q"), F.col("doc_id")).alias("key"), F.lit("old").alias("answer"))
    got = {r["doc_id"]: (r["answer"], r["cached"]) for r in answers.answered(docs, "q", cache, lambda q, ts: [q + ":" + t for t in ts]).collect()}
    assert got == {1: ("old", True), 2: (answers.NO_CONTEXT, False), 3: ("q:text three", False)}
    rows = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "doc_id int, ok boolean")
    assert [r["doc_id"] for r in answers.first_valid(rows, F.col("ok"), 2).orderBy("doc_id").collect()] == [1, 2, 3]
    f = spark.createDataFrame([("the cat sat", ["a cat sat down"], "z", False), ("x", [], "x y", False), ("bad", [], "", True)], "answer string, citation_context array<string>, citation string, bad boolean")
    assert [round(r["faithfulness"], 3) for r in answers.faithfulness(f, answers.overlap_scorer, F.col("bad")).collect()] == [0.667, 1.0, 0.0]
    assert answers.faithfulness_key("q", "a", ["c"], "m") != answers.faithfulness_key("q", "a", ["d"], "m")
    m = spark.createDataFrame([({"Majeure": ["m"], "Mineure": ["n", "o"]},), ({"Majeure": ["m"]},)], "s map<string,array<string>>")
    assert [r[0] for r in m.select(answers.context_of(F.col("s"))).collect()] == ["n\no", answers.NO_CONTEXT]


def test_stats(spark):
    one = spark.createDataFrame([(0.5,)], "s double")
    assert stats.score_summary(one, "s", 0.5).first().asDict() == {"mean": 0.5, "median": 0.5, "deviation": 0.0, "percent": 100.0}
    labels = spark.createDataFrame([("oui",), ("oui",), ("non",), ("error",)], "l string")
    r = stats.polar_answers(labels, "l").first()
    assert (r["n_oui"], r["p_oui"], r["p_mixte"], r["total"]) == (2, 50.0, 0.0, 4)
    j = spark.createDataFrame([('{"a": ["x"]}',), ('{"a": []}',), ("no",), (None,)], "j string")
    assert stats.valid_sections(j, "j", ("a", "b")).first()["n"] == 1


def test_joins(spark):
    s = spark.createDataFrame([(1, 0, "le recours est admis"), (1, 1, "autre chose")], "doc_id int, place int, sentence string")
    t = spark.createDataFrame([(1, "recours le admis est")], "doc_id int, target string")
    assert [r["marked"] for r in joins.fuzzy_sentences(s, t).orderBy("place").collect()] == [True, False]
    old = spark.createDataFrame([(1, 0.5)], "doc_id int, score double")
    new = spark.createDataFrame([(9, 0.1)], "doc_id int, score double")
    pairs = spark.createDataFrame([(1, 7)], "old_id int, new_id int")
    assert sorted(tuple(r) for r in joins.carried_scores(pairs, old, new).collect()) == [(7, 0.5), (9, 0.1)]
    assert joins.carried_scores(pairs, old, new.limit(0)).count() == 0
    refs = spark.createDataFrame([(5, "see 1, 99 and 2")], "k int, v string")
    docs = spark.createDataFrame([(1, "A"), (2, "B")], "doc_id long, procedure_type string")
    assert [r["doc_id"] for r in joins.resolved_references(refs, "k", "v", docs).orderBy("place").collect()] == [1, 2]


def test_fuzzy_ratio_is_that_of_insertions_and_deletions(spark):
    import random

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    rng = random.Random(4)
    pairs = [("".join(rng.choice("abAB ") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abAB ") for _ in range(rng.randint(0, 90)))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(joins.fuzzy_ratio(F.col("a"), F.col("b"))).collect()]
    for (a, b), r in zip(pairs, got, strict=True):
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert abs(r - (200 * common(x, y) / (len(x) + len(y)) if x or y else 0)) < 1e-9
    shown = joins.highlighted_sentences(spark.createDataFrame([(1, "The boat left. Nobody knew why!"), (2, "")], "doc_id int, text string"), spark.createDataFrame([(1, "The boat left")], "doc_id int, target string"))
    assert {r["doc_id"]: r["marked_text"] for r in shown.collect()} == {1: '<span style="background-color: #FFFF77">The boat left.</span> Nobody knew why!', 2: ""}


def test_nearest_points_match_force(spark):
    import random

    rng = random.Random(6)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.gauss(40, 0.1), 7.0]), rng.choice([rng.gauss(0, 1), 3.0])) for k in range(900)] + [(900, 1e4, -1e4)]
    points = spark.createDataFrame(rows, "doc_id int, pos_x double, pos_y double")
    got = {}
    for r in joins.nearest_points(points, points.filter("doc_id % 9 = 0"), 7).collect():
        got.setdefault(r["doc_id"], []).append((r["d2"], r["neighbour"]))
    for k, x, y in rows[::9]:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in rows if j != k)[:7]
        assert np.allclose([d for d, _ in sorted(got[k])], [d for d, _ in near], rtol=1e-9) and {j for _, j in got[k]} == {j for _, j in near}
    few = points.filter("doc_id < 3")
    assert joins.nearest_points(few, few, 7).count() == 6 and joins.nearest_points(few.limit(0), few, 7).count() == 0


def test_iterations(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 9, None)]
    tree = spark.createDataFrame(rows, "refinement_id int, id int, parent int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(selection.pruned_after(tree, 1, 2)) == [1, 2, 9] and ids(selection.pruned_after(tree, 1, 4)) == [1, 2, 3, 4, 9] and ids(selection.pruned_after(tree, 7, 4)) == [1, 2, 3, 4, 9]
    left, root = selection.reset(tree, 1)
    assert ids(left) == [1, 9] and root == 1 and selection.reset(tree, 5)[1] is None
    left, parent = selection.without_iteration(tree, 1, 4)
    assert ids(left) == [1, 2, 3, 9] and parent == 3 and selection.without_iteration(tree, 1, 1)[1] is None
    choice = spark.createDataFrame([(k, True, True, {1: True, 2: False}.get(k)) for k in range(1, 5)], "doc_id int, to_display boolean, is_initial boolean, is_check boolean")
    points = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 30)], "doc_id int, pos_x double, pos_y double")
    after, own, gone = selection.next_iteration(tree, 1, choice, points, spark.createDataFrame([(6,)], "doc_id int"), parent=2, k=6)
    assert ids(after) == [1, 2, 9, 10] and after.filter("id = 10").first()["parent"] == 2 and own.count() == 6 and gone.count() == 2
    more = spark.createDataFrame([(5, k, "{}", None) for k in range(1, 15)], "project_id int, id int, filters string, origin int")
    full = selection.next_refinement(more, 5, "{}", 3)
    assert full.count() == 15 and full.filter("origin = 3").first()["id"] == 15
    with pytest.raises(ValueError, match="15 refinements"):
        selection.next_refinement(full, 5, "{}")
    with pytest.raises(ValueError, match="15 iterations"):
        selection.next_iteration(spark.createDataFrame([(1, k, k - 1 or None) for k in range(1, 16)], tree.schema), 1, choice, points, gone)


def test_studies(spark):
    """Trials by a clusterer of one's own: asked of the sampler, resumed, failures tried again."""
    from pyspark.errors import PySparkException

    rows = [(k, w, 1.0) for k in range(40) for w in (["x", "y", f"z{k}"] if k < 20 else ["p", "q", f"z{k}"])]
    points = clustering.document_vectors(spark.createDataFrame(rows, "doc_id int, term string, tfidf double"), 32)
    ranges = (clustering.Range("dimensions", 2, 3, True), clustering.Range("width", 0.4, 0.6), clustering.Range("least", 3, 4, True))
    tried = []

    def run(vectors, trial):
        tried.append(trial)
        if len(tried) == 2:
            raise PySparkException("lost")
        return None, trial.width

    trials = clustering.study(points, 4, jobs=1, run=run, kind=clustering.Density, ranges=ranges)
    assert clustering.count_trials(trials) == 3 and trials.filter("state = 'FAIL'").first()["number"] == 1
    again = clustering.study(points, 4, trials, jobs=3, run=run, kind=clustering.Density, ranges=ranges)
    assert clustering.count_trials(again) == 4 and len(tried) == 5 and tried[4] == tried[1]
    assert clustering.best_params(again)["width"] == max(t.width for t in tried)
    labels, score = clustering.scored_density(points, clustering.Density(2, 0.5, 3))
    assert labels.count() == 40 and -1 <= score <= 1
    assert clustering.clustered(points.limit(5)) == (None, None) and clustering.best_params(trials.limit(0)) is None
    early = clustering.early_map(points)
    assert early.count() == 40 and clustering.without_provisional(early.select("doc_id", "cluster_id")).count() == 0
    assert clustering.silhouette(points, early) == -1.0


def test_clustered_collection(spark):
    """Two subjects are told apart by a study of three trials."""
    rows = [(k, w, 1.0) for k in range(60) for w in ([f"x{k % 4}", "y", f"z{k % 7}"] if k < 30 else [f"p{k % 4}", "q", f"r{k % 7}"])]
    points = clustering.document_vectors(spark.createDataFrame(rows, "doc_id int, term string, tfidf double"), 32)
    labels, trials = clustering.clustered(points, 3, jobs=3)
    assert clustering.count_trials(trials) == 3
    found = {r["doc_id"]: r["cluster_id"] for r in labels.collect()}
    assert len(found) == 60 and not {found[k] for k in range(30)} & {found[k] for k in range(30, 60)} - {-1}


def test_collections_and_models(spark):
    have = {"new": spark.range(2), "old": spark.range(0)}
    assert vectors.collection(have, "new").count() == 2 and vectors.collection(have, "gone", {"gone": "old"}).count() == 0
    assert vectors.has_collection(have, "new") and not vectors.has_collection(have, "gone", {"gone": "old"}) and not vectors.has_collection(have, "none")
    calls = []

    def shaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise RuntimeError("busy")
        return [t.upper() for t in texts]

    assert answers.insistent(shaky, ["a"], 3, 0.0) == ["A"] and len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError):
        answers.insistent(shaky, ["a"], 2, 0.0)
    chunks = spark.createDataFrame([("1", "t1"), ("2", "t2")], "chunk_id string, text string")
    held = chunks.limit(1).select("chunk_id", "text", F.array(F.lit(1.0)).alias("embedding"))
    more = vectors.with_new_chunks(held, chunks, lambda ts: [[float(len(t))] for t in ts])
    assert sorted((r["chunk_id"], r["embedding"]) for r in more.collect()) == [("1", [1.0]), ("2", [2.0])]
    told = answers.summary_of_sections(spark.createDataFrame([(1, {"Majeure": ["m"]}, '{"Mineure-Subsommation": ["s"]}', True), (2, {}, "x", False)], "doc_id int, citation_context map<string,array<string>>, answer string, valid boolean"), "Q", lambda ts: ['{"summary": "' + str("m" in t and "s" in t) + '"}' for t in ts])
    assert told.first().asDict() == {"summary_answer": '{"summary": "True"}', "valid_answer_count": 1}
    none = answers.summary_of_sections(spark.createDataFrame([], "doc_id int, citation_context map<string,array<string>>, answer string, valid boolean"), "Q", lambda ts: ts)
    assert none.first()["summary_answer"] == answers.NO_SUMMARY
    elements = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.5)], "doc_id int, cluster_id int, prob double")
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, position int, text string")
    assert answers.summary(answers.cluster_context(elements, parts, 0, F.length("text"), 1), "Sum", lambda ts: [t[-3:] for t in ts]).first()["summary"] == "a\nb"
    rags = spark.createDataFrame([(7, 1, "q", '{"summary": "s"}')], "rag_id int, project_id int, query string, summary_answer string")
    given = spark.createDataFrame([(7, 3, 0.5, '{"x": ["y"]}')], "rag_id int, doc_id int, confidence_score double, c string").withColumn("citation_context", F.parse_json("c"))
    now = answers.current_run(rags, given, 7).first()
    assert now["summary"] == "s" and now["has_section_ans"] and now["has_confidence_score"]
    table = spark.range(1).select(answers.reference_table(F.array(F.struct(F.lit("t").alias("text"), F.lit("[1], [3] and 99").alias("reference"))), F.create_map(F.lit(1).cast("long"), F.lit("A"), F.lit(3).cast("long"), F.lit("B"))).alias("t")).first()["t"]
    assert [(r["doc_id"], r["procedure_type"]) for r in table[0]["references"]] == [(1, "A"), (3, "B")]
    judged = answers.considered(spark.createDataFrame([(1, "yes it is"), (2, "no")], "doc_id int, answer string"), ["yes", "no"], lambda a, c: a.contains(c))
    assert judged.filter("supported").count() == 2
    assert [r[0] for r in spark.createDataFrame([("Oui, car",), ("Non.",), ("oui et non",), ("bof",)], "a string").select(answers.closed_category(F.col("a"))).collect()] == ["oui", "non", "mixte", "peut_etre"]


def test_cleaning_with_lemmas(spark):
    df = spark.createDataFrame([(1, ["cats", "ran", "quickly", "of"]), (2, [])], "doc_id int, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat", "NOUN"), ("ran", "run", "VERB"), ("of", "of", "ADP")], "word string, lemma string, pos string")
    assert {r["doc_id"]: r["tokens"] for r in text.lemmatized(df, lemmas).collect()} == {1: ["cat", "run", "quickly"], 2: []}
    docs = spark.createDataFrame([(1, "le recours est admis par la cour"), (2, "the appeal is granted by the court"), (3, None)], "doc_id int, text string")
    good, bad = text.prepared(docs)
    assert [r["doc_id"] for r in good.collect()] == [1] and sorted(r["doc_id"] for r in bad.collect()) == [2, 3]


def test_files(spark, tmp_path):
    from corpusloom.sources import projects

    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"cle_fiche": str(k)}) if k != 5 else "{broken" for k in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = records.numbered_records(spark, str(tmp_path / "a.jsonl"))
        assert sorted((r["line_number"], r["record"]["cle_fiche"]) for r in found.filter("bad is null").collect()) == [(k + 1, str(k)) for k in range(2000) if k != 5]
        assert [(r["line_number"], r["bad"]) for r in records.bad_lines(found).collect()] == [(6, "{broken")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("", 3), (None, 4)], "record_key string, v int")
    assert records.write_inputs(rows.limit(1), str(tmp_path / "in")).count() == 1
    assert [r["record_key"] for r in records.write_inputs(rows, str(tmp_path / "in")).collect()] == ["b"]
    with pytest.raises(ValueError, match="more than 0 keys"):
        records.field_names(spark, str(tmp_path / "a.jsonl"), 0)
    one = spark.createDataFrame([("k", 1), ("k", 2)], "record_key string, v int").coalesce(1)
    assert projects.load(one, str(tmp_path / "t")) == 1 and projects.current_state(spark, str(tmp_path / "t"))[1].first()["v"] == 2
    (tmp_path / "t" / "state=9").mkdir()
    assert projects.load(one.withColumn("record_key", F.lit("l")), str(tmp_path / "t")) == 2 and projects.current_state(spark, str(tmp_path / "t"))[0] == 2
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path / "none.jsonl"))
    own = spark.createDataFrame([(1, "completed"), (2, "running"), (3, "completed")], "project_id int, status string")
    assert [r["project_id"] for r in projects.without_finished({"p": own}, own, shared=(3,))["p"].orderBy("project_id").collect()] == [2, 3]
    snaps = spark.createDataFrame([("s1", 1, ["a"]), ("s2", 2, ["a", "b"])], "name string, start_time int, indices array<string>")
    assert [r["index"] for r in records.indices_to_restore(snaps, spark.createDataFrame([("a",)], "index string")).collect()] == ["b"]


def test_vectors_and_clusters(spark):
    rows = [(k, [1.0 + k * 0.01, 0.0] if k < 10 else [0.0, 1.0 + k * 0.01]) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert all(r["vec_id"] < 10 for r in vectors.nearest(df, [1.0, 0.0], 10).collect())
    queries = df.filter("vec_id in (0, 15)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert vectors.nearest_of_each(df, queries, 3).count() == 6
    weights = spark.createDataFrame([(k, w, 1.0) for k in range(20) for w in (["x", "y"] if k < 10 else ["p", "q"])], "doc_id int, term string, tfidf double")
    points = clustering.document_vectors(weights, 16)
    trial, score = clustering.best_trial(points, [clustering.Trial(2, 16), clustering.Trial(3, 16)])
    labels = {r["doc_id"]: r["cluster_id"] for r in clustering.kmeans(points, trial).collect()}
    assert trial.k == 2 and score > 0.9 and len({labels[k] for k in range(10)}) == 1 and labels[0] != labels[19]
    assert clustering.trials_left(1, 11, 4) == [3, 3, 2, 2] and clustering.trials_left(1, 11, 4, legacy=True) == [2, 2, 2, 2]
    assert clustering.mapped(points).count() == 20 and clustering.palette(["a", "unclassified papers"])["unclassified papers"] == "#9494b8"


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text(json.dumps({"cle_fiche": "1", "datedecision": "01.02.2020"}) + "\n")
    query = ingest.append_to(ingest.record_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["decision_date"] == "2020-02-01"
    query = ingest.append_to(ingest.record_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_projects(spark, tmp_path):
    from corpusloom.sources import projects

    docs = spark.createDataFrame([(1, "foo bar"), (2, "bar")], "doc_id int, text string")

    def broken():
        raise RuntimeError("down")

    hits, wrong = projects.project_documents({"a": lambda: docs, "b": broken, "c": lambda: docs.filter("doc_id = 2")}, "bar")
    assert wrong == {"b": "down"} and sorted((r["doc_id"], r["source"]) for r in hits.collect()) == [(1, "a"), (2, "a"), (2, "c")]
    projects.save_project(hits, 7, str(tmp_path / "d"), str(tmp_path / "s"))
    scores = projects.side_table(spark, str(tmp_path / "s"), "doc_id int, score double, project_id int", 7)
    assert scores.count() == 3 and projects.side_table(spark, str(tmp_path / "none"), "a int").count() == 0
    new = spark.createDataFrame([("k", 1)], "record_key string, v int")
    assert projects.load(new, str(tmp_path / "t")) == 1 and projects.load(new.union(new.selectExpr("'j'", "2")), str(tmp_path / "t")) == 2
    dated = spark.createDataFrame([(k, f"text {k}", date(1990 + 10 * k, 1, 1)) for k in range(4)] + [(9, "no day", None)], "doc_id int, text string, decision_date date")
    assert projects.whole_project({"a": lambda: dated, "b": broken}, 8, str(tmp_path / "w"), str(tmp_path / "ws")) == {"b": "down"}
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [1, 2, 3]
    assert projects.whole_project({"a": lambda: dated}, 8, str(tmp_path / "v"), str(tmp_path / "vs"), until=date(2015, 1, 1)) == {}
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 2]
    shown = selection.all_displayed(spark.createDataFrame([(1, False), (2, None)], "doc_id int, to_display boolean"))
    assert all(r["to_display"] for r in shown.collect())
    assert projects.deleted({"s": scores}, 7)["s"].count() == 0 and projects.deleted({"s": scores}, 7, (7,))["s"].count() == 3


def test_rendering(spark):
    from corpusloom.functions import predicates
    from corpusloom.operators import render
    from corpusloom.plans import boolean

    choice = spark.createDataFrame([(1, True), (2, False)], "doc_id int, to_display boolean")
    docs = spark.createDataFrame([(1, "the word", "s", "en"), (2, "x", "s", "en")], "doc_id int, text string, source string, lang string")
    topics = spark.createDataFrame([(1, "the, other", 1, "#abc")], "doc_id int, topic string, order int, colour string")
    row = render.rendered_rows(choice, docs, topics, ["word"]).first()
    assert row["excerpt"] == '<span style="background-color: #abc40">the</span> <span class="query">word</span>' and row["label"] == "Topic 1 : the, other"
    assert render.rendered_rows(choice, docs, topics.withColumn("topic", F.lit("")), ["word"]).count() == 0
    clusters = spark.createDataFrame([(k, f"t{k}", k + 1) for k in range(1500)] + [(-1, "unclassified papers", -1)], "cluster_id int, topic string, order int")
    colours = {r["cluster_id"]: r["colour"] for r in render.coloured(clusters).collect()}
    assert colours[-1] == "#9494b8" and all(len(c) == 7 for c in colours.values()) and len(set(colours.values())) > 700
    points = spark.createDataFrame([(1, 3, 0.0, 1.0), (2, -1, 1.0, 1.0)], "doc_id int, cluster_id int, pos_x double, pos_y double")
    assert render.scatter(points, docs, clusters).count() == 2 and [r["label"] for r in render.centre_labels(points, clusters).collect()] == ["Topic 4"]
    text_ = spark.range(1).select(render.citation_text(F.lit("H"), {"Faits": F.lit("f"), "Droit": F.lit(" ")}, F.lit("q")).alias("t"), render.chunk_prompt(F.array(F.lit("a"), F.lit("b"))).alias("p")).first()
    assert text_["t"] == "H\nFaits : f\n« q »" and text_["p"] == "[1] a\n[2] b"
    assert predicates.year_range("2017-2022") == (date(2017, 1, 1), date(2022, 12, 31))
    assert boolean.from_text("anything", lambda t: "(a OR b) AND c") == "( a OR b ) AND c".replace("( ", "(").replace(" )", ")")
    s = spark.range(1).select(answers.parsed_summary(F.lit('{"summary": "s", "considerations": [{"text": " c"}]}')).alias("a"), answers.parsed_summary(F.lit("plain")).alias("b")).first()
    assert s["a"]["considerations"][0]["text"] == "c" and s["b"]["summary"] == "plain" and s["b"]["considerations"] == []
    faults = spark.range(1).select(passages.classification_faults(F.array(*[F.lit(k) for k in (1, 2)]), F.array(F.lit(1), F.lit(3)), F.array(F.lit(1))).alias("f")).first()["f"]
    assert faults == ["unknown ids: 3", "ids in both classes: 1", "missing ids: 2"]


def test_one_long_answer_takes_no_memory_for_the_others(spark):
    import resource

    def model(query, texts):
        now = f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}"
        return [now if t == "word" else t for t in texts]

    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 7, F.repeat(F.lit("word "), 100_000)).otherwise("word").alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r["doc_id"]: r["answer"] for r in answers.answered(docs, "q", spark.createDataFrame([], "key string, answer string"), model).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1000 and len(got[7]) == 500_000
    seen = sorted({int(a) for k, a in got.items() if k % 100 != 7})
    assert seen[-1] - seen[0] < 300  # MB of the worker from batch to batch


def test_a_run_carries_contexts_and_asks_once(spark):
    docs = spark.createDataFrame([(1, "red fox", "c1", ["red"]), (2, "", "", []), (3, "old", "old", [])], "doc_id int, text string, citation string, citation_context array<string>")
    cache = spark.createDataFrame([(3, "old answer")], "doc_id int, answer string").select(text.answer_key(F.lit("q"), F.col("doc_id")).alias("key"), "answer")
    for most in (None, 5):
        run = answers.run_answers(docs, "q", cache, lambda q, ts: ts, answers.overlap_scorer, most)
        rows = {r["doc_id"]: (r["citation"], r["citation_context"], r["answer"], r["cached"], r["confidence_score"]) for r in run["answers"].collect()}
        assert rows == {1: ("c1", ["red"], "red fox", False, 0.5), 2: ("", [], answers.NO_CONTEXT, False, 0.0), 3: ("old", [], "old answer", True, 0.5)}
        assert run["counts"].first().asDict() == {"num_documents": 3, "valid_answer_count": 2}


def test_clusters_move_sums_and_no_words(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{(k % 8) * 300 + j}" for j in rng.integers(0, 400, 3000)), "en") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokens = docs.select("doc_id", text.index_tokens(F.col("text")).alias("tokens"))
    of = lambda weights: {r["doc_id"]: r["features"].toArray() for r in clustering.document_vectors(weights, 64).collect()}
    plain, unit = of(phrases.weighed_terms(tokens).withColumnRenamed("raw", "tfidf")), of(phrases.tfidf(tokens))
    assert len(plain) == 100 and all(np.allclose(plain[k], unit[k], atol=1e-12) for k in unit)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    found = catalog.QUERIES["v_clusters"](spark, str(tmp_path)).collect()
    assert len(found) == 100 and written() - before < 0.5 * sum(len(t) for _, t, _ in rows)


def test_phrases_leave_only_their_result_on_disk(spark):
    from pathlib import Path

    from corpusloom.sources.staging import run_folder

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, [*(f"w{j}" for j in rng.integers(0, 3000, 200)), "new", "york", "city"]) for k in range(60)] + [(60, []), (61, ["new"])], "doc_id int, tokens array<string>")
    names = lambda: {f.name for f in Path(run_folder(spark).removeprefix("file:")).glob("*") if f.is_dir()}
    before = names()
    got = {r["doc_id"]: r["tokens"] for r in phrases.ngrams(docs).collect()}
    assert got[0][-1] == "new_york_city" and got[60] == [] and got[61] == ["new"]
    assert [n.split("-")[0] for n in names() - before] == ["merged"]
    pairs = phrases.pmi_bigrams(docs)
    assert {f.rpartition("/")[0].rpartition("/")[2].split("-")[0] for f in pairs.inputFiles()} == {"pairs", "words", "sizes"}
    assert pairs.filter("n < 2").count() == 0 and pairs.filter("a = 'new' and b = 'york' and n = 60").count() == 1
