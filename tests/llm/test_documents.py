"""The document operators against brute force, on rows with all that can go wrong."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import decontaminate, langid, lengths, neardup, order, packing, quality, substring
from corpusloom.llm.automaton import SuffixAutomaton
from corpusloom.llm.common import split_words
from pyspark.sql import functions as F

#: Names that operators use inside; documents may have them too.
CLASHES = ["n_words", "row", "spans", "key", "label", "g", "kept", "distance", "signature", "kept_text", "region", "w", "s"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
WORDS = ["ba", "Be", "di", "do", "fu", "ga", "he", "Jo", "ku", "li", "mo", "né", "or", "pa", "qu", "ra"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", ".", ",", rng.choice(WORDS)]) for _ in range(n))


def messy_rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2].replace(" ", "\n"), "  " + base[3] + "\t\n"]
    for k in range(12):
        w = base[5 + k % 3].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[8] + "\n" + passage, passage + " " + base[9], base[10] + " " + passage + " " + base[11]]
    texts += [None, "", " \n\t", "one", "one two", "one two three", "### $$$ %%% &&& *** ||| <<< >>>", "la la la la la la la la la la la la", "x" * 5000]
    texts += [prose(rng, 4000), "same line here\n" * 30, "\x00nul \x1c sep \x85 wide　space", "👍 emoji 日本語 текст"]
    texts += [prose(rng, 30) for _ in range(60)]
    rows = [(k * 3, t, [None, "en", "fr"][k % 3], [None, "a", "b"][k % 3 - 1], None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, texts[7], "en", "a", 3), (None, None, None, None, None)]
    return [r + tuple(["clash"] * len(CLASHES)) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return messy_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def blank_words(t):
    return (t or "").encode().split()


def found(df, *keys):
    return sorted(([tuple(r) for r in df.select(*keys).collect()]), key=lambda r: tuple((x is not None, x) for x in r))


def expected(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_quality_statistics(docs, rows, nothing):
    want = []
    for r in rows:
        t = r[1] or ""
        w = blank_words(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        hit = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if blank_words(x)]
        chars = sum(len(x.decode()) for x in w)
        symbols = sum(t.count(c) for c in "#*$%&|<>")
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((r[0], len(w), chars, symbols, len(lines) - len(set(lines)), len(hit), failed))
    got = quality.quality_verdicts(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found(got, *names) == expected(want)
    assert not got.filter("base_failed and kept").count()
    few = quality.QualityRules(steps=1)
    assert quality.quality_verdicts(nothing, few).count() == 0
    kept = quality.quality_filter(docs, few)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(8)
    clean = [(k, prose(rng, rng.randint(30, 200)), "en", "a") for k in range(300)]
    junk = [(1000 + k, prose(rng, 20).replace(" ", " ### $$$ "), "en", "a") for k in range(30)]
    got = quality.quality_verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"] for r in got.filter("kept").collect()}
    assert kept >= {r[0] for r in clean} and not kept & {r[0] for r in junk}


def test_small_groups_are_judged_by_all_of_their_language(spark):
    rng = random.Random(9)
    junk = lambda: prose(rng, 20).replace(" ", " ### $$$ ")
    clean = [(k, prose(rng, rng.randint(30, 200)), "en", "a") for k in range(300)]
    clean += [(400 + k, prose(rng, rng.randint(30, 200)), lang, "b") for k, lang in enumerate(["en", "en", "fr", None])]
    bad = [(500, junk(), "en", "b"), (501, junk(), "en", None), (502, junk(), "fr", "b"), (503, junk(), None, "a")]
    schema = "doc_id long, text string, lang string, source string"
    got = quality.quality_verdicts(spark.createDataFrame(clean + bad, schema))
    assert {r["doc_id"] for r in got.filter("kept").collect()} == {r[0] for r in clean}
    assert not got.filter("distance is null").count()
    few = quality.quality_verdicts(spark.createDataFrame(clean[:30] + bad, schema), quality.QualityRules(steps=1))
    assert few.filter("kept").count() == 34 and few.filter("distance is null").count() == 34


def test_least_determinant_of_small_groups(spark):
    """Estimates against the exact ones: of all subsets that hold the coverage, that of least determinant."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    rules = quality.QualityRules()
    factor = rules.coverage / quality._chi2_cdf(quality.chi2_quantile(rules.coverage, 4), 6)
    floor = np.diag([(f * quality.SCALE) ** 2 for f in rules.floors])
    mix = np.array([[900, 0, 0, 0], [500, 800, 0, 0], [0, 300, 900, 0], [100, 0, 200, 1000]])
    groups = {}
    for g in range(5):
        x = rng.normal(size=(14, 4)) @ mix
        x[:3] += np.array([0, 9000, -7000, 12000]) + 500 * g
        groups[str(g)] = np.rint(x).astype(int)
    rows = [(g, k % 32, *map(int, r)) for g, x in groups.items() for k, r in enumerate(x)]
    got = {r["g"]: r for r in quality._concentrated(spark.createDataFrame(rows, "g string, salt int, q0 long, q1 long, q2 long, q3 long"), rules).collect()}
    outside = quality.chi2_quantile(1 - rules.tail, 4)
    for g, x in groups.items():
        dets = {c: np.linalg.slogdet(np.cov(x[list(c)].T) * factor + floor)[1] for c in combinations(range(14), 11)}
        best = min(dets, key=dets.get)
        assert got[g]["logdet"] <= dets[best] + 0.5
        inverse = np.linalg.inv(np.cov(x[list(best)].T) * factor + floor)
        far = [(r - x[list(best)].mean(axis=0)) @ inverse @ (r - x[list(best)].mean(axis=0)) > outside for r in x]
        w = np.array([[got[g][f"w{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        own = [(np.square(w @ (r - [got[g][f"m{i}"] for i in range(4)])).sum()) > outside for r in x]
        assert own == far == [k < 3 for k in range(14)]


def test_very_long_texts(spark):
    """One text of 60,000 words beside short ones, judged whole."""
    rng = random.Random(21)
    long = prose(rng, 30_000)
    text = long + "\n" + long
    got = quality.quality_verdicts(spark.createDataFrame([(1, text, "en", "a"), (2, "x", "en", "a")], "doc_id long, text string, lang string, source string"))
    r = got.filter("doc_id = 1").first()
    assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["base_failed"]) == (60_000, 60_000, 1, True)
    docs = spark.createDataFrame([(1, long), (2, "a b " + long), (3, "short")], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed").collect()} == {1: (30_000, 0), 2: (30_002, 30_000), 3: (1, 0)}


def test_chi_square_quantiles():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3 and abs(quality.chi2_quantile(0.75, 4) - 5.3853) < 1e-3


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def test_decontamination(spark, docs, rows, nothing):
    rng = random.Random(4)
    long = [r[1] for r in rows if r[1] and len(folded(r[1])) > 40]
    items = [(1, " ".join(folded(long[0])[3:25])), (10, long[1][:200].upper()), (2, " ".join(folded(long[2])[:13])), (3, prose(rng, 30)), (4, "one two"), (5, "one"), (6, None), (7, "!!"), (None, long[3]), (1, "one two three"), (8, "la la la la la la"), (9, "la " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = folded(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    want = []
    for r in rows:
        w, hit, of = folded(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if s := windows.get(tuple(w[j : j + n])):
                    of |= s
                    hit |= set(range(j, j + n))
        want.append((r[0], len(w), len(hit), ",".join(sorted(map(str, of))), len(hit) > 0 and 20 * len(hit) >= len(w)))

    def told(rule):
        got = decontaminate.contamination(docs, bench, rule)
        return found(got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.col("key.doc_id").alias("doc_id"), "n_words", "n_hit", F.array_join("items", ",").alias("i"), "contaminated"), "doc_id", "n_words", "n_hit", "i", "contaminated")

    assert told(decontaminate.Contamination()) == expected(want)
    assert told(decontaminate.Contamination(max_broadcast=7)) == expected(want)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[4] for w in want)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def shingle_set(t):
    w = blank_words((t or "").translate(FOLD))
    return frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, rows, nothing):
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    low = {d: d for d in sets}
    for _ in range(len(sets)):
        was = dict(low)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
        if low == was:
            break
    want = [(r[0], len(shingle_set(r[1])), low.get(r[0]), True if r[0] is None else low[r[0]] == r[0]) for r in rows]
    assert found(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == expected(want)
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.keep_one(docs)
    alone = {(r[0], r[1]) for r, w in zip(rows, want, strict=True) if w[3]}
    assert kept.columns == docs.columns and sorted(map(str, alone)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())


def test_crowded_near_duplicates(spark):
    """Copies of one text with more or fewer changes: chains of links, and copies just out of reach."""
    rng = random.Random(11)
    base = prose(rng, 150).split()
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append((k, " ".join(w)))
    sets = {k: shingle_set(t) for k, t in texts}
    low = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[b] < low[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a], changed = low[b], True
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == low and 1 < len(set(low.values())) < 150


def test_crowded_regions_of_unlike_rows(spark, monkeypatch):
    """Regions beyond CROWD are cut deeper, and compared at the last level, without losing a link."""
    monkeypatch.setattr(neardup, "CROWD", 6)
    monkeypatch.setattr(neardup, "LEVELS", 2)
    rng = random.Random(12)
    shared = prose(rng, 120)
    texts = [(k, shared + " " + prose(rng, 60)) for k in range(120)]
    texts += [(200 + k, texts[3 * k][1] + " " + prose(rng, rng.randint(20, 70))) for k in range(30)]
    sets = {k: shingle_set(t) for k, t in texts}
    low = {k: k for k in sets}
    for k in range(30):
        a, b = sets[3 * k], sets[200 + k]
        if 100 * len(a & b) >= 80 * len(a | b):
            low[200 + k] = 3 * k
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == low and 120 < len(set(low.values())) < 150


def test_a_region_of_unlike_rows_takes_linear_time_and_little_memory():
    import time
    import tracemalloc

    import pyarrow as pa

    def seconds(n):
        def batches():
            rng = np.random.default_rng(n)
            for k in range(0, n, 1000):
                sketch = [rng.integers(0, 256, neardup.HASHES, dtype=np.uint8).tobytes() for _ in range(1000)]
                ids = pa.array(np.arange(k, k + 1000))
                yield pa.RecordBatch.from_arrays([pa.array([7] * 1000, pa.int64()), ids, ids, pa.array([50] * 1000, pa.int64()), pa.array(sketch)], names=list("abcde"))

        began = time.perf_counter()
        assert not list(neardup._stars(batches()))
        return time.perf_counter() - began

    few = seconds(10_000)
    tracemalloc.start()
    many = seconds(50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert many < 15 * few + 5 and peak < 300_000_000


def removed_by_force(rows):
    docs = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None})
    first = {}
    for d, t in docs:
        w = blank_words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), d)
    out = []
    for r in rows:
        w, gone = blank_words(r[1]), set()
        if r[0] is not None:
            for j in range(len(w) - 12):
                if first[tuple(w[j : j + 13])] < r[0]:
                    gone |= set(range(j, j + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_substring_dedup(docs, rows, nothing, ids):
    got = substring.remove_repeats(docs, max_broadcast_ids=ids)
    got = got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.array_join(split_words(F.col("kept_text")), " "), 256).alias("h"))
    assert found(got, "doc_id", "n_words", "n_removed", "h") == expected(removed_by_force(rows))
    assert substring.remove_repeats(nothing).count() == 0
    left = substring.remove_from(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(not 0 < w[1] == w[2] for w in removed_by_force(rows))


def test_crowded_shards(spark, monkeypatch):
    """Few words make every gram common, so shards are split by windows."""
    monkeypatch.setattr(substring, "SHARD", 20)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(120))) for k in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.array_join(split_words(F.col("kept_text")), " "), 256).alias("h"))
    assert found(got, "doc_id", "n_words", "n_removed", "h") == expected(removed_by_force(rows))


def test_suffix_automaton_matches_force():
    rng = random.Random(1)
    for _ in range(50):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 15))] for _ in range(3)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = [rng.choice("abcd") for _ in range(20)]
        want = [max((n for n in range(i + 2) if n == 0 or tuple(q[i + 1 - n : i + 1]) in runs)) for i in range(len(q))]
        assert a.matching(q) == want


def test_reference_shards(spark):
    rng = random.Random(6)
    ref = prose(rng, 40)
    docs = spark.createDataFrame([(1, prose(rng, 10) + " " + " ".join(ref.split()[5:25]) + " end"), (2, None), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.match_reference(docs, [[ref], ["else"]]).collect()}
    assert got == {1: (31, 20), 2: (0, 0), 3: (1, 0)}
    with pytest.raises(ValueError):
        substring.match_reference(docs, [[ref]], max_words=5)


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.production_tokenizer())
    got = packing.pack(docs, packing.production_tokenizer()).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["start"]):
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for d in {r[0] for r in rows}:
        texts = [r[1] for r in rows if r[0] == d]
        want = sorted(np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes() for t in texts)
        assert sum(len(r["ids"]) for r in by[d]) == sum(map(len, want))
        if len(texts) == 1:
            assert b"".join(r["ids"] for r in by[d]) == want[0]
            assert [r["start"] for r in by[d]] == list(np.cumsum([0] + [r["length"] for r in by[d]])[:-1])
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in got)
    assert packing.pack(nothing, packing.production_tokenizer()).count() == 0


def test_encoder_is_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from corpusloom.llm.encoder import Encoder

    path = packing.production_tokenizer()
    plain, mine = Tokenizer.from_file(path), Encoder(path, most_words=50, most_parts=50)
    letters = st.sampled_from(list("abcXYZ'stré09²½ªµ!.,|<>_-\u00ad\u0301  \n\x1c\x85\xa0\u2003ΣİßÀ日👍")) | st.characters(blacklist_categories=["Cs"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(letters, max_size=30) | st.sampled_from(["<|endoftext|> a", "it's we'll 'S"]), max_size=4))
    def check(texts):
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert mine.ids(texts) == want

    check()


def test_token_counts(docs, rows, nothing):
    tok = lengths.production_tokenizer()
    encode = lengths.rank_encoder(*tok).encode_ordinary
    n = sorted(len(encode(r[1] or "")) for r in rows)
    limits = lengths.context_limits(lengths.length_histogram(docs, tok))
    got = {r["length"]: r for r in limits.collect()}
    assert sorted(got) == sorted(set(n))
    for k, r in got.items():
        assert r["n_docs"] == n.count(k) and r["docs_longer"] == sum(x > k for x in n) and r["docs_fitting"] == sum(x <= k for x in n)
        assert r["tokens_total"] == sum(n) and r["tokens_fitting"] == sum(x for x in n if x <= k) and r["tokens_truncated"] == sum(min(x, k) for x in n)
    assert lengths.length_quantile(limits, 0.5).first()[0] == n[-(-len(n) // 2) - 1]
    assert lengths.context_limits(lengths.length_histogram(nothing, tok)).count() == 0
    parts = lengths.length_histogram(docs, tok, ["lang", "key"])
    assert parts.columns == ["lang", "key", "length", "n_docs"] and parts.agg(F.sum("n_docs")).first()[0] == len(rows)


def test_training_order(spark, docs, rows, nothing, tmp_path):
    layout = order.Layout(length=16, per_shard=50)
    tok = lengths.production_tokenizer()
    encode = lengths.rank_encoder(*tok).encode_ordinary
    n = order.write_order(docs, str(tmp_path / "a"), tok, layout)
    got = sorted(order.read_order(spark, str(tmp_path / "a")).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(n)) and sorted(r["sequence_id"] for r in got) == list(range(n))
    assert all(order.permute(np.array([r["sequence_id"]]), n, layout.key)[0] == r["slot"] for r in got)
    assert all(r["shard"] == r["slot"] // 50 and r["offset"] == r["slot"] % 50 * layout.stride for r in got)
    seen = {}
    for r in sorted(got, key=lambda r: r["sequence_id"]):
        seen.setdefault(r["doc_id"], []).append(bytes(r["tokens"]))
    for d in {r[0] for r in rows}:
        want = sorted(np.array(encode(r[1] or "") + [layout.end], dtype="<u2").tobytes() for r in rows if r[0] == d)
        assert sum(map(len, seen[d])) == sum(map(len, want))
        if len(want) == 1:
            assert b"".join(seen[d]) == want[0]
    with pytest.raises(ValueError, match="16 bits"):
        order.write_order(docs, str(tmp_path / "c"), tok, order.Layout(end=70_000))
    late = order.read_order(spark, str(tmp_path / "a"), from_slot=n - 7).collect()
    assert sorted(r["slot"] for r in late) == list(range(n - 7, n))
    assert order.write_order(nothing, str(tmp_path / "b"), tok, layout) == 0
    assert order.read_order(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    p = order.permute(np.arange(n), n, 99)
    assert sorted(p) == list(range(n)) and (order.permute(p, n, 99, back=True) == np.arange(n)).all()


def test_shards_follow_the_total():
    slots = order.Layout().shard_slots
    assert slots(10) == slots(40_000_000) == 4096 and slots(100_000_000) == 16_384 and slots(10**12) == 65_536
    assert order.Layout(per_shard=7).shard_slots(10**12) == 7


def test_rows_in_another_order_have_another_digest():
    def digest(rows):
        d = order._Digest()
        for r in rows:
            d.add(*r)
        return d.value()

    rows = [(1, "a"), (2, "b"), (None, None), (3, "")]
    assert digest(rows) == digest(list(rows)) != digest(rows[::-1]) and digest([(1, "b"), (2, "a")]) != digest([(1, "a"), (2, "b")])


def test_language_id(spark, docs, nothing):
    rng = random.Random(5)
    sound = {"aa": ("kra", "kro", "zak", "oka"), "bb": ("lil", "mel", "nie", "ela"), "cc": ("òur", "sàt", "tùs", "ura")}
    make = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(lang, 25), lang) for k, lang in enumerate(list(sound) * 60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(known.filter(~langid.held_out(F.col("doc_id"))))
    got = known.join(langid.predict(known, model), "doc_id").filter(langid.held_out(F.col("doc_id")))
    assert got.filter("lang = lang_pred").count() == got.count() > 20
    mixed = make("aa", 12) + " " + make("bb", 12) + " " + make("cc", 12)
    runs = langid.label_words(spark.createDataFrame([(1, mixed), (2, None), (3, "12 !")], "doc_id long, text string"), model)
    runs = {r["doc_id"]: [(x["words"], x["lang"]) for x in r["runs"]] for r in runs.collect()}
    assert runs == {1: [(12, "aa"), (12, "bb"), (12, "cc")], 2: [], 3: []}
    odd = langid.predict(docs, model)
    assert odd.count() == docs.count() and odd.filter("score < 0 or score > 1 or score is null").count() == 0
    blank = odd.join(docs.select("doc_id", "text"), "doc_id").filter("text is null or trim(text) in ('', '### $$$ %%% &&& *** ||| <<< >>>')")
    assert blank.count() >= 3 and blank.filter("lang_pred != 'und' or score != 0").count() == 0
    assert langid.predict(nothing, model).count() == 0
    assert langid.train(known.limit(0)) is None and langid.predict(docs, None).filter("lang_pred != 'und'").count() == 0


def test_many_languages(spark):
    rows = [(2 * k + j, f"{chr(0x4E00 + k)}{chr(0x6E00 + k)} " * 5, f"l{k:04}") for k in range(1200) for j in range(2)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(known, langid.Training(languages=1200, steps=2, batch=8, words=8))
    assert model.languages == sorted({r[2] for r in rows})
    with pytest.raises(ValueError, match="1200 languages"):
        langid.train(known)


def test_training_passages_are_bounded(spark):
    """Passages come from any part of a text, so many of each language and no longer than stated."""
    how = langid.Training(per_language=5, chars=100)
    rows = [(k, "ab" * 500 + "cd" * 500, "x") for k in range(4)] + [(9, "short", "y"), (9, "short", "y")]
    got = langid._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), how).collect()
    assert sorted(r["lang"] for r in got) == ["x"] * 5 + ["y"] and all(len(r["text"]) <= 100 for r in got)
    assert any(r["piece"] > 9 for r in got)
    # The total is bounded too: shares of it fall as languages rise, down to one short passage each.
    many = spark.createDataFrame([(k, "ab" * 500, f"l{k % 30}") for k in range(300)], "doc_id long, text string, lang string")
    shares = langid._sample(many, langid.Training(passages=60, chars=100)).collect()
    assert len(shares) == 60 and {len(r["text"]) for r in shares} == {100}
    shares = langid._sample(many, langid.Training(passages=10, chars=100)).collect()
    assert len(shares) == 30 and {len(r["text"]) for r in shares} == {33}


def test_blocks_of_long_texts_are_bounded(spark):
    """A region of 2,048 rows of 20,000 words: its blocks hold bounded words, each pair of rows meets, and a block's links take bounded memory."""
    import subprocess
    import sys
    from pathlib import Path

    n, words = 2048, 20_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("region"), "id", F.lit(n).cast("long").alias("n"), F.lit(n * words).cast("long").alias("weight"))
    blocks = {}
    for r in neardup._in_parts(rows).collect():
        blocks.setdefault((r["i"], r["j"]), set()).add(r["id"])
    most = max(map(len, blocks.values()))
    assert most * words < 2.5 * neardup.MOST_SHINGLES and most < 2 * neardup.BLOCK
    met = {(min(a, b), max(a, b)) for own in blocks.values() for a in own for b in own if a < 100 and b < 100}
    assert len(met) == 100 * 101 // 2
    program = f"""
import random, resource
import pyarrow as pa
from corpusloom.llm import neardup
rng = random.Random(1)
word = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
texts = [" ".join(rng.choices(word, k={words})) for _ in range({most} - 1)]
texts.append(texts[0] + " more")
rows = [(7, 0, 1, k, k, t) for k, t in enumerate(texts)]
batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 50], strict=True)], names=list("abcdef")) for k in range(0, len(rows), 50)]
del rows, texts
print([b.to_pylist() for b in neardup._joining(iter(batches), 4)], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, sep="|")
"""
    out = subprocess.run([sys.executable, "-c", program], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=600)
    links, peak = out.stdout.split("|")
    assert links == str([[{"a": 0, "b": most - 1}]]) and int(peak) < 1000


def test_training_of_many_languages_is_bounded():
    """200 languages with as much text as the bounds let in, in a process of its own that tells its peak."""
    import subprocess
    import sys
    from pathlib import Path

    program = """
import random, resource
from corpusloom.llm import langid
how = langid.Training()
rng = random.Random(1)
texts, labels = [], []
for k in range(200):
    letters = [chr(0x400 + 7 * k + j) for j in range(7)]
    for _ in range(how.passages // 200):
        texts.append(" ".join("".join(rng.choices(letters, k=5)) for _ in range(how.chars // 6)))
        labels.append(f"l{k}")
model = langid.fit(texts, labels, how)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, len(model.languages))
"""
    out = subprocess.run([sys.executable, "-c", program], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=600)
    peak, n = map(int, out.stdout.split())
    assert n == 200 and peak < 1000


def test_forward_backward_is_exact():
    """Marginals of short chains against the sum over all label sequences."""
    from itertools import product

    rng = np.random.default_rng(1)
    words = ["ab", "cd", "ef", "ab"]
    crf = langid.Crf(["x", "y"], rng.normal(size=(langid.SLOTS, 2)).astype(np.float32), rng.normal(size=(2, 2)).astype(np.float32))
    texts = [" ".join(words[:n]) for n in (4, 2, 3, 1)] + [None]
    n, p = crf.word_probabilities(texts)
    assert n.tolist() == [4, 2, 3, 1, 0]
    at = 0
    for size in (4, 2, 3, 1):
        e = langid.Features([" ".join(words[:size])]).emissions(crf.weights).astype(float)
        total = np.zeros((size, 2))
        for path in product(range(2), repeat=size):
            weight = np.exp(sum(e[t, y] for t, y in enumerate(path)) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                total[t, y] += weight
        assert np.allclose(p[at : at + size], total / total.sum(axis=1, keepdims=True), atol=1e-4)
        at += size
