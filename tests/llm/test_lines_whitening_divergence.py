"""Line dedup, whitening and the divergence audit against brute force, on rows with all that can go wrong."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from test_documents import SCHEMA, messy_rows

from corpusloom.llm import divergence, lines, whitening
from corpusloom.llm.queries import QUERIES

STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lined_rows():
    rng = random.Random(11)
    pool = [f"line number {k} says {rng.choice(['this', 'that', 'Ünder'])}" for k in range(60)] + ["short", "", "nine char", "ten chars!", "ÄÖÜäöü ten"]
    rows = []
    for k in range(150):
        own = [rng.choice([x, x.upper(), f" \t{x}\r", x]) for x in rng.choices(pool, k=rng.randint(0, 12))]
        rows.append((1000 - 3 * k, "\n".join([*own, "the line of all documents"] if k % 3 else own)))
    rows += [(7, None), (8, ""), (9, "\n\n"), (9, "line number 5 says this\nonce"), (None, "line number 6 says this\nten chars!"), rows[0], rows[3], (5, "the line of all documents\n" * 40)]
    return [(d, t, None, "s", None, *["clash"] * (len(SCHEMA.split(",")) - 5)) for d, t in rows]


def kept_by_force(rows):
    key = lambda x: x.strip(STRIPPED).translate(LOWER)
    holders = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(math.inf if d is None else d)
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (math.inf if d is None else d)]
        out.append((str(d), len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rows", [lined_rows(), messy_rows(), []])
@pytest.mark.parametrize("most", [0, 1000])
def test_line_dedup(spark, rows, most):
    """Either way of meeting texts; hot lines cross ranges."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lines.keep_lines(docs, lines.LineRule(max_broadcast=most)).collect()
    told = sorted((str(r["row"]["doc_id"]), r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got)
    assert told == kept_by_force(rows) and (not rows or any(r[2] for r in told) or rows[0][0] == 0)


def test_bitmaps(spark):
    rows = lined_rows()
    got = lines.keep_bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in got) == [x[:3] for x in kept_by_force(rows)]
    for r in got:
        assert (r["keep"] is None) == (r["n_dropped"] == 0)
        if r["keep"] is not None:
            assert int((~lines.unpacked(bytes(r["keep"]))).sum()) == r["n_dropped"]
    gone = np.array([0, 5, 8, 15])
    assert np.flatnonzero(~lines.unpacked(lines.packed(gone))).tolist() == gone.tolist()


def test_runs_that_cross_ranges():
    """Each range told alone, its edges settled together, gives what one range gives."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.choice([-5, 3, 3, 3, 9]), 0, rng.randint(1, 6), 0, k) for k in range(300))

    def gone(cuts):
        told = []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = rows[lo:hi]
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part[k : k + 7], strict=True)], names=list("abcde")) for k in range(0, len(part), 7)]
            told += [tuple(r.values()) for b in lines._stream(iter(batches)) for r in b.to_pylist()]
        owners = {}
        for r in told:
            if r[0] == lines.EDGE:
                owners[r[1]] = min(owners.get(r[1], r[3]), r[3])
        return sorted(r[5] for r in told if r[0] == lines.GONE or (r[0] == lines.OPEN and owners[r[1]] < r[3]))

    least = {h: min(r[2] for r in rows if r[0] == h) for h in (-5, 3, 9)}
    want = sorted(r[4] for r in rows if r[2] > least[r[0]])
    assert all(gone(cuts) == want for cuts in ([], [1], [50, 51, 52], [100, 150, 200, 250], [3, 3, 299]))


def vectors_of(seed=4, n=400, dim=24):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * np.linspace(2, 0.1, dim) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]).astype(np.float32).tolist()


def test_whitening(spark):
    good = vectors_of()
    good += [good[0]] * 150 + [good[3]]
    odd = [None, [], [1.0], [None, *good[0][1:]], [float("nan"), *good[0][1:]], [*good[0][1:], float("inf")], [1e30, *good[0][1:]], good[0] + [1.0]]
    rows = [(k, v, "clash", 1) for k, v in enumerate(good + odd)] + [(None, good[1], "clash", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int").repartition(5)
    got = whitening.whitened_components(table).collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in [*good, good[1]]])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    white = ((n * x - sums) / n) @ v / np.sqrt(e)
    told = {}
    for r in got:
        told.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == 16 * len(x) and set(told) == {*range(len(good)), None}
    mine = np.array([[told[k][j]["whitened"] for j in range(1, 17)] for k in [*range(len(good)), None]])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-9
    far = ((n * x - sums) ** 2).sum(axis=1)
    assert [told[k][1]["deviation"] for k in [*range(len(good)), None]] == far.tolist()
    one = told[0]
    assert all(abs(one[j + 1]["explained"] - e[j] / np.trace(c.T @ c / n)) < 1e-12 for j in range(16))
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    make = lambda rows: whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = make(rows)
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]).collect()  # one direction only
    assert sorted((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9)) for r in line) == [(1, 1, 64**2, 1.0), (2, 1, 64**2, 1.0), (3, 1, 64**2, 1.0)]


def test_lobpcg_of_many_dimensions():
    """Blocks that span a part of the space only; equal eigenvalues too."""
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.concatenate(([50, 50, 30, 29.9], np.linspace(20, 1, 296)))
    m = (q * e) @ q.T
    values, vectors, residual, steps = whitening.lobpcg(lambda b: m @ b, 300, whitening.Whitening())
    assert np.allclose(values, e[:16], rtol=1e-12) and residual <= 1e-11 and 3 < steps < 200
    assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12) and np.abs(m @ vectors - vectors * values).max() < 1e-8
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: m @ b, 300, whitening.Whitening(max_steps=2))


def audited_rows(sources=9, n=260):
    rng = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Élan", "ÉLAN", "x", "日本"]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice([None, "hot", "hot", *[f"s{j}" for j in range(sources)]])
        text = rng.choice([" ", ", 7 "]).join(rng.choice([w, w.upper()]) for w in rng.choices(words, k=rng.randint(0, 40), weights=[1 / (1 + j) for j in range(len(words))]))
        rows.append((k, text, lang, source))
    rows += [(1, None, "de", "a"), (1, "", "de", "b"), (1, "few terms", "it", "only"), (2, rows[5][1], "en", "hot"), (2, None, "en", "empty")]
    return [(*r, None, *["clash"] * (len(SCHEMA.split(",")) - 5)) for r in rows]


def audited_by_force(rows):
    counts, docs, groups = {}, {}, set()
    for _, t, lang, source, *_ in rows:
        g = (lang or "", source or "")
        groups.add(g)
        found = Counter(w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or ""))
        counts.setdefault(g, Counter()).update(found)
        docs.setdefault(g[0], Counter()).update(found.keys())
    share = lambda n, total, v: 1 + math.floor(Fraction(10**9 * (n + 2), total + 2 * v))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in groups}:
        own = sorted(g for g in groups if g[0] == lang)
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        tables = {}
        for g in own:
            total = sum(counts[g][t] for t in kept)
            tables[g] = {t: share(counts[g][t], total, len(kept)) for t in kept}
        whole = {t: sum(counts[g][t] for g in own) for t in kept}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for g in own:
            pairs = [(-sum(f(tables[g][t], tables[h][t]) for t in kept), h[1]) for h in own if h != g]
            terms = [(-f(tables[g][t], q[t]), t) for t in kept if counts[g][t] > 0 and tables[g][t] > q[t]]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, g[1], part, item, -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("rule", [divergence.Audit(), divergence.Audit(sortable=3, block=4, most_counts=50)])
def test_audit(spark, rule):
    rows = audited_rows()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), rule)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audited_by_force(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    messy = messy_rows()
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(messy, SCHEMA)).collect()) == audited_by_force(messy)


def test_radix_selection(spark, tmp_path):
    """Large values, more ties than can be sorted, items that share long beginnings, items that begin others."""
    rng = random.Random(3)
    rows = [("a", f"{k}", rng.choice([0, 5, 2**40 + k, 2**62])) for k in range(300)]
    rows += [("ties", "same beginning " * 3 + "é" * (k % 7) + f"{k}", 9) for k in range(200)] + [("ties", "", 9), ("ties", "same", 9)]
    rows += [("few", "x", 0), ("few", "y", 1)]
    spark.createDataFrame(rows, "g string, item string, value long").repartition(4).write.parquet(str(tmp_path / "t"))
    got = divergence.top_ranked(spark.read.parquet(str(tmp_path / "t")), ["g"], 7, sortable=10).collect()
    want = []
    for g in ("a", "ties", "few"):
        own = sorted(((-v, i.encode()) for h, i, v in rows if h == g))[:7]
        want += [(g, i.decode(), -v, k + 1) for k, (v, i) in enumerate(own)]
    assert sorted((r["g"], r["item"], r["value"], r["rank"]) for r in got) == sorted(want)


def test_registered_queries(spark, tmp_path):
    """Of nothing, and the columns that the queries tell."""
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, columns in {"op11_embedding_whitening": 7, "op12_line_dedup": 4, "op13_source_divergence": 6}.items():
        got = QUERIES[name](spark, str(tmp_path))
        assert got.count() == 0 and len(got.columns) == columns
