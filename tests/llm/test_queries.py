"""The registered queries that SQL cannot state, each against a brute-force version, on tables in files."""

import re
import zlib

import numpy as np
import pytest
from test_documents import SCHEMA, blank_words, messy_rows

from corpusloom.llm import lengths, order, packing
from corpusloom.llm.queries import QUERIES

URLS = ["https://A.Example.COM/en/7?x=1", "http://b.com/en/9#t", "x://example.net/de/8/9", "http://o.net/de/1", "http://s.org/es/2", "http://free.it/a", "no scheme", "", None]


@pytest.fixture(scope="module")
def rows():
    return messy_rows()


@pytest.fixture(scope="module")
def root(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    pages = [(k, u, "<p>") for k, u in enumerate(URLS * 7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def encode():
    return lengths.rank_encoder(*lengths.production_tokenizer()).encode_ordinary


def test_op1(spark, root, rows, encode):
    sizes = [len(encode(r[1] or "")) for r in rows]
    got = {r["length"]: r for r in QUERIES["op1_token_counts"](spark, root).collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert (r["n_docs"], r["docs_longer"], r["docs_fitting"]) == (sizes.count(n), sum(s > n for s in sizes), sum(s <= n for s in sizes))
        assert (r["tokens_total"], r["tokens_fitting"], r["tokens_truncated"]) == (sum(sizes), sum(s for s in sizes if s <= n), sum(min(s, n) for s in sizes))
        assert abs(r["quantile"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-12


def test_op2(spark, root, rows):
    got = QUERIES["op2_language_id"](spark, root).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
        if all(not any(c.isalpha() for c in t or "") for t in texts[r["doc_id"]]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_op3(spark, root, rows):
    want = []
    for r in rows:
        t, w = r[1] or "", blank_words(r[1])
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        hit = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if blank_words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((r[0], len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    got = QUERIES["op3_quality_rules"](spark, root).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got)
    assert not any(r["base_failed"] and r["kept"] for r in got) and any(r["kept"] for r in got)


def test_op7(spark, root):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    got = QUERIES["op7_url_filters"](spark, root).collect()
    assert len(got) == 7 * len(URLS)
    for r in got:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", URLS[r["page_id"] % len(URLS)] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, r["verdict"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) and verdict in ("allow", "block")


def test_op8(spark, root, rows, encode):
    layout = order.Layout()
    want = []
    for r in rows:
        ids = [*encode(r[1] or ""), layout.end]
        for s in range(0, len(ids), layout.length):
            part = np.array(ids[s : s + layout.length], dtype="<u2")
            want.append((str(r[0]), s, len(part), zlib.crc32(part.tobytes())))
    got = QUERIES["op8_training_order"](spark, root).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["tokens_crc32"]) for r in got)
    assert sorted(r["slot"] for r in got) == list(range(len(want)))
    slots = order.permute(np.array([r["sequence_id"] for r in got]), len(want), layout.key)
    assert slots.tolist() == [r["slot"] for r in got]


def test_op10(spark, root, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.production_tokenizer())
    want = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for s, n in packing.pieces(len(ids)):
            want.append((str(r[0]), s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()), len(ids)))
    got = QUERIES["op10_packing"](spark, root).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in got)
