"""The pipeline's stages in a row against a brute-force run of the same rules."""

import random

import numpy as np
from test_documents import SCHEMA, blank_words, folded, messy_rows, shingle_set

import corpus_pipeline
from corpusloom.llm import neardup, packing, quality
from corpusloom.llm.common import stored


def brute(rows, kept_by_quality, items):
    """Rows (doc_id, text) after near duplicates, substring dedup and decontamination."""
    docs = sorted(kept_by_quality)
    sets = {d: shingle_set(t) for d, t in docs}
    low = {d: d for d, _ in docs}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[b] < low[a] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a], changed = low[b], True
    docs = [(d, t) for d, t in docs if low[d] == d]
    first, out = {}, []
    for d, t in docs:
        w = blank_words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), d)
    for d, t in docs:
        w, gone = blank_words(t), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < d:
                gone |= set(range(j, j + 13))
        if not 0 < len(gone) == len(w):
            out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    windows = {tuple(w[j : j + 13]) for w in map(folded, items) for j in range(len(w) - 12)}
    clean = []
    for d, t in out:
        w = folded(t)
        hit = {i for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for i in range(j, j + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((d, t))
    return clean


def test_stages(spark, tmp_path):
    rows = [r for k, r in enumerate(messy_rows()) if r[0] is not None and r[0] not in {x[0] for x in messy_rows()[:k]}]
    items = [" ".join(folded(r[1])[:20]) for r in rows if r[1] and len(folded(r[1])) in range(40, 60)][:2]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(r["doc_id"], r["text"]) for r in quality.quality_filter(docs).collect()]
    want = brute(rows, kept, items)
    assert 3 < len(want) < len(kept) < len(rows)

    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        at = stored(out, "stage")
    got = sorted((r["doc_id"], b" ".join(blank_words(r["text"])).decode()) for r in at.collect())
    assert got == sorted((d, b" ".join(blank_words(t)).decode()) for d, t in want)

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.production_tokenizer())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    assert {r["doc_id"] for r in pieces} == set(texts)
    for d, t in texts.items():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == d)
        assert own == [(s, n, packing.crc32_of(ids[s : s + n].tobytes())) for s, n in packing.pieces(len(ids))]


def test_stages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_random_pieces():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 10_000)
        got = packing.pieces(n)
        assert sum(m for _, m in got) == n and all(m & (m - 1) == 0 for _, m in got)
        assert [s for s, _ in got] == [sum(m for _, m in got[:k]) for k in range(len(got))]


def test_near_duplicates_take_five_words(spark):
    words = [f"w{k}" for k in range(44)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert neardup.keep_one(docs).count() == 1
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2


def test_packed_ids_are_written(spark, tmp_path):
    text = "some words of a text that is long enough to be kept by all rules"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, text, "en", "a", len(text), *[""] * (len(SCHEMA.split(",")) - 5))], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(packing.production_tokenizer()).encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), dtype="<u4").tolist() == want
    assert all(r["ids_crc32"] == packing.crc32_of(bytes(r["ids"])) for r in pieces)
