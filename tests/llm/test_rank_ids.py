"""Ids without look ahead are the tokenizer's own, and runs of blanks of any length have some."""

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import lengths, order
from corpusloom.llm.rank_ids import LONG, RankIds, blank_runs


def test_ids_equal_the_tokenizers():
    tok = lengths.production_tokenizer()
    ids, plain, rng = RankIds(*tok), lengths.rank_encoder(*tok).encode_ordinary, random.Random(5)
    assert ids.short_cut is not None and RankIds(tok[0], tok[1] + "|q").short_cut is None
    pieces = [*" \n\t\r\x0b\x85\xa0\u2003\u3000", "  ", "\n\n", " " * 9, "\x1c", "\u180e", "\u200b", "\ufeff", "\x00", "'s", "'ll", "'", "a", "Word", "é", "日本", "👍", "7", "²", "\u0663", ".", "--", "<|none|>", "<|"]
    texts = ["", " ", "  ", *("".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(20_000))]
    texts += [("some longer words " * 20).join(rng.choices(pieces, k=8)) for _ in range(2_000)]
    texts += [f"a{chr(c)}{b}{chr(c)} b" + "words " * 40 for c in [*range(1, 0x3100), 0xFEFF] for b in ("", " ")]
    for t, runs in zip(texts, blank_runs(pa.array(texts)), strict=True):
        want = plain(t)
        assert ids.ids(t).tolist() == ids.ids(t, runs).tolist() == want, t


def test_order_takes_any_run_of_blanks(spark, tmp_path):
    tok, layout = lengths.production_tokenizer(), order.Layout()
    run, piece = 1_200_000, lengths.rank_encoder(*tok).encode_ordinary(" " * (LONG - 1))
    assert set(piece) == {piece[0]}  # no longer piece of blanks has a rank: each blank is an id
    rows = [(1, "a" + " " * run + "b", len(piece) // (LONG - 1) * (run - 1) + 2), (2, "a b", 2), (3, " b" * 50_000 + " " * run, 50_000 + run), (None, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(2)
    order.write_order(docs, str(tmp_path / "a"), tok, layout)
    got = {}
    for r in order.read_order(spark, str(tmp_path / "a")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["tokens"])))
    whole = {k: np.frombuffer(b"".join(t for _, t in sorted(v)), dtype="<u2") for k, v in got.items()}
    assert {k: len(v) for k, v in whole.items()} == {k: n + 1 for k, _, n in rows} and all(v[-1] == layout.end for v in whole.values())
    a, b = (lengths.rank_encoder(*tok).encode_ordinary(x)[0] for x in ("a", " b"))
    assert whole[1][0] == a and set(whole[1][1:-2].tolist()) == set(piece) and whole[1][-2] == b
