"""URL filters and chat formatting."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import chat, urls


def test_hosts_paths_and_rules(spark):
    rows = [
        (0, "https://A.Example.COM/en/7?x=1", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        (1, "http://b.com/en/9#t", "b.com", "/en/9", "com/en/", "block"),
        (2, "http://com/en/", "com", "/en/", "com/en/", "block"),
        (3, "x://example.net/de/8/9", "example.net", "/de/8/9", "example.net/de/8", "block"),
        (4, "x://other.net/de/8", "other.net", "/de/8", "net/de/", "allow"),
        (5, "x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        (6, "x://h?q=/en/", "h", "", None, None),
        (7, "no scheme/en/", "", "", None, None),
        (8, None, "", "", None, None),
        (9, "", "", "", None, None),
        (10, "a://É.org/es/x://y", "É.org", "/es/x://y", "org/es/", "block"),
        (10, "a://É.org/es/x://y", "É.org", "/es/x://y", "org/es/", "block"),
        (None, "://z#/en/", "z", "", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "x", "x") for r in rows], "page_id long, url string, verdict string, host string")
    got = urls.filter_urls(pages)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got.collect()), key=key) == sorted(((r[0], r[2], r[3], r[4]) for r in rows), key=key)
    assert all(r["verdict"] in ("allow", "block") for r in got.collect())
    assert {r["page_id"]: r["verdict"] for r in got.filter("rule is not null").collect()} == {r[0]: r[5] for r in rows if r[4]}
    assert urls.filter_urls(pages.limit(0)).count() == 0
    assert urls.filter_urls(pages.filter("page_id = 6")).first()["verdict"] == "allow"


def by_hand(labelled, url):
    """Witten and Bell's mixture from exact counts."""

    def grams(u):
        t = "\x02" * urls.ORDER + u + "\x03"
        return [(t[i - k : i], t[i]) for i in range(urls.ORDER, len(t)) for k in range(urls.ORDER + 1)]

    total = 0.0
    for sign, kind in ((1, True), (-1, False)):
        seen = {}
        for yes, u in labelled:
            if yes == kind:
                for ctx, c in grams(u):
                    seen.setdefault(ctx, {}).setdefault(c, 0)
                    seen[ctx][c] += 1
        p = 1 / urls.ALPHABET
        for ctx, c in grams(url):
            if not ctx:
                p = 1 / urls.ALPHABET
            d = seen.get(ctx, {})
            n = sum(d.values())
            if n >= urls.LEAST:
                p = (d.get(c, 0) + len(d) * p) / (n + len(d))
            if len(ctx) == urls.ORDER:
                total += sign * math.log(p)
    return total / (len(url) + 1)


def test_character_models(spark):
    rng = random.Random(1)
    labelled = [(True, f"http://good{rng.randint(0, 99)}.net/de/{rng.randint(0, 999)}") for _ in range(60)] + [(False, f"http://spam-{rng.randint(0, 99)}.org/es/{rng.randint(0, 999)}") for _ in range(60)]
    df = spark.createDataFrame(labelled, "accepted boolean, url string")
    grams = urls.counted(df)
    model = urls.train(grams)
    some = ["http://good5.net/de/77", "http://spam-5.org/es/1", "", "ö://"]
    assert np.allclose(model.scores(some), [by_hand(labelled, u) for u in some], atol=1e-6)
    assert model.scores(some)[0] > 0 > model.scores(some)[1]
    assert urls.train(urls.counted(df.filter("accepted"))) is None
    cut = urls.calibrate(df, grams)
    s = model.scores([u for _, u in labelled])
    assert (s[:60] >= cut).all() and (s[60:] < cut).all()


def test_the_cut_is_cross_fitted(spark):
    """Labels without any pattern: models tell their own URLs apart, but not those of another part."""
    rng = random.Random(5)
    labelled = [(rng.random() < 0.5, "http://" + "".join(rng.choice("abcdefgh") for _ in range(12))) for _ in range(400)]
    df = spark.createDataFrame(labelled, "accepted boolean, url string")
    grams = urls.counted(df)
    fold = {r["url"]: r["f"] for r in df.select("url", urls._fold(F.col("url")).alias("f")).collect()}
    scores = {True: [], False: []}
    for k in range(urls.FOLDS):
        rest = [x for x in labelled if fold[x[1]] != k]
        for yes, u in labelled:
            if fold[u] == k:
                scores[yes].append(by_hand(rest, u))
    rate = lambda c: sum(x < c for x in scores[True]) / len(scores[True]) + sum(x >= c for x in scores[False]) / len(scores[False])
    least = min(rate(c) for c in np.arange(-2, 2, urls.STEP))
    assert rate(urls.calibrate(df, grams)) <= least + 0.02 and least > 0.6
    own = {u: s for u, s in zip([u for _, u in labelled], urls.train(grams).scores([u for _, u in labelled]), strict=True)}
    assert sum((own[u] >= 0) == yes for yes, u in labelled) > 0.9 * len(labelled)


def test_models_of_many_grams(spark):
    """More grams than any table of fixed size holds apart; broadcast and joined models agree."""
    rng = random.Random(2)
    make = lambda: "http://x/" + "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(40))
    labelled = [(k % 2 == 0, make()) for k in range(12000)]
    labelled += labelled[:4000]
    df = spark.createDataFrame(labelled, "accepted boolean, url string")
    grams = urls.counted(df)
    model = urls.train(grams)
    assert sum(len(t[0]) for t in model.tables) > 1 << 20
    some = [labelled[0][1], labelled[1][1] + "x"]
    assert np.allclose(model.scores(some), [by_hand(labelled, u) for u in some], rtol=0, atol=1e-6)
    wide = urls.train(grams, max_broadcast_grams=0)
    got = urls._scored(spark.createDataFrame([(u,) for u in [*some, *some, "", None]], "url string"), wide).collect()
    assert len(got) == 6 and all(r["score"] == model.scores([r["url"]])[0] for r in got)


def test_verdicts_of_joined_models(spark):
    rng = random.Random(3)
    made = [f"http://{rng.choice('abc')}{rng.randint(0, 99)}.{rng.choice(['net/de/', 'org/es/', 'com/en/', 'it/x/'])}{rng.randint(0, 999)}" for _ in range(400)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*made, None, ""])], "page_id long, url string")
    key = lambda r: r["page_id"]
    one, two = urls.filter_urls(pages), urls.filter_urls(pages, max_broadcast_grams=0)
    assert one.columns == two.columns and sorted(one.collect(), key=key) == sorted(two.collect(), key=key)


def test_chats_round_trip(spark):
    marks = "</s>[INST] ok [/INST] [\\ <\\ \\[ <s>"
    turns = [
        (1, 1, "assistant", marks), (1, 0, "user", marks), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, "a[b<c", "é\n\n日"),
        (None, 5, "user", " </s>"), (3, None, "assistant", "late " * 3000), (4, 0, "assistant", ""),
    ]
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, record string")
    done = chat.format_chats(chat.conversation_records(rows))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()
    assert len(back) == 5
    for r in back:
        own = [(t, a, b) for c, t, a, b in turns if c == r["conv_id"]]
        own.sort(key=lambda x: tuple((v is not None, v) for v in x))
        want = [(a or "", b or "") for _, a, b in own]
        assert [(t["role"], t["text"]) for t in r["t"]] == want
        assert r["m"] == "".join(b for a, b in want if a == "assistant")
        assert r["formatted"].count("[INST]") == len(want)
    assert chat.format_chats(chat.conversation_records(rows.limit(0))).count() == 0


def test_layouts(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', "messages", [("user", "q"), ("assistant", "a")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "shares", [("user", "q"), ("assistant", "a")]),
        ('{"output": "a", "instruction": "i", "input": "x"}', "instruction", [("user", "i\n\nx"), ("assistant", "a")]),
        ('{"instruction": "i", "input": "", "output": null}', "instruction", [("user", "i"), ("assistant", "")]),
        ('{"prompt": "p", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")]),
        ('{"system": "s", "prompt": "p", "completion": "c"}', "system prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ('{"question": "p", "answer": "c"}', "question", [("user", "p"), ("assistant", "c")]),
        ('{"other": 1}', None, None), ("broken {", None, None), (None, None, None), ("[]", None, None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(records)], "id int, record string")
    for r in chat.canonical(df).collect():
        _, name, turns = records[r["id"]]
        assert r["mapping"] == name and (r["turns"] and [tuple(t) for t in r["turns"]]) == turns
    assert hashlib.sha256(b"x").hexdigest() == df.select(F.sha2(F.lit("x"), 256)).first()[0]


def test_texts_beyond_the_limits_of_variants(spark):
    size = 20_000_001
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("text", F.repeat("text", F.lit(size)))
    for records in (chat.conversation_records(rows), chat.conversation_records(rows).withColumn("record", F.to_json("record"))):
        done = chat.format_chats(records)
        back = done.select("mapping", F.length("formatted").alias("n"), F.length(chat.masked_text(F.col("formatted"), F.col("loss_mask"))).alias("m"))
        marks = len(chat.OPEN + chat.MIDDLE + chat.CLOSE)
        assert back.collect() == [("messages", 2 * (size + marks) + len("user") + len("assistant"), size)]
    bad = records.select(F.concat(F.substring("record", 1, 2_000_000), F.lit("\\q\"}]}")).alias("record"))
    assert [tuple(r) for r in chat.canonical(bad).select("mapping", "turns").collect()] == [(None, None)]


def test_layouts_of_structs(spark):
    own = spark.sql("SELECT named_struct('instruction', 'i', 'input', '', 'output', cast(null AS string)) AS record UNION ALL SELECT null")
    got = [(r["mapping"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.canonical(own).collect()]
    assert sorted(got, key=str) == [("instruction", [("user", "i"), ("assistant", "")]), (None, None)]
    assert chat.canonical(spark.sql("SELECT named_struct('a', 1) AS record")).select("mapping", "turns").first() == (None, None)


def test_emptied_values(spark):
    record = r'{"a b": "x\"y: \\", "c" :["q", "r:"], "d": {"e": "", "f": 1}}'
    assert spark.createDataFrame([(record,)], "r string").select(chat._skeleton(F.col("r"))).first()[0] == '{"a b": "", "c" :["", ""], "d": {"e": "", "f": 1}}'
