"""Radix selection ends, whatever the ranks and the rows that may be sorted."""

import pytest

from corpusloom.llm import divergence


@pytest.mark.parametrize(("ranks", "sortable"), [(5, 2), (7, 1), (1, 1)])
def test_more_ranks_than_may_be_sorted(spark, tmp_path, monkeypatch, ranks, sortable):
    rows = [("ties", f"same{k}", 9) for k in range(12)] + [("ties", "same", 9), ("ties", "top", 300)]
    rows += [("mixed", f"m{k}", 1000 * (k // 3)) for k in range(20)] + [("few", "x", 4)]
    spark.createDataFrame(rows, "g string, item string, value long").write.parquet(str(tmp_path / "t"))
    passes, stored = [], divergence.Scratch.stored

    def counted(self, df, name):
        passes.append(name)
        assert len(passes) < 20, "the selection does not end"
        return stored(self, df, name)

    monkeypatch.setattr(divergence.Scratch, "stored", counted)
    got = divergence.top_ranked(spark.read.parquet(str(tmp_path / "t")), ["g"], ranks, sortable=sortable).collect()
    want = []
    for g in ("ties", "mixed", "few"):
        own = sorted(((-v, i.encode()) for h, i, v in rows if h == g))[:ranks]
        want += [(g, i.decode(), -v, k + 1) for k, (v, i) in enumerate(own)]
    assert sorted((r["g"], r["item"], r["value"], r["rank"]) for r in got) == sorted(want)
