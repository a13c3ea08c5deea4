"""Queries against their SQL on small tables with what the given tables seldom hold."""

import duckdb
import pytest

from corpusloom import catalog


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Writes tables (name to rows and schema) and compares a query's rows over them with those of its SQL."""

    def compare(name, tables):
        c = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        c.execute(catalog.ORACLE[name])
        names = [d[0] for d in c.description]
        got = sorted((tuple(r[n] for n in names) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
        assert got == sorted(c.fetchall(), key=str)
        return got

    return compare


def test_prepared_keeps_the_language_of_texts_without_words_left(same_as_sql):
    texts = ["Avec.", "La é le de de.", "le recours est admis par la cour", "the appeal is granted", "", "12", "x@y.ch und der", None]
    got = same_as_sql("x_prepared", {"documents": ([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")})
    assert (0, "fr") in got and (1, "fr") in got and (3, None) in got
