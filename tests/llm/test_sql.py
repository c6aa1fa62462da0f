"""The queries that SQL can express against it, in DuckDB, on whole small tables."""

import os

import pytest

from tracelens.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    res = con.execute(queries.SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in res.fetchall())
