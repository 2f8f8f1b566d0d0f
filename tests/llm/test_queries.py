"""The corpus queries on the smallest given tables: equal to DuckDB where there is SQL, whole and stable elsewhere."""

import duckdb
import pytest

from folioflow.llm import queries
from tests.test_queries import DATA, TABLES, ordered, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    q = duck.sql(queries.ORACLES[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in q.fetchall()])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op9_paragraph_dedup", "op10_nearest", "op13_spelling"}))
def test_query_has_a_row_for_each_row(spark, name):
    table = "pages" if name == "op2_html_text" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = sorted(r[0] for r in queries.QUERIES[name](spark, DATA).select(key).collect())
    assert got == sorted(r[0] for r in queries.table(spark, DATA, table).select(key).collect())
