"""Texts on which column functions and the SQL of their queries could part: digits at sentence edges, rare spaces, long upper cases, absent texts."""

import duckdb

from folioflow import registry

registry.load()

TEXTS = ["0997 | a. 1 b. 2 c 2", "\xa0a.\x0bb. c ", "x.\x01y\x01 z! ", "  ", "", None, "ß straße. ŉ ǰ ﬁ ᾳ ΐ", "a?\r\n b", "\tq"]


def both(spark, tmp_path, name):
    """The query's rows and its SQL's over documents of TEXTS, each with an even and an odd number."""
    rows = [(i, TEXTS[i % len(TEXTS)], "en", "src1", 1) for i in range(6 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"file://{tmp_path}/documents.parquet")
    df = registry.QUERIES[name](spark, f"file://{tmp_path}")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return sorted(map(tuple, df.collect()), key=str), sorted(duck.sql(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall(), key=str)


def test_sentences_keep_the_digits_at_their_edges(spark, tmp_path):
    got, want = both(spark, tmp_path, "t12_split_sentences")
    assert got == want


def test_origin_is_where_the_row_is_found_and_upper_case_keeps_the_length(spark, tmp_path):
    got, want = both(spark, tmp_path, "s22_source_precedence")
    assert got == want
