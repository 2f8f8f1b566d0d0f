"""Dense search in blocks: the lists of a plain cross join, and only the best of each block leave it."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import vector as V
from folioflow.operators import search


def pairs(q, c):
    cos = F.coalesce(F.round(V.cosine(F.col("qe"), F.col("embedding")), 6), F.lit(0.0))
    return q.crossJoin(c).select("query_id", "id", cos.alias("similarity"))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    vec = lambda n: [rng.choice((rng.uniform(-1, 1), 0.5)) for _ in range(n)]
    same = vec(6)
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0] * 4, [1e-200] * 6]
    c = spark.createDataFrame([(300 - i, v) for i, v in enumerate(odd + [same] * 40 + [vec(6) for _ in range(200)])], "id long, embedding array<double>")
    q = spark.createDataFrame([((i, 0), v) for i, v in enumerate([same, *odd, *[vec(6) for _ in range(30)]])], "query_id struct<a: int, b: int>, qe array<double>")
    return q, c


def test_lists_are_those_of_the_cross_join(tables, monkeypatch):
    q, c = tables
    monkeypatch.setattr(search, "BATCH", 8)
    monkeypatch.setattr(search, "TOGETHER", 2)
    monkeypatch.setattr(search, "AT_A_TIME", 3)
    get = lambda df: sorted(map(tuple, df.select("query_id", "id", "similarity").collect()))
    assert get(search.nearest(q, c, 7)) == get(search.ranked(pairs(q, c), 7, F.desc("similarity"), F.asc("id")))
    assert get(search.above(q, c, 0.6)) == get(pairs(q, c).where("similarity > 0.6"))


def test_pairs_are_not_rows(spark, tables):
    q, c = tables
    plan = search.dense_search(q, c.withColumns({"dense_lexical_use": F.lit(True), "sentence_count": F.lit(1)}), 3)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "mapinarrow" in plan.lower()
