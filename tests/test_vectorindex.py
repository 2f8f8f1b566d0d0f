"""The stored vector index: recall against the full scan, exactness with all cells, filters, appended chunks and few or no vectors."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import search, vectorindex


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 3 != 0).alias("dense_lexical_use"))


def test_recall_exactness_filters_and_appended_chunks(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/index"
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qe"))
    vectorindex.write_index(vectors.where("id % 2 = 0"), path)
    vectorindex.append(vectors.where("id % 2 = 1"), path)
    exact = search.dense_search(queries, vectors, 19)
    use = F.col("dense_lexical_use")
    found = vectorindex.search(spark, queries, path, 19, where=use)
    assert vectorindex.recall(found, exact) >= 0.95
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan
    cells = spark.read.parquet(f"{path}/cells").count()
    assert cells > 20
    every = vectorindex.search(spark, queries, path, 19, probes=cells, where=use).select("query_id", "chunk_id", "rank")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_vectors_in_groups_need_few_cells(spark, tmp_path):
    path, rng = f"file://{tmp_path}/index", random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in middles[i % 60]], True) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, dense_lexical_use boolean")
    vectorindex.write_index(df, path)
    cells, probes = spark.read.parquet(f"{path}/cells").count(), spark.read.parquet(f"{path}/probes").first()[0]
    queries = spark.createDataFrame([(i, [x + rng.gauss(0, 0.15) for x in middles[i % 60]]) for i in range(40)], "query_id int, qe array<double>")
    found = vectorindex.search(spark, queries, path, 19)
    assert vectorindex.recall(found, search.dense_search(queries, df, 19)) >= 0.95
    assert probes <= cells / 4


@pytest.mark.parametrize("rows", [[], [(1, [0.0, 1.0])], [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)]])
def test_few_vectors_zeros_and_nulls(spark, tmp_path, rows):
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    vectorindex.write_index(df, path)
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, qe array<double>")
    got = [r.chunk_id for r in vectorindex.search(spark, q, path, 5).orderBy("rank").collect()]
    assert got == {0: [], 1: [1], 4: [2, 3, 1]}[len(rows)]
