"""Dense search over a stored index: vectors in cells, of which a search reads the nearest.

Cells are found by k-means over the vectors' directions, on a sample of bounded size drawn by a hash of the id; every vector is then in the cell of its nearest centre.
The index is a Parquet table partitioned by cell, with the centres and the k-means model beside it, so new chunks are appended to the cells that are there.
A search ranks the centres for each query, reads the folders of the nearest cells, and scores what is in them exactly; after that it is the plan of a full scan. How many
cells it reads is measured when the index is written: as many as have AIM of the nearest of some of the vectors themselves. Vectors in groups need a few cells; for
vectors without any structure, which no index helps much, that can be most of them. With all cells the result is exact.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import vector as V
from folioflow.operators.search import nearest, ranked
from folioflow.sources.files import written

#: Vectors that k-means is fitted on, cells at most, and what the number of cells to read is measured by: vectors asked for, their nearest, and the share of these to be in the cells.
FIT_ROWS, MOST_CELLS = 50_000, 4_096
ASKED, NEAREST, AIM = 256, 19, 0.98


def _with_direction(chunks: DataFrame) -> DataFrame:
    """Rows with a vector, and its direction for k-means; a vector of zeros has none and stays as it is."""
    n = V.norm(F.col("embedding"))
    return chunks.where("embedding is not null").withColumn("_unit", array_to_vector(F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))))


def write_index(chunks: DataFrame, path: str, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 7) -> None:
    """Index chunks (id, embedding, further columns to filter by) at a path; rows without a vector are left out. As many cells as the root of the rows, at most MOST_CELLS."""
    v = _with_direction(chunks)
    n = v.count()
    k = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS))
    if n > 1 and k > 1:
        draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, fit_rows / n)
        model = KMeans(k=k, seed=seed, maxIter=10, initMode="random", featuresCol="_unit", predictionCol="cell").fit(v.where(draw).select("_unit"))
        model.write().overwrite().save(f"{path}/model")
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # at most MOST_CELLS
        placed = model.transform(v)
    else:
        centres, placed = [(0, [])], v.withColumn("cell", F.lit(0))
    chunks.sparkSession.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    placed.drop("_unit").hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    spark = chunks.sparkSession
    probes = _probes(spark, path) if k > 1 and n > 1 else 1
    schema = placed.drop("_unit").schema.json()  # an index without vectors has no files to read it from
    spark.createDataFrame([(probes, schema)], "probes int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def _centres(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("cell").alias("id"), F.col("centre").alias("embedding"))


def _probes(spark: SparkSession, path: str) -> int:
    """How many of the nearest cells hold AIM of the nearest vectors, asked for some of the vectors."""
    v, cells = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells")
    n = v.count()
    asked = v.where(F.pmod(F.xxhash64(F.lit(99), "id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, ASKED / n)).select(F.col("id").alias("query_id"), F.col("embedding").alias("qe"))
    others = nearest(asked, v, NEAREST + 1).where("id != query_id").drop("rank")
    true = ranked(others, NEAREST, F.desc("similarity"), F.asc("id")).join(v.select("id", "cell"), "id").select("query_id", "cell")
    order = nearest(asked, _centres(cells), MOST_CELLS).select("query_id", F.col("id").alias("cell"), "rank")
    return true.join(order, ["query_id", "cell"]).agg(F.ceil(F.percentile("rank", F.lit(AIM))).cast("int")).first()[0] or 1


def append(chunks: DataFrame, path: str) -> None:
    """Further chunks, in the cells that the index has."""
    v = _with_direction(chunks)
    spark = chunks.sparkSession
    one = spark.read.parquet(f"{path}/cells").count() == 1
    placed = v.withColumn("cell", F.lit(0)) if one else KMeansModel.load(f"{path}/model").transform(v)
    placed.drop("_unit").hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{path}/vectors")


def search(spark: SparkSession, queries: DataFrame, path: str, k: int = 19, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k nearest chunks found for each query (query_id, qe), among those that `where` lets through; ties by id."""
    cells = spark.read.parquet(f"{path}/cells")
    n = cells.count()
    measured, schema = spark.read.parquet(f"{path}/probes").first()
    probes = probes or measured
    all_, fields = n <= probes, T.StructType.fromJson(json.loads(schema))
    v = spark.read.schema(fields).parquet(f"{path}/vectors")
    if not all_:
        near = nearest(queries, _centres(cells), probes).groupBy("query_id").agg(F.collect_list("id").alias("cells"))
        near = written(queries.select("query_id", "qe").join(near, "query_id"))
        wanted = [r[0] for r in near.select(F.explode("cells")).distinct().collect()]  # at most MOST_CELLS
        queries, v = near, v.where(F.col("cell").isin(wanted))
    v = v if where is None else v.where(where)
    return nearest(queries, v, k, cells=not all_).select("query_id", F.col("id").alias("chunk_id"), "similarity", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query_id, chunk_id) that were found."""
    hits, n = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left").agg(F.count("_hit"), F.count(F.lit(1))).first()
    return hits / n if n else 1.0
