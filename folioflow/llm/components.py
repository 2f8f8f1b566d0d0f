"""Connected components of an edge table by alternating large and small stars.

Each round relinks every node's neighbours to the smallest node it knows of; the tables stay as long
as the edge list and the rounds are few (logarithmic in practice). Nothing is gathered per node: minima
are combined before they move, and each half-round is a join of two plain tables, so a node with a
large share of all edges is split by Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo") % (1 << 30))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge that isn't its component's smallest, with that smallest. Loops and repeated edges do nothing; rows with a null end are ignored."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _state(e)
    while before[0]:
        both = e.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(e.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, F.col("x") == F.col("k")).select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "k")
        small = large.join(least, F.col("hi") == F.col("k")).where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(small.unionAll(least.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
