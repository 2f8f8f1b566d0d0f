"""Blind A/B experiment statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unblinded(score, is_x_a):
    """Scores are stored for X against Y; where X isn't A the sign turns."""
    return F.when(is_x_a, score).otherwise(-score)


def _p_value(positive: float, n: int, ties: float, exact: bool) -> float | None:
    """Two-sided Wilcoxon signed-rank p from the sum of positive ranks: exact for up to 50 untied differences, else normal with tie correction."""
    if n < 1:
        return None
    total = n * (n + 1) / 2
    low = min(positive, total - positive)
    if exact and n <= 50:
        ways = [1] + [0] * int(total)
        for r in range(1, n + 1):
            for s in range(int(total), r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, math.erfc(abs(positive - total / 2) / math.sqrt(var) / math.sqrt(2))) if var > 0 else None


def experiment_statistics(evaluations: DataFrame, by: str) -> DataFrame:
    """(by, n, win, tie, harm in percent, mean, median, p_value) of rows (by, score, is_x_a).

    Ranks of absolute differences come from counts per value: one row per (experiment, value), however many evaluations there are.
    """
    e = evaluations.select(by, unblinded(F.col("score"), F.col("is_x_a")).alias("s"))
    share = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count(F.lit(1)), 2)
    basic = e.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(F.col("s") > 0).alias("win"), share(F.col("s") == 0).alias("tie"), share(F.col("s") < 0).alias("harm"), F.round(F.avg("s"), 2).alias("mean"), F.median("s").alias("median"))
    values = e.where("s != 0").groupBy(by, F.abs("s").alias("a")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("s") > 0).alias("pos"))
    before = Window.partitionBy(by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    w = values.groupBy(by).agg(F.sum(F.col("pos") * F.col("rank")).alias("w"), F.sum("t").alias("m"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    zeros = e.groupBy(by).agg(F.count_if(F.col("s") == 0).alias("z")).withColumnRenamed(by, "_b0")

    @F.pandas_udf("double")
    def p(w: pd.Series, m: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else _p_value(a, int(b), c, c == 0 and d == 0) for a, b, c, d in zip(w, m, ties, z, strict=True)], dtype="float64")

    j = basic.join(w.withColumnRenamed(by, "_b1"), F.col(by).eqNullSafe(F.col("_b1")), "left").join(zeros, F.col(by).eqNullSafe(F.col("_b0")), "left")
    return j.select(*basic.columns, F.when(F.col("n") > 1, F.round(p("w", "m", "ties", "z"), 4)).alias("p_value"))
