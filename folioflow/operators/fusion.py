"""Rank fusion and score adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the rank of a row that a list doesn't have.
MISSING = 999_999
#: Intent, levels it favours, their boost, favoured length, its boost.
INTENTS = [
    ("DEFINITION", ["H2", "H3"], 0.03, "short", 0.01),
    ("MECHANISM", ["H3", "H4", "chunk"], 0.02, "long", 0.01),
    ("COMPARISON", ["H2", "H3"], 0.02, "medium", 0.01),
    ("APPLICATION", ["H4", "chunk", "sentence"], 0.02, "medium", 0.01),
    ("STUDY_DETAIL", ["H4", "chunk"], 0.03, "long", 0.01),
    ("CRITIQUE", ["H3", "H4"], 0.02, "medium", 0.01),
]


def rrf(lists: DataFrame, k: int = 50, top: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rrf_score, rank) of ranked lists (query_id, list_id, chunk_id, rank): sum of 1 / (k + rank); ties by first list, best rank, id."""
    s = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 10).alias("rrf_score"), F.min("list_id").alias("_l"), F.min("rank").alias("_r"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "_l", "_r", "chunk_id")
    s = s.withColumn("rank", F.row_number().over(w)).drop("_l", "_r")
    return s.where(F.col("rank") <= top) if top else s


def weighted_rrf(dense: DataFrame, lexical: DataFrame, k: int = 60, dense_weight: float = 0.5, lexical_weight: float = 0.5, by: str = "query_id") -> DataFrame:
    """Full outer join of two lists (by, id, rank): score, dense_rank, lexical_rank. Weights are scaled to 1; a missing rank counts as MISSING."""
    total = dense_weight + lexical_weight
    wd, wl = (dense_weight / total, lexical_weight / total) if total > 0 else (0.5, 0.5)
    d = dense.select(by, "id", F.col("rank").alias("dense_rank"))
    x = lexical.select(by, "id", F.col("rank").alias("lexical_rank"))
    score = F.lit(wd) / (F.lit(k) + F.coalesce("dense_rank", F.lit(MISSING))) + F.lit(wl) / (F.lit(k) + F.coalesce("lexical_rank", F.lit(MISSING)))
    return d.join(x, [by, "id"], "full_outer").withColumn("score", F.round(score, 10))


def two_list_rrf(dense: DataFrame, lexical: DataFrame, k: int = 60, top: int = 7, by: str = "heading_id") -> DataFrame:
    """Unweighted sum of the two reciprocal ranks, the best `top` per group."""
    one = lambda c: 1.0 / (F.lit(k) + F.coalesce(c, F.lit(MISSING)))
    f = weighted_rrf(dense, lexical, k, by=by).withColumn("rrf_score", F.round(one("dense_rank") + one("lexical_rank"), 10))
    w = Window.partitionBy(by).orderBy(F.desc("rrf_score"), "id")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(by, "id", "rrf_score", "rank")


def entity_boost(text: Column, entities: Column, boost: float = 0.05) -> Column:
    """boost for every entity that stands in the text, case-insensitively."""
    return F.size(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.contains(F.lower(text), F.lower(e)))) * F.lit(boost)


def intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTENTS, "intent string, levels array<string>, level_boost double, length string, length_boost double")


def intent_boost(df: DataFrame, intent_col: str = "intent", level_col: str = "level", text_col: str = "content") -> DataFrame:
    """df with intent_boost; unknown or null intents add nothing. The intent table has six rows."""
    table = F.broadcast(intents(df.sparkSession).withColumnRenamed("intent", "_intent"))
    n = F.length(text_col)
    length = F.when(F.col("length") == "short", n < 500).when(F.col("length") == "long", n > 800).when(F.col("length") == "medium", n.between(400, 900))
    out = df.join(table, df[intent_col] == table["_intent"], "left")
    boost = F.when(F.array_contains("levels", F.col(level_col)), F.col("level_boost")).otherwise(0.0) + F.when(length, F.col("length_boost")).otherwise(0.0)
    return out.withColumn("intent_boost", F.round(F.coalesce(boost, F.lit(0.0)), 4)).drop("_intent", "levels", "level_boost", "length", "length_boost")


def token_overlap(query: Column, text: Column) -> Column:
    """The offline rerank score: the share of the query's words that the text has."""
    q, t = (F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")) for x in (query, text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0))


def mmr(df: DataFrame, group: str, top: int, lam: float = 0.7, score: str = "score", id_col: str = "id", embedding: str = "embedding", normalised: bool = True) -> DataFrame:
    """(group, id, mmr_rank, mmr_score): greedy selection by lam * relevance - (1 - lam) * greatest similarity to what is chosen.

    normalised=True is the retrieval form: scores scaled to 0..1, similarity (cosine + 1) / 2, groups of at most
    `top` rows as they are; otherwise raw scores and cosines, and rows without a vector are left out. Groups are
    the candidates of one query or heading (a few dozen); rows reach the function best first.
    """
    import numpy as np
    import pandas as pd

    kind = df.schema[group].dataType.simpleString()
    cols = df.select(group, F.col(id_col).cast("long").alias("id"), F.col(score).cast("double").alias("score"), F.col(embedding).cast("array<double>").alias("v"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        if not normalised:
            pdf = pdf[pdf["v"].notna()]
        s = pdf["score"].to_numpy(float)
        if len(pdf) == 0 or normalised and len(pdf) <= top:
            return pd.DataFrame({group: pdf[group], "id": pdf["id"], "mmr_rank": range(1, len(pdf) + 1), "mmr_score": s})
        unit = np.zeros((len(pdf), max(len(v) if v is not None else 1 for v in pdf["v"])))
        for i, v in enumerate(pdf["v"]):
            if v is not None:
                size = np.linalg.norm(v)
                unit[i] = np.asarray(v) / size if size else 0.0
        sim = unit @ unit.T
        if normalised:
            s = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
            sim = (sim + 1) / 2
        sim = np.round(sim, 9)
        chosen, scores = ([0], [float(s[0])]) if normalised else ([], [])
        while len(chosen) < min(top, len(s)):
            worst = sim[:, chosen].max(axis=1) if chosen else np.zeros(len(s))
            value = np.round(lam * s - (1 - lam) * worst, 9)
            value[chosen] = -np.inf
            best = int(value.argmax())
            chosen.append(best)
            scores.append(float(value[best]))
        out = pdf.iloc[chosen]
        return pd.DataFrame({group: out[group].to_numpy(), "id": out["id"].to_numpy(), "mmr_rank": range(1, len(chosen) + 1), "mmr_score": scores})

    return cols.groupBy(group).applyInPandas(choose, f"{group} {kind}, id long, mmr_rank int, mmr_score double")
