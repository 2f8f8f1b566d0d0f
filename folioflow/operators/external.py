"""Models outside the engine (embedding, reranking, language models) as pluggable functions over Arrow batches, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.search import small_batches

DIMENSIONS = 64


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Unit vectors of signed word hashes."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    known: dict[str, int] = {}
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little")
            out[i, h % DIMENSIONS] += 1.0 if h >> 31 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size == 0, 1, size)).tolist()


def with_embedding(df: DataFrame, text_col: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """df with embedding and vector_status (vec, or vec_err where there is no text). The function is loaded once per worker and gets `batch` texts at a time."""

    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in embed(values[i : i + batch])], dtype=object)

    there = F.col(text_col).isNotNull() & (F.trim(text_col) != "")
    out = df.withColumn("embedding", F.when(there, run(F.col(text_col))))
    return out.withColumn("vector_status", F.when(there, "vec").otherwise("vec_err"))


def with_completion(df: DataFrame, prompt_col: str, complete: Callable[[list[str]], list[str]], out_col: str = "reply", batch: int = 8) -> DataFrame:
    """df with a language model's reply to each prompt (null for null). The function is loaded once per worker and gets `batch` prompts at a time."""

    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            known = prompts.dropna()
            replies = [r for i in range(0, len(known), batch) for r in complete(known.iloc[i : i + batch].tolist())]
            yield pd.Series(replies, index=known.index, dtype=object).reindex(prompts.index)

    return df.withColumn(out_col, run.asNondeterministic()(F.col(prompt_col)))


def with_rerank_score(df: DataFrame, query_col: str, text_col: str, score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 8) -> DataFrame:
    """df with rerank_score of each (query, text) pair. The scorer (a cross-encoder, say) is loaded once per worker and gets `batch` pairs at a time."""

    small_batches(df.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            pairs = [(q or "", t or "") for q, t in zip(queries, texts, strict=True)]
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in score(pairs[i : i + batch])], dtype="float64")

    return df.withColumn("rerank_score", run.asNondeterministic()(F.col(query_col), F.col(text_col)))


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """The offline rerank score: the share of the query's words that the text has."""
    words = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
    return [round(len(q & t) / len(q), 6) if q else 0.0 for q, t in words]


def offline_expander(prompts: list[str]) -> list[str]:
    """The offline reply to expand_queries' prompt: two rephrasings, a stock answer, one intent and the longest words."""
    out = []
    for p in prompts:
        q = p.rsplit("Question: ", 1)[-1].strip()
        entities = sorted(set(q.lower().split()), key=lambda w: (-len(w), w))[:2]
        out.append("```json\n" + json.dumps({"queries": [f"what is {q}", f"how does {q} work"], "hyde_answer": f"{q} is described here.", "intent": "DEFINITION", "entities": entities}) + "\n```")
    return out
