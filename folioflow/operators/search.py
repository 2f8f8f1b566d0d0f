"""Ranked retrieval: batches of queries against chunks. Every top-k breaks ties by id."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ranked(df: DataFrame, k: int | None, *order: Column, by: str = "query_id") -> DataFrame:
    """df with rank from 1 in each `by` group, the first k only; the limit is pushed below the shuffle by Spark."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of one page by rank."""
    return df.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most 4 MB, so that a worker's memory doesn't depend on how long rows are. A lower limit of the session stays."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(key, str(most))


def searchable(chunks: DataFrame, min_sentences: int | None = None) -> DataFrame:
    """Chunks with a vector that search may use, optionally with enough sentences."""
    out = chunks.where(F.col("embedding").isNotNull() & F.col("dense_lexical_use"))
    return out if min_sentences is None else out.where(F.col("sentence_count").isNotNull() & (F.col("sentence_count") >= min_sentences))


#: Queries of a block, blocks that are broadcast together (larger sets go in several parts), and queries that are scored at a time.
BATCH, TOGETHER, AT_A_TIME = 1_024, 256, 128
#: Sums in another order differ by less; what could still be in a list by its rounded similarity is kept until it is known exactly.
SLACK = 2e-6


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, and their lengths; -1 for a vector that is null or holds a null, which is like nothing."""
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = vectors.flatten(), int(size.max(initial=0))
    if len(size) and (size == width).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), width), size
    out = np.zeros((len(size), width))
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or None in v:
            size[i] = -1
        else:
            out[i, : len(v)] = v
    return out, size


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a and b, summed one after the other as the column expressions do."""
    out = np.zeros(len(a))
    for j in range(min(a.shape[1], b.shape[1])):
        out += a[:, j] * b[:, j]
    return out


class _Block:
    """Vectors of a block of queries against those of a block of chunks."""

    def __init__(self, queries: pa.ListArray, chunks: pa.ListArray):
        (self.q, self.q_size), (self.c, self.c_size) = _matrix(queries), _matrix(chunks)
        self.q_norm, self.c_norm = np.sqrt(_summed(self.q, self.q)), np.sqrt(_summed(self.c, self.c))
        self.alike = len({*self.q_size.tolist(), *self.c_size.tolist()} - {-1}) <= 1

    def near(self, at: slice) -> np.ndarray:
        """Cosines of some queries with all chunks, to about 13 places."""
        width = min(self.q.shape[1], self.c.shape[1])
        out, by = self.q[at, :width] @ self.c[:, :width].T, np.outer(self.q_norm[at], self.c_norm)
        out = np.where(by == 0, 0.0, out / np.where(by == 0, 1.0, by))
        return out if self.alike else np.where(self.q_size[at, None] == self.c_size[None, :], out, 0.0)

    def exact(self, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        """Cosines of pairs as vector.cosine() has them, to the last bit."""
        out = np.empty(len(qi))
        for i in range(0, len(qi), 1 << 16):
            q, c = qi[i : i + (1 << 16)], ci[i : i + (1 << 16)]
            by = self.q_norm[q] * self.c_norm[c]
            v = np.where(by == 0, 0.0, _summed(self.q[q], self.c[c]) / np.where(by == 0, 1.0, by))
            out[i : i + len(q)] = v if self.alike else np.where(self.q_size[q] == self.c_size[c], v, 0.0)
        return out

    def rounded(self, value: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        """Millionths of cosines, halves away from zero; where it is close, by the exact cosine's decimals."""
        size = np.abs(value) * 1e6
        out = np.where(np.isfinite(value), np.sign(value) * np.floor(size + 0.5), np.inf)
        close = np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-3)
        for i, v in zip(close, self.exact(qi[close], ci[close]), strict=True):
            out[i] = float(Decimal(repr(float(v))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
        return out


def _best(block: _Block, near: np.ndarray, first: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, chunk) places of each query's k best chunks of the block by rounded cosine, then place; -inf is left out."""
    value = np.where(np.isnan(near), np.inf, near)
    least = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k, None] - SLACK if value.shape[1] > k else -np.inf
    qi, ci = np.nonzero((value >= least) & (value > -np.inf))
    order = np.lexsort((ci, -block.rounded(value[qi, ci], qi + first, ci), qi))
    qi, ci = qi[order], ci[order]
    kept = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[kept] + first, ci[kept]


def meeting(queries: DataFrame, chunks: DataFrame, meet: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], found: T.StructType) -> DataFrame:
    """What meet finds of every block of queries (query_id, ...) with every block of chunks (id, ...). It gets rows of whole blocks: a list for each column of chunks, by id, and _q, a list of the queries."""
    blocks = -(-max(queries.count(), 1) // BATCH)
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(*queries.columns)).alias("_q"))
    parts = -(-blocks // TOGETHER)
    small_batches(chunks.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                b = b.take(pc.sort_indices(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in b.columns], b.schema.names)

    rows = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in chunks.schema])
    each = [asked] if parts == 1 else [asked.where(F.pmod("_block", F.lit(parts)) == i) for i in range(parts)]
    met = [chunks.mapInArrow(pack, rows).crossJoin(F.broadcast(x.select("_q"))).mapInArrow(meet, found) for x in each]
    return functools.reduce(DataFrame.unionAll, met)


def _pairs(queries: DataFrame, chunks: DataFrame, pick: Callable[[_Block, np.ndarray, int], tuple[np.ndarray, np.ndarray]], cells: bool = False) -> DataFrame:
    """(query_id, id, similarity) of the pairs that pick finds in each pair of blocks. queries (query_id, qe) and chunks (id, embedding) become rows of whole blocks, and every block of queries
    meets every block of chunks, which is not shuffled. cells: chunks have a cell and queries a set of cells, and only those meet."""
    few, far = (["cell"], ["cells"]) if cells else ([], [])
    chunks, given = chunks.select("id", "embedding", *few), queries.select("query_id", "qe", *far)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = {name: b.column(name)[i].values for name in b.schema.names}
                ids, q = one["id"], one["_q"]
                query_ids, block = q.field("query_id"), _Block(q.field("qe"), one["embedding"])
                of = one["cell"].to_numpy() if cells else None
                wanted = q.field("cells").to_pylist() if cells else None
                for first in range(0, len(query_ids), AT_A_TIME):
                    near = block.near(slice(first, first + AT_A_TIME))
                    if cells:
                        near = np.where([np.isin(of, w) for w in wanted[first : first + AT_A_TIME]], near, -np.inf)
                    qi, ci = pick(block, near, first)
                    for j in range(0, len(qi), 1 << 16):
                        qs, cs = qi[j : j + (1 << 16)], ci[j : j + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(qs)), ids.take(pa.array(cs)), pa.array(block.exact(qs, cs))], ["query_id", "id", "_cos"])

    found = T.StructType([given.schema["query_id"], chunks.schema["id"], T.StructField("_cos", T.DoubleType())])
    return meeting(given, chunks, meet, found).select("query_id", "id", F.round("_cos", 6).alias("similarity"))


def nearest(queries: DataFrame, chunks: DataFrame, k: int, cells: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): the k chunks (id, embedding) nearest to each query (query_id, qe) by similarity (1 - cosine distance), rounded to 6 places; ties by id.

    Exact: every query is held against every chunk, block by block, and only the best of each block go on. queries is the stated set.
    """
    best = _pairs(queries, chunks, lambda block, near, first: _best(block, near, first, k), cells)
    return ranked(best, k, F.desc("similarity"), F.asc("id"))


def above(queries: DataFrame, chunks: DataFrame, bound: float) -> DataFrame:
    """(query_id, id, similarity) of all pairs of a query and a chunk more similar than the bound; only these leave the blocks."""

    def pick(_: _Block, near: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        qi, ci = np.nonzero(~(near <= bound - SLACK))
        return qi + first, ci

    return _pairs(queries, chunks, pick).where(F.col("similarity") > bound)


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = 19, min_sentences: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rank): the k nearest chunks of each query."""
    return nearest(queries, searchable(chunks, min_sentences), k).select("query_id", F.col("id").alias("chunk_id"), "rank")


def matching_results(questions: DataFrame, results: DataFrame, bound: float = 0.85) -> DataFrame:
    """(query_id, result_id, similarity, quality, rank): for each question (query_id, qe) the earlier results (result_id, embedding, quality) of questions more similar than the bound, best quality first."""
    quality = results.select("result_id", "quality")
    near = above(questions, results.select(F.col("result_id").alias("id"), "embedding"), bound).withColumnRenamed("id", "result_id").join(quality, "result_id")
    return ranked(near, None, F.desc("quality"), F.desc("similarity"), F.asc("result_id")).select("query_id", "result_id", "similarity", "quality", "rank")


def heading_priority(chunks: DataFrame, needle: str) -> DataFrame:
    """Chunks whose breadcrumb or content has the needle (case-insensitive), with priority 1 exact last heading, 2 part of it, 3 content, 4 elsewhere."""
    like = f"%{needle}%"
    last = F.element_at(F.split("heading_breadcrumbs", " > "), -1)
    hit = chunks.where(F.col("heading_breadcrumbs").ilike(like) | F.col("content").ilike(like))
    return hit.withColumn("priority", F.when(F.lower(last) == needle.lower(), 1).when(last.ilike(like), 2).when(F.col("content").ilike(like), 3).otherwise(4))

