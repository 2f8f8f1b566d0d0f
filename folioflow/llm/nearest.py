"""Approximate nearest neighbours: balanced posting lists around centroids.

A bounded sample is bisected into equally full cells; their means are the centroids. Every vector is put on the
list of its nearest centroid and, near a boundary, on the lists of up to `copies` centroids about as near. A graph over
the centroids, searched in memory by every task, finds near centroids; a query reads those lists whose centroids
are at most `probe_ratio` times as far as the nearest (a quarter of all lists at most, or 64), and goes on to farther lists
until those it reads hold k other rows. Where vectors have structure these are few; without any (uniform directions)
nothing but reading much gives recall. Lists and their queries meet in blocks of bounded size, whatever a list
holds. Equal vectors are one entry with their smallest ids (no query needs more than k + 1 of them), so copies don't
fill lists, and the number of lists follows the number of entries.

Sample bound: `sample` vectors drawn by a hash. Every vector is indexed. Within a block a matrix product, relative
to one of the block's vectors, gives rough distances; all within its rounding error of the k-th are measured exactly, on the
original values in double precision, so ties are never cut.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, rows without an id,
and vectors whose dimension isn't the commonest (smaller first among equals) take no part; ties go to the
smaller id; fewer than k candidates give fewer rows; rows that repeat an id and vector count once, and of different vectors under
one id the smallest (as arrays are ordered) is the query and the nearest is the candidate; distances beyond the range of
doubles are infinite and tie; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut

DEGREE = 24


# ---------------------------------------------------------------- the in-memory part: centroids and their graph


def balanced_centroids(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Means of k equally full cells: the fullest cell is bisected at the median of its principal direction."""
    rng = np.random.default_rng(seed)
    cells = [np.arange(len(x))]
    while len(cells) < k:
        cells.sort(key=len)
        cell = cells.pop()
        if len(cell) < 2:
            cells.append(cell)
            break
        y = x[cell] - x[cell].mean(axis=0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(8):  # power iteration
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = cell[np.argsort(y @ v, kind="stable")]
        cells += [order[: len(order) // 2], order[len(order) // 2 :]]
    return np.stack([x[c].mean(axis=0) for c in cells])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * a @ b.T, 0.0)


def placed(x: np.ndarray, shift: np.ndarray, scale: float) -> np.ndarray:
    """Vectors moved and scaled as the sample asks, so that neither far-off nor huge ones lose digits in squares; lists need no exact distances."""
    with np.errstate(over="ignore"):
        return np.clip((x - shift) / scale, -1e100, 1e100)


class CentroidGraph:
    """Neighbour graph of the centroids and a beam search over it for a batch of vectors."""

    def __init__(self, centroids: np.ndarray, seed: int = 0):
        self.c = np.asarray(centroids, dtype=np.float64)
        n = len(self.c)
        near = np.concatenate([np.argpartition(d, min(DEGREE, n - 1), axis=1)[:, : DEGREE + 1] for d in (squared(self.c[i : i + 512], self.c) for i in range(0, n, 512))])
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        self.links = np.concatenate([near, far, ((np.arange(n) + 1) % n)[:, None]], axis=1)
        self.entries = np.linspace(0, n - 1, min(n, 16)).astype(np.int64)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of about the `width` nearest centroids of each row, nearest first."""
        n = len(self.c)
        if n <= width:
            d = squared(x, self.c)
            ids = np.argsort(d, axis=1, kind="stable")
            return ids, np.take_along_axis(d, ids, axis=1)
        rows = np.arange(len(x))
        ids = np.tile(self.entries, (len(x), 1))
        d = squared(x, self.c[self.entries])
        open_ = np.ones(ids.shape, dtype=bool)
        while True:
            score = np.where(open_, d, np.inf)
            pick = score.argmin(axis=1)
            live = np.isfinite(score[rows, pick])
            if not live.any():
                break
            open_[rows[live], pick[live]] = False
            new = self.links[ids[live, pick[live]]]
            gap = self.c[new] - x[live][:, None, :]
            new_d = np.einsum("bld,bld->bl", gap, gap)
            seen = (new[:, :, None] == ids[live][:, None, :]).any(axis=2)
            first = np.argsort(new, axis=1, kind="stable")  # a link may repeat inside the row
            repeat = np.zeros(new.shape, dtype=bool)
            s = np.take_along_axis(new, first, axis=1)
            np.put_along_axis(repeat, first[:, 1:], s[:, 1:] == s[:, :-1], axis=1)
            new_d = np.where(seen | repeat, np.inf, new_d)
            all_ids, all_d = np.full((len(x), ids.shape[1] + new.shape[1]), 0), np.full((len(x), ids.shape[1] + new.shape[1]), np.inf)
            all_open = np.zeros(all_d.shape, dtype=bool)
            m = ids.shape[1]
            all_ids[:, :m], all_d[:, :m], all_open[:, :m] = ids, d, open_
            all_ids[live, m:], all_d[live, m:], all_open[live, m:] = new, new_d, np.isfinite(new_d)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids, d, open_ = (np.take_along_axis(a, keep, axis=1) for a in (all_ids, all_d, all_open))
        return ids, d


def lists_of_queries(graph: CentroidGraph, x: np.ndarray, width: int, ratio: float, most: int, held: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """within(), and further lists in order of distance until the lists of a row hold `need` rows (held: rows of each list, each row counted once), or all lists."""
    ids, d = graph.search(x, max(width, most))
    enough = held[ids].cumsum(axis=1) >= need
    take = d <= d[:, :1] * ratio * ratio
    take[:, most:] = False
    take[:, 0] = True
    take |= np.arange(ids.shape[1]) <= np.where(enough.any(axis=1), enough.argmax(axis=1), ids.shape[1])[:, None]
    i, j = np.nonzero(take)
    rows, lists = [i], [ids[i, j]]
    for r in np.flatnonzero(~enough.any(axis=1)) if ids.shape[1] < len(graph.c) else ():  # what the search found is too little: all lists by distance
        order = np.argsort(squared(x[r : r + 1], graph.c)[0], kind="stable")
        upto = np.searchsorted(held[order].cumsum(), need) + 1
        rest = np.setdiff1d(order[:upto], ids[r])
        rows.append(np.full(len(rest), r))
        lists.append(rest)
    return np.concatenate(rows), np.concatenate(lists)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b; where squares leave the range of doubles, of scaled differences."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        gap = a - b
        out = np.sqrt((gap * gap).sum(axis=1))
        top = np.abs(gap).max(axis=1)
        odd = ((out == np.inf) | (out < 1e-140)) & np.isfinite(top) & (top > 0)
        if odd.any():
            scaled = gap[odd] / top[odd, None]
            out[odd] = top[odd] * np.sqrt((scaled * scaled).sum(axis=1))
    return np.where(np.isnan(out), np.inf, out)


def block_nearest(q: np.ndarray, own: np.ndarray, e: np.ndarray, ids: np.ndarray, entry: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance): the k nearest of a block's ids for each query, but its own. ids[i] are of the vector e[entry[i]]; entry is sorted."""
    found: list[tuple] = []
    first = np.searchsorted(entry, np.arange(len(e) + 1))
    for at in range(0, len(q), 256):
        x = q[at : at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            a, b = x - e[0], e - e[0]
            aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            rough = aa[:, None] + bb - 2.0 * a @ b.T
            slack = 1e-13 * len(e[0]) * (aa + bb.max())
        if np.isfinite(rough).all() and rough.shape[1] > k + 1:
            near = rough <= (np.partition(rough, k, axis=1)[:, k] + slack)[:, None]
        else:
            near = np.ones(rough.shape, dtype=bool)
        i, j = np.nonzero(near)
        exact = np.concatenate([distances(x[i[p : p + 20_000]], e[j[p : p + 20_000]]) for p in range(0, len(i), 20_000)])
        n = first[j + 1] - first[j]
        row = np.repeat(i, n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[j], n)
        vec, score = ids[place], np.repeat(exact, n)
        other = vec != own[at : at + 256][row]
        row, vec, score = row[other], vec[other], score[other]
        order = np.lexsort((vec, score, row))
        row, vec, score = row[order], vec[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((row[rank < k] + at, vec[rank < k], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def within(graph: CentroidGraph, x: np.ndarray, width: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lists): for each row of x the nearest list and, up to `most`, those of centroids within ratio of its distance."""
    ids, d = graph.search(x, max(width, most))
    i, j = np.nonzero(d[:, :most] <= d[:, :1] * ratio * ratio)
    return i, ids[i, j]


# ---------------------------------------------------------------- the distributed part


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0))
    dims = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vec") == (dims["n"] if dims else -1))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))


def nearest(
    vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = 200, sample: int = 40_000,
    max_lists: int = 10_000, copies: int = 4, copy_ratio: float = 1.2, probe_ratio: float = 1.28, block: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of vectors that the condition `queries` (a Column over id) picks."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    few = Window.partitionBy("vec").orderBy("id")
    entries = rows.distinct().withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = cut(entries)
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    drawn = entries.where(F.shiftrightunsigned(F.xxhash64(F.lit(10), "vec"), 11).cast("double") / float(1 << 53) < min(1.0, sample / n)).select("vec")
    found = [r[0] for r in drawn.limit(2 * sample).collect()] or [entries.select("vec").first()[0]]  # 2 * sample: never reached but by chance; a bound for the driver
    x = np.array(found, dtype=np.float64)
    x = x[np.lexsort(x.T[::-1])]  # the same whatever order the rows came in
    shift = x[len(x) // 2]
    with np.errstate(over="ignore"):
        scale = float(min(np.abs(x - shift).max(), 1e308)) or 1.0
    centroids = balanced_centroids(placed(x, shift, scale), max(1, min(max_lists, n // list_rows, len(x) // 4)))
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))

    def to_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                i, lists = within(graph.value, placed(_stack(part["vec"]), shift, scale), 32, copy_ratio, copies)
                out = part.iloc[i].copy()
                out["list"] = lists
                out["main"] = np.r_[True, i[1:] != i[:-1]]  # the first list of each
                yield out

    posted = cut(entries.mapInPandas(to_lists, "vec array<double>, ids array<long>, list int, main boolean"))
    held = np.zeros(len(centroids), dtype=np.int64)
    for r in posted.where("main").groupBy("list").agg(F.sum(F.size("ids"))).collect():  # at most max_lists rows
        held[r[0]] = r[1]
    shared = spark.sparkContext.broadcast(held)

    def to_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                i, lists = lists_of_queries(graph.value, placed(_stack(part["vec"]), shift, scale), 64, probe_ratio, max(64, len(graph.value.c) // 4), shared.value, k + 1)
                out = part.iloc[i].copy()
                out["list"] = lists
                yield out

    asked = cut(rows.where(queries(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec")).mapInPandas(to_probes, "id long, vec array<double>, list int"))
    # at most max_lists rows: how many blocks each list and its queries are dealt to
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).join(
        asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "list")
    sizes = F.broadcast(sizes)
    left = posted.join(sizes, "list").select("list", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "vec", "ids")
    right = asked.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("p"), "vec", "id")

    def compare(entries_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if not len(entries_) or not len(asked_):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = entries_["ids"].to_list()
        own = asked_["id"].to_numpy(np.int64)
        entry = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        row, vec, score = block_nearest(_stack(asked_["vec"]), own, _stack(entries_["vec"]), np.concatenate(ids).astype(np.int64), entry, k)
        return pd.DataFrame({"query_id": own[row], "vec_id": vec, "score": score})

    pairs = left.groupBy("list", "b", "p").cogroup(right.groupBy("list", "b", "p")).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
