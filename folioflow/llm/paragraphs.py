"""Substring dedup: MinHash banding of paragraphs, alignment, components.

Repeated passages start and end anywhere in a line, so paragraphs are not lines: every run of window + length - 1 (25) words
of a document is a paragraph. Its MinHash is the smallest hash of its `window` shingles of `length` (10) words, and
neighbours mostly have the same one, so a document posts about one in 8.5 words.

Tuning the bands: one band of one row gives full recall here. Two paragraphs collide if they are equal, and any two passages
of 50 words or more whose five-word shingles have a Jaccard similarity of 0.8 have 25 equal words in a row: c changes
inside n words leave a similarity of at most (n - 4 - 5c) / (n - 4 + 5c), so n >= 45c + 4, and the longest run between
changes has (n - c) / (c + 1) words, 25 at least (with c = 1; more otherwise). More rows would lose changed passages,
more bands would find the same ones again.

1. Paragraphs with equal MinHash are one list. Each is compared with the list's first place, and with the one before it in a
   part of the list (lists are dealt to parts of about PART places by a hash of the document, so none is one task).
2. Verification: comparisons of the same two documents that are close together are one run. Of each run, and REACH words around
   it, both documents' words are aligned: equal words, and after a difference the nearest equal shingle at most GAP words on.
   A stretch of an alignment counts as repeated if it has min_words (50) words in both and the Jaccard similarity of its
   five-word shingles is 0.8 or more.
3. The other pairs of a list: paragraphs inside no repeated stretch yet are compared with every place of their list in a smaller
   document if it has at most PART places. In longer lists they get longer keys: every 50 words in a row, and the MinHash
   together with each shingle near it; these lists are gone through as before. (Paragraphs inside a stretch are removed
   already; what another document shares with them beyond the stretch's end has paragraphs of its own, or is under 40 words and may stay.)
4. Stretches that touch or overlap make one span. A span that repeats a document with a smaller id is removed.
   Linked spans are clustered by connected components; the cluster is named by its smallest document, which keeps its text.

A changed passage, not an equal one, can still be missed if more than PART documents share its unchanged parts and
all of its longer keys have their first places in documents that don't have the passage. Words are compared by 64-bit hashes,
in alignments by 32 bits of them.

Defined results: null and empty texts, and texts under min_words, lose nothing; repeats inside one
document stay; rows with a null id lose nothing and nothing is removed for their sake; rows that repeat an id are
one document (rows with different texts under one id lose the words at its spans in each); a text of any length is compared
whole; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, cut, mix64, remove_path, shared_path, shingle_hashes, small_batches, tidy, word_hashes
from folioflow.llm.components import components

SHINGLE = 5
#: Rows of a list of what is asked of documents up to which it is broadcast (some 20 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Places of a list up to which all of its pairs may be compared; longer lists are dealt to parts of about so many.
PART = 32
#: Words around a run that are compared; equal words further out have seeds of their own.
REACH = 64
#: Words that a change inside a passage may take up in either document.
GAP = 16
#: Blocks of an alignment that are weighed against each other at a time.
BLOCKS = 512

_WORD = re.compile(WORD)


def anchors(shingles: np.ndarray, window: int, docs: np.ndarray | None = None) -> np.ndarray:
    """Positions that are the (rightmost) smallest of some `window` shingles in a row, all of one document (docs: each shingle's, in order; None: all of one).

    Where a text repeats itself over and over, one shingle is the smallest again and again: of such a row of equal
    anchors only the first in each `window` words counts.
    """
    if len(shingles) < window:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(shingles, window)
    at = np.arange(window - 1, len(shingles)) - view[:, ::-1].argmin(axis=1)
    if docs is not None:
        at = at[docs[window - 1 :] == docs[: len(docs) - window + 1]]
    if not len(at):
        return at
    at = at[np.r_[True, at[1:] != at[:-1]]]  # they never go back
    other = docs[at[1:]] != docs[at[:-1]] if docs is not None else False
    new = np.r_[True, (shingles[at[1:]] != shingles[at[:-1]]) | (at[1:] - at[:-1] >= window) | other]
    row = np.cumsum(new) - 1
    part = (at - at[new][row]) // window
    new[1:] |= part[1:] != part[:-1]
    return at[new]


def wide(shingles: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` words at each place, from the hashes of its shingles."""
    n = len(shingles) - (length - SHINGLE)
    out = np.full(max(n, 0), length, dtype=np.uint64)
    for j in sorted({*range(0, length - SHINGLE, SHINGLE), length - SHINGLE}) if n > 0 else ():
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + shingles[j : j + n])
    return out


def _documents(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of a batch with a text column."""
    texts = [t if isinstance(t, str) else None for t in batch["text"]]
    for first, n, docs, hashes in word_hashes(texts):
        edge = np.searchsorted(docs, np.arange(n + 1))
        for i in range(n):
            yield first + i, hashes[edge[i] : edge[i + 1]]


def posted_seeds(docs: DataFrame, window: int, length: int) -> DataFrame:
    """(key, doc_id, pos): the distinct MinHashes of every document's paragraphs and where they stand."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for first, n, doc, hashes in word_hashes([t if isinstance(t, str) else None for t in batch["text"]]):
                if len(hashes) < length + window - 1:
                    continue
                whole = wide(shingle_hashes(hashes, SHINGLE), length)  # over all texts of the run; those that cross an edge go
                inside = np.flatnonzero(doc[length - 1 :] == doc[: len(doc) - length + 1])
                at = inside[anchors(whole[inside], window, doc[inside])]
                start = np.searchsorted(doc, np.arange(n))
                yield pd.DataFrame({"key": whole[at].view(np.int64), "doc_id": ids[first + doc[at]], "pos": (at - start[doc[at]]).astype(np.int32)})

    return docs.mapInPandas(tidy(work), "key long, doc_id long, pos int")


def asked_of(docs: DataFrame, asked: DataFrame, what: str) -> DataFrame:
    """(doc_id, text, asks): the documents that asked (doc_id, what...) names, each with all that is asked of it (at most its own places)."""
    asked = cut(asked)
    few = asked.count() <= BROADCAST_ROWS
    per_doc = asked.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(what).alias("asks"))
    return docs.join(F.broadcast(per_doc) if few else per_doc, docs["doc_id"] == F.col("_id")).select("doc_id", "text", "asks")


def lists_of(posted: DataFrame) -> DataFrame:
    """(key, doc_id, pos, n, first, last): posted (key, doc_id, pos) of keys in several documents, with the places of the list, its first
    place and the one before in this part of it (null where not in a smaller document).

    Counts and first places are combined before they move, and the join's sides are plain tables, so a key in a
    third of all documents is split.
    """
    spark = posted.sparkSession
    small_batches(spark)
    path = shared_path(spark, "keys")
    posted.write.parquet(path)
    posted = spark.read.parquet(path)
    place = F.struct("doc_id", "pos")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max("doc_id").alias("hi")).where("first.doc_id != hi")
    lists = cut(lists.select(F.col("key").alias("_key"), "n", "first"))
    found = posted.join(lists, F.col("key") == F.col("_key")).drop("_key").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / PART)))
    before = Window.partitionBy("key", "part").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("last", F.max(place).over(before)).withColumn("first", F.when(F.col("first.doc_id") < F.col("doc_id"), F.col("first"))).drop("part")
    found = cut(found)
    remove_path(spark, path)
    return found


def candidates(found: DataFrame) -> DataFrame:
    """(doc_id, pos, owner, owner_pos): places to be compared, of what lists_of() found."""
    both = found.select("doc_id", "pos", F.explode(F.array("first", "last")).alias("o")).where("o is not null")
    return both.select("doc_id", "pos", F.col("o.doc_id").alias("owner"), F.col("o.pos").alias("owner_pos")).distinct()


def other_pairs(found: DataFrame, uncovered: DataFrame) -> DataFrame:
    """(doc_id, pos, owner, owner_pos) of uncovered places with all others of their lists, up to PART places."""
    x = uncovered.where(F.col("n") <= PART).where("first is not null").select("key", "doc_id", "pos", "first", "last")
    y = found.where(F.col("n") <= PART).select("key", F.col("doc_id").alias("owner"), F.col("pos").alias("owner_pos"))
    known = lambda o: F.col("owner").eqNullSafe(F.col(f"{o}.doc_id")) & F.col("owner_pos").eqNullSafe(F.col(f"{o}.pos"))
    return x.join(y, "key").where("owner < doc_id").where(~known("first") & ~known("last")).select("doc_id", "pos", "owner", "owner_pos").distinct()


def runs_of(pairs: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, stop, owner, owner_start, owner_stop, seeds): places close together in both documents as one run, with what surrounds it; seeds are pos and owner_pos in one number."""
    packed = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("owner_pos")
    per_pair = pairs.groupBy("doc_id", "owner").agg(F.collect_set(packed).alias("seeds"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, owner, seeds in zip(batch["doc_id"], batch["owner"], batch["seeds"], strict=True):
                seeds = np.sort(seeds)
                a, b = seeds >> 32, seeds & 0xFFFFFFFF
                edge = np.flatnonzero((np.diff(a) > 2 * REACH) | (np.abs(np.diff(b - a)) > REACH)) + 1
                for s, t in zip(np.r_[0, edge], np.r_[edge, len(seeds)], strict=True):
                    out.append((doc, *_around(a[s:t], length), owner, *_around(b[s:t], length), seeds[s:t]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "owner", "owner_start", "owner_stop", "seeds"])

    return per_pair.mapInPandas(tidy(split), "doc_id long, start int, stop int, owner long, owner_start int, owner_stop int, seeds array<long>")


def _around(at: np.ndarray, length: int) -> tuple[int, int]:
    """The words from REACH before the first place to REACH after the last one, in steps of 32 so that many ask for the same."""
    return max(0, int(at.min()) - REACH) // 32 * 32, -(-(int(at.max()) + length + REACH) // 32) * 32


_ODD = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)


class Sides:
    """Two word sequences that are aligned, with hashes of their shingles, made when a difference asks for them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    @cached_property
    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        both = []
        for w in (self.x, self.y):
            n = max(0, len(w) - SHINGLE + 1)
            w = w.astype(np.uint64)
            both.append(sum(w[k : k + n] * _ODD[k] for k in range(SHINGLE)))
        return both[0], both[1]


def chain(s: Sides, i: int, j: int) -> list[tuple[int, int, int]]:
    """Blocks (place in x, place in y, words) of equal words from (i, j) on; after each, the nearest equal shingle at most GAP words further on in both."""
    x, y, out = s.x, s.y, []
    while True:
        m = min(len(x) - i, len(y) - j)
        equal = x[i : i + m] == y[j : j + m]
        n = m if equal.all() else int(equal.argmin())
        out.append((i, j, n))
        i, j = i + n, j + n
        if i > len(x) - SHINGLE or j > len(y) - SHINGLE:
            return out
        sx, sy = s.shingles
        a, b = np.nonzero(sx[i : i + GAP + 1, None] == sy[None, j : j + GAP + 1])
        if not len(a):
            return out
        k = int(np.argmin((a + b) * (GAP + 1) + a))
        i, j = i + int(a[k]), j + int(b[k])


def alike(blocks: list[tuple[int, int, int]], percent: int, min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, stop) in x and in y: the longest stretch of whole blocks, of at least min_words in both texts, whose shingles' Jaccard similarity reaches percent; then the same left and right of it."""
    if not blocks or blocks[-1][0] + blocks[-1][2] - blocks[0][0] < min_words:
        return []
    if len(blocks) == 1:
        (i, j, n), = blocks
        return [(i, i + n, j, j + n)]
    i, j, n = np.array(blocks, dtype=np.int64).T
    equal = np.r_[0, np.cumsum(np.maximum(n - SHINGLE + 1, 0))]
    wx, wy = (i + n)[None, :] - i[:, None], (j + n)[None, :] - j[:, None]
    same = equal[None, 1:] - equal[:-1, None]
    ok = (wx >= min_words) & (wy >= min_words) & (100 * same >= percent * (wx + wy - 2 * (SHINGLE - 1) - same))
    if not ok.any():
        return []
    p, q = np.unravel_index(int(np.where(ok, wx, -1).argmax()), ok.shape)
    return [*alike(blocks[:p], percent, min_words), (int(i[p]), int(i[q] + n[q]), int(j[p]), int(j[q] + n[q])), *alike(blocks[q + 1 :], percent, min_words)]


def aligned(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], percent: int, min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, stop) in x and in y of the passages that stand in both with small changes, from places that are equal in both."""
    ahead, back = Sides(x, y), Sides(x[::-1], y[::-1])
    seen: list[tuple[int, int, int]] = []
    out = []
    for i, j in seeds:
        if i >= len(x) or j >= len(y) or x[i] != y[j] or any(a <= i < a + n and i - a == j - b for a, b, n in seen):
            continue
        left = [(len(x) - a - n, len(y) - b - n, n) for a, b, n in chain(back, len(x) - i, len(y) - j)][::-1]
        right = chain(ahead, i, j)
        (a, b, n), (_, _, m) = left.pop(), right.pop(0)
        blocks = [*left, (a, b, n + m), *right]
        seen += blocks
        for s in range(0, len(blocks), BLOCKS // 2):
            out += alike(blocks[s : s + BLOCKS], percent, min_words)
            if s + BLOCKS >= len(blocks):
                break
    return out


def passages(pairs: DataFrame, docs: DataFrame, length: int, percent: int, min_words: int) -> DataFrame:
    """(doc_id, start, stop, owner, owner_start, owner_stop): of the candidates, the passages that stand in the owner with small changes."""
    runs = cut(runs_of(pairs, length))
    sides = runs.select("doc_id", "start", "stop").unionAll(runs.select("owner", "owner_start", "owner_stop")).distinct()
    texts = asked_of(docs, sides.withColumn("ask", F.struct("start", "stop")), "ask")

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for i, hashes in _documents(batch):
                for ask in batch["asks"].iloc[i]:
                    out.append((batch["doc_id"].iloc[i], ask["start"], ask["stop"], hashes[ask["start"] : ask["stop"]].astype(np.uint32).tobytes()))
                    size += len(out[-1][3])
                    if size > 8 << 20:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "words"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "words"])

    found = cut(texts.mapInPandas(tidy(regions), "doc_id long, start int, stop int, words binary").distinct())
    own = found.withColumnRenamed("words", "x")
    other = found.select(F.col("doc_id").alias("owner"), F.col("start").alias("owner_start"), F.col("stop").alias("owner_stop"), F.col("words").alias("y"))
    both = runs.join(own, ["doc_id", "start", "stop"]).join(other, ["owner", "owner_start", "owner_stop"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, start, owner, owner_start, seeds, x, y in batch.itertuples(index=False, name=None):
                at = [((s >> 32) - start, (s & 0xFFFFFFFF) - owner_start) for s in seeds.tolist()]
                spans = aligned(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), at, percent, min_words)
                out += [(doc, start + a, start + b, owner, owner_start + c, owner_start + d) for a, b, c, d in spans]
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "owner", "owner_start", "owner_stop"])

    return both.select("doc_id", "start", "owner", "owner_start", "seeds", "x", "y").mapInPandas(tidy(compare), "doc_id long, start int, stop int, owner long, owner_start int, owner_stop int")


def outside(found: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """The places that are inside none of their document's spans."""
    per_doc = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start"] <= F.col("pos")) & (F.col("pos") + length <= s["stop"]))
    return found.join(per_doc, F.col("doc_id") == F.col("_id"), "left").where(~F.coalesce(inside, F.lit(False))).drop("_id", "spans")


def longer_keys(found: DataFrame, uncovered: DataFrame, docs: DataFrame, window: int, length: int, min_words: int) -> DataFrame:
    """(key, doc_id, pos): for uncovered places of lists over PART places, every min_words words in a row around the place (but
    those with a place inside that no other document has), and the MinHash together with each shingle near it."""
    opened = cut(uncovered.where(F.col("n") > PART).select("doc_id", F.col("pos").alias("open_pos")).distinct())
    places = found.select("doc_id", "pos").join(opened.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = places.select("doc_id", (F.col("pos").cast("long") * 2).alias("ask")).unionAll(opened.select("doc_id", (F.col("open_pos").cast("long") * 2 + 1).alias("ask")))
    texts = asked_of(docs, asked, "ask")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, hashes in _documents(batch):
                asks = np.sort(batch["asks"].iloc[i])
                opened = np.unique((asks >> 1)[asks & 1 == 1])
                opened = opened[opened <= len(hashes) - length]
                if not len(opened):
                    continue
                shingles = shingle_hashes(hashes, SHINGLE)
                seeds = wide(shingles, length)
                whole = wide(shingles, min_words)
                at = np.unique((opened[:, None] - np.arange(min_words - length + 1)).ravel())
                alone = np.setdiff1d(anchors(seeds, window), asks >> 1)
                no = (alone[:, None] - np.arange(window - 1, min_words - length - window + 2)).ravel()
                at = np.setdiff1d(at[(at >= 0) & (at < len(whole))], no)
                near = anchors(shingles, SHINGLE + 1)
                lo, hi = np.searchsorted(near, opened - REACH), np.searchsorted(near, opened + length + REACH)
                a = np.repeat(opened, hi - lo)
                b = near[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])]
                out = (b < a) | (b > a + length - SHINGLE)
                a, b = a[out], b[out]
                both = mix64(seeds[a] * np.uint64(0x9FB21C651E98DF25) + shingles[b] + (b > a))
                pos = np.concatenate((at, a)).astype(np.int32)
                yield pd.DataFrame({"key": np.concatenate((whole[at], both)).view(np.int64), "doc_id": batch["doc_id"].iloc[i], "pos": pos})

    return texts.mapInPandas(tidy(work), "key long, doc_id long, pos int")


def clusters_of(spans: DataFrame) -> DataFrame:
    """(doc_id, start, cluster): the documents' linked stretches, merged, with the smallest document of their component.

    spans as passages() gives them; both sides of each are a piece of a stretch, and their stretches are linked.
    """
    spans = spans.withColumn("link", F.monotonically_increasing_id())  # stable: spans are checkpointed
    pieces = spans.select("doc_id", "start", "stop", "link").unionAll(spans.select("owner", "owner_start", "owner_stop", "link"))
    nodes = islands(pieces).select("link", F.struct("doc_id", F.col("island").alias("start")).alias("node"))
    edges = nodes.groupBy("link").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    return components(edges).select(F.col("node.doc_id").alias("doc_id"), F.col("node.start").alias("start"), F.col("component.doc_id").alias("cluster"))


def islands(pieces: DataFrame) -> DataFrame:
    """pieces (doc_id, start, stop, ...) with island: where the run of touching or overlapping pieces begins."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_new", F.when(F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1)), F.col("start")))
    return pieces.withColumn("island", F.last("_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def passage_links(docs: DataFrame, window: int = 16, length: int = 10, percent: int = 80, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, owner, owner_start, owner_stop), in words: passages that a document shares with one of a smaller id."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    found = lists_of(posted_seeds(docs, window, length))
    spans = cut(passages(candidates(found), docs, length, percent, min_words))
    uncovered = cut(outside(found, spans, length))
    longer = lists_of(longer_keys(found, uncovered, docs, window, length, min_words))
    return cut(spans.unionAll(passages(other_pairs(found, uncovered).unionAll(candidates(longer)).distinct(), docs, length, percent, min_words)))


def repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, spans): per document that repeats others, its removed spans of at least min_words (start, stop in words; owner: the smallest
    id found to have the passage or a part of it; cluster: the smallest id of the component), merged and in order."""
    spans = passage_links(docs, **options)
    merged = islands(spans.select("doc_id", "start", "stop", "owner")).groupBy("doc_id", "island").agg(F.max("stop").alias("stop"), F.min("owner").alias("owner"))
    stretch = clusters_of(spans).withColumnRenamed("start", "at")
    inside = merged.join(stretch, "doc_id").where("at <= island")  # a removed span is inside one stretch of its document: the last that begins before it
    merged = inside.groupBy("doc_id", F.col("island").alias("start"), "stop", "owner").agg(F.max_by("cluster", "at").alias("cluster"))
    return merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "owner", "cluster"))).alias("spans"))


def without_spans(text: str, spans) -> str:
    """The text without the words of the spans; what is left closes up, with one line break where the span had some."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        a, b = s["start"], min(s["stop"], len(words))
        if a >= b:
            continue
        out.append(text[at : words[a][0]].rstrip(" \t"))
        at = words[b - 1][1]
        tail = text[at : words[b][0]] if b < len(words) else ""
        head = out[-1]
        if not head or head.endswith("\n"):
            at += len(tail) - len(tail.lstrip(" \t\r\n"))
        elif "\n" in tail:
            at += len(tail) - len(tail.lstrip(" \t"))
        else:
            at += len(tail)
            out.append("" if not tail else "\n" if "\n" in text[words[a][0] : at] else " ")
    out.append(text[at:])
    return "".join(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with removed_words, spans (null: none) and clean_text."""
    docs = docs.drop("removed_words", "spans", "clean_text")
    spans = cut(repeated_spans(docs, id_col=id_col, text_col=text_col, **options).withColumnRenamed("doc_id", "__doc"))
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    out = docs.join(spans, docs[id_col] == spans["__doc"], "left").drop("__doc")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else without_spans(t, s) for t, s in zip(texts, all_spans, strict=True)], dtype=object)

    once = clean.asNondeterministic()  # so that filters on the result don't run it again, in a second worker
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return out.withColumns({"removed_words": F.coalesce(removed, F.lit(0)), "clean_text": F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(once(F.col(text_col), F.col("spans")))})
