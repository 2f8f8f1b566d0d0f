"""Quality rules: base statistics of a text, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of white space as one space; digits stay, so rows of tables, dates and
numbered lines are different lines) and hashed. For each host (a column, here the source) the distinct documents of
every line are counted; rows of a host with equal texts are one document, as whole copies are not boilerplate. A line is
boilerplate if it is in more documents of its host than a limit: `share` of them, but `least` at the least and `most` at the
most, so that on a host of any size a line in more than `most` documents goes. Such lines are removed, and a document
that keeps less than `left` of its words is rejected.

Each text is read once, in Python: statistics and hashes of lines come out, and only these move.

Defined results: a null or empty text has no words and so fails the base rules; a null host is a host; repeated rows
each get their result; lines without a word are never boilerplate; a text of any length is read whole; an empty table gives
an empty table; further columns pass through (the names that are added replace those present). Two different lines with
one 64-bit hash would count as one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, cut, small_batches

_WORDS = re.compile(WORD).findall
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of the list of boilerplate lines up to which it is broadcast (some 40 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words inside a window of so many words that is in the text at least twice (the first time included).

    Words become numbers, then pairs, fours and eights of neighbours do: equal number, equal window.
    """
    if len(words) <= window:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    width = 1
    while width < window:
        ids = np.unique(ids[:-width] * (ids.max() + 1) + ids[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def line_hash(words: list[str]) -> int:
    """Hash of a line's normalised form."""
    return _hash(" ".join(words).encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only


def text_stats(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text, and {hash of a line: its words in the text}."""
    words, seen, dup, lines = [], set(), 0, {}
    for line in (text or "").split("\n"):
        own = _WORDS(line)
        if own:
            dup += line in seen
            seen.add(line)
            words += own
            h = line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    symbols = len(text) - len(text.translate(_SYMBOLS)) if text else 0
    return len(words), sum(map(len, words)), symbols, dup, repeated_words(words), lines


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with the BASE statistics, text_hash and lines (hash, words)."""
    small_batches(docs.sparkSession)
    added = [*BASE, "text_hash", "lines"]
    kind = ", ".join(f"{n} long" for n in BASE) + ", text_hash long, lines array<struct<h: long, words: long>>"

    @F.pandas_udf(kind)
    def stats(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            *base, lines = text_stats(t)
            rows.append((*base, _hash((t or "").encode("utf-8", "surrogatepass")), [{"h": h, "words": n} for h, n in lines.items()]))
        return pd.DataFrame(rows, columns=added)

    keep = [c for c in keep if c not in added]
    return docs.select(*keep, stats.asNondeterministic()(docs[text_col]).alias("__stats")).select(*keep, "__stats.*")


def base_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with the BASE statistics."""
    return measured(docs, keep, text_col).drop("text_hash", "lines")


def boilerplate(rows: DataFrame, least: int = 10, share: float = 0.002, most: int = 1_000, host_col: str = "source") -> DataFrame:
    """(host, h): hashes of the lines over the limits, of what measured() gives. Counts are combined before they move, so a line in every document costs one row a task."""
    docs = rows.select(F.col(host_col).alias("host"), "text_hash", "lines")
    lines = docs.select("host", "text_hash", F.explode("lines.h").alias("h")).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    hosts = docs.select("host", "text_hash").distinct().groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("docs"))
    limit = F.greatest(F.lit(least), F.least(F.col("docs") * share, F.lit(most)))
    return lines.join(hosts, lines["host"].eqNullSafe(hosts["__host"])).where(F.col("n") > limit).select("host", "h")


def quality(
    docs: DataFrame, keep: list[str], least: int = 10, share: float = 0.002, most: int = 1_000, left: float = 0.5,
    min_words: int = 20, max_repeat: int = 30, text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """keep columns of docs, BASE, removed_words, removed_lines, base_failed and kept (base passed and at least `left` of the words stay)."""
    added = [*BASE, "removed_words", "removed_lines", "base_failed", "kept"]
    keep = [c for c in keep if c not in added]
    rows = cut(measured(docs.withColumn("__host", F.col(host_col)), [*keep, "__host"], text_col)).withColumn("__row", F.monotonically_increasing_id())  # stable: read from the checkpoint
    common = cut(boilerplate(rows, least, share, most, "__host").select(F.col("host").alias("_h"), F.col("h").alias("_l")))
    if common.count() <= BROADCAST_ROWS:
        common = F.broadcast(common)
    lines = rows.select("__row", "__host", F.inline("lines"))
    hit = lines.join(common, (lines["h"] == common["_l"]) & lines["__host"].eqNullSafe(common["_h"]))
    lost = hit.groupBy(F.col("__row").alias("__r")).agg(F.sum("words").alias("removed_words"), F.collect_list("h").alias("removed_lines"))
    out = rows.drop("lines", "text_hash").join(lost, F.col("__row") == F.col("__r"), "left").drop("__host", "__row", "__r")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.col("n_words") * left))


def without_lines(text, removed):
    """Column: the text without the lines whose hashes are in the array (null: nothing is removed)."""

    def cut_lines(texts: Iterator) -> list:
        return [t if t is None or gone is None else "\n".join(x for x in t.split("\n") if not (w := _WORDS(x)) or line_hash(w) not in set(gone)) for t, gone in texts]

    @F.pandas_udf("string")
    def run(texts: pd.Series, all_gone: pd.Series) -> pd.Series:
        return pd.Series(cut_lines(zip(texts, all_gone, strict=True)), dtype=object)

    return run.asNondeterministic()(text, removed)
