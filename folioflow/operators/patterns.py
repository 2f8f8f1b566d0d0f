"""Which of a set of needles stand in which texts: an automaton of all needles reads each text once."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of needles in one automaton; more are dealt to several, each of which reads the texts.
LARGEST = 1_000_000


@functools.lru_cache(maxsize=2)
def _automaton(token: str, shared):
    """Built once in a worker and kept for its later tasks."""
    a = ahocorasick.Automaton()
    for needle, ids in shared.value:
        a.add_word(needle, ids)
    a.make_automaton()
    return a


def containments(texts: DataFrame, needles: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Rows of texts (text, ...) with needle_id of each needle (needle_id, needle) that the text holds, overlapping ones too.

    A null text or needle holds and is held by nothing; an empty needle is in every text. Equal needles each have their rows. Needles
    come to the driver part by part, at most `largest` code points (and one needle) at a time.
    """
    spark, some = texts.sparkSession, needles.where(F.col("needle").isNotNull())
    out, part, size = [], {}, 0

    def add() -> None:
        token, shared, empty = uuid.uuid4().hex, spark.sparkContext.broadcast([(n, ids) for n, ids in part.items() if n]), list(part.get("", []))

        @F.pandas_udf("array<long>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            a = _automaton(token, shared)
            for batch in batches:
                yield pd.Series([None if t is None else sorted({*empty, *(i for _, ids in (a.iter(t) if len(a) else ()) for i in ids)}) for t in batch], dtype=object)

        out.append(texts.withColumn("needle_id", F.explode(find(F.col("text")))))

    for r in some.select(F.col("needle_id").cast("long"), "needle").toLocalIterator():
        if part and size + len(r[1]) > largest:
            add()
            part, size = {}, 0
        part.setdefault(r[1], []).append(r[0])
        size += len(r[1])
    add()
    return functools.reduce(DataFrame.unionAll, out)
