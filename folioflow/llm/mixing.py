"""Mixing sources to target weights, as DataFrame operations only.

Words are summed per source, each source gets a target, and its repetition rate target / size is
spent on every document: floor(rate) copies, plus one more with probability equal to the fraction,
decided by a seeded hash of the document, so that reruns and retried tasks agree.

Defined results: a null or empty text has size 0 and takes nothing from a mix of words; a null source is
a source of its own, after all others; a source without words has target 0; repeated rows are decided
alike; an empty table gives an empty table; further columns pass through (the names in _ADDED are
replaced if present).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut, n_words

#: Rows of the table of targets (one per source) up to which it is broadcast (some 50 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000

_ADDED = ["size", "source_size", "target", "rate", "copies"]


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row per source.

    Sources in code-point order, null last, get the weights in turn and share `share` times all words;
    a target stops at `cap` times its source's size and the excess is shared again by weight. That fixed
    point is a water level: sorted by cap / weight, a prefix is capped and the rest get weight * level,
    so prefix sums over the (one row per source) table find it without a loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total, before = Window.partitionBy(), Window.orderBy("full_at", "rn").rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rn", F.row_number().over(by_name))
        .withColumn("w", F.element_at(w, ((F.col("rn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("w"))
    )
    s = s.withColumn("budget", F.sum("source_size").over(total) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(total))
    s = s.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rn")))
    s = s.withColumn("level", level.over(total))
    return s.select(
        "source", "source_size",
        F.when(F.col("level").isNull() | (F.col("full_at") < F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("w")).alias("target"),
    )


def uniform(seed: int, id_col: str, text_col: str):
    """A number in [0, 1) fixed by seed, id and text: 52 bits of a digest (also easy to recompute elsewhere)."""
    key = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_counts(
    docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """docs with size (words), source_size, target, rate and copies (how often the mix emits the row)."""
    docs = docs.drop(*_ADDED).withColumn("size", n_words(F.col(text_col)))
    targets = source_targets(docs.select(F.col(source_col).alias("source"), "size"), weights, share, cap)
    targets = cut(targets.select(F.col("source").alias("__source"), "source_size", "target"))
    if targets.count() <= BROADCAST_ROWS:  # then texts don't move
        targets = F.broadcast(targets)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    out = docs.withColumn("__u", uniform(seed, id_col, text_col))
    out = out.join(targets, out[source_col].eqNullSafe(targets["__source"]), "inner").drop("__source").withColumn("rate", rate)
    whole = F.floor("rate").cast("int")
    return out.withColumn("copies", whole + (F.col("__u") < F.col("rate") - whole).cast("int")).drop("__u")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of docs as many times as mix_counts says, with docs' own columns."""
    counted = mix_counts(docs, **options).where("copies > 0")
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
