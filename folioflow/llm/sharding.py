"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from a hash of (key, shard) and the row goes to the shard with the best
draw -ln(u) / weight. The key and the list of shards decide alone; a further shard takes rows
only into itself, and on average its fair share of them.

Defined results: null keys are one key (all on one shard); rows with the same key share a shard; a null
text has no bytes and checksum 0; slots of equal rows are dealt in any order among them; an empty table gives
an empty table; further columns pass through (names that are added replace those present).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key, shards: list[int], weights: list[float] | None = None, seed: int = 0):
    """Column: the shard of a key. Ties go to the smaller draw's shard number."""
    weights = weights or [1.0] * len(shards)
    draws = []
    for shard, weight in zip(shards, weights, strict=True):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("d"), F.lit(shard).alias("shard")))
    return F.least(*draws)["shard"] if len(draws) > 1 else draws[0]["shard"]


#: Rows of a part of a shard that a task sorts, about; and parts up to which their counts are broadcast (some 30 bytes each).
PART_ROWS, BROADCAST_ROWS = 500_000, 500_000


def with_slots(df: DataFrame, shard_col: str, order: list[str], n_shards: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard may hold most of the table, so it is numbered in hash parts that tasks sort on their own, as many as
    the table is large; the parts' offsets come from their counts.
    """
    parts = max(16, -(-df.count() // PART_ROWS))
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(F.col(shard_col).alias("__shard"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__shard", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    offsets = F.broadcast(offsets) if parts * n_shards <= BROADCAST_ROWS else offsets
    own = Window.partitionBy(shard_col, "__part").orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(own))
    out = out.join(offsets, (out[shard_col] == offsets["__shard"]) & (out["__part"] == offsets["__p"]))
    return out.withColumn("slot", F.col("__offset") + F.col("__rn") - 1).drop("__part", "__rn", "__shard", "__p", "__offset")


def assign_shards(
    docs: DataFrame, n_shards: int, weights: list[float] | None = None, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, keep_text: bool = True
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more).

    With keep_text=False the text is dropped before rows move.
    """
    text, grown = F.col(text_col), [*(weights or [1.0] * n_shards), 1.0]
    out = docs.withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"),
        "law": F.lit("key"),
        "shard": rendezvous(F.col(key_col), list(range(n_shards)), weights, seed).cast("int"),
        "grown_shard": rendezvous(F.col(key_col), list(range(n_shards + 1)), grown, seed).cast("int"),
    })
    out = out if keep_text else out.drop(text_col)
    return with_slots(out, "shard", [key_col, "text_crc32", "size"], n_shards)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    n = assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")
    assigned.repartitionByRange(int(n), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
