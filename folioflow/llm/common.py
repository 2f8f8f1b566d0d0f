"""Helpers shared by the corpus operators: the word rule, shared scratch space, batch hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def n_words(col):
    """Words of a text column as a long; a null text has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, it is a fresh one in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_folioflow_dir", None) or f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark._folioflow_dir = base
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a scratch folder and read again, and the folder, for remove_path when nothing reads it any more."""
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most 4 MB, so that a worker's memory doesn't depend on how long texts are. A lower limit of the session stays."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(key, str(most))


def let_go(spark: SparkSession) -> None:
    """The driver collects its garbage, so that Spark deletes the shuffle files (and with spark.cleaner.referenceTracking.cleanCheckpoints the checkpoints) of frames that nothing refers to any more; by itself it may take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder. What the frame was made from is let go; the checkpoint itself stays until the session ends where spark.cleaner.referenceTracking.cleanCheckpoints is unset."""
    shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    out = df.checkpoint(eager=True)
    let_go(df.sparkSession)
    return out


def give_back() -> None:
    """Free memory of this Python worker goes back to the system; a worker stays for later tasks, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """The JVMs of the executors collect their garbage and give unused heap back to the system, between two jobs that differ in what they need: a heap grows to its limit under shuffles, and Python
    workers live beside it in the same executor. A few empty tasks a core; an executor that gets none of them keeps what it has."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def tidy(work):
    """A function over an iterator of batches that gives memory back when a task's batches end."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply), in place on a uint64 copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so invertible modulo 2^64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: Bytes of text that are hashed at a time; a longer word is hashed alone.
CHUNK = 1 << 19
_EDGE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: dict = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); kept for the usual lengths."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * CHUNK:
            _POWERS[int(base)] = have
    return have[:n]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of some bytes."""
    buf = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(buf) + 2, dtype=bool)
    space[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(buf)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _powers(_INV, len(buf))[starts]) if len(starts) else np.zeros(0, dtype=np.uint64)
    hashes ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return starts, ends, hashes


def _pieces(data: bytes, chunk: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces of about `chunk` bytes that end at white space."""
    at = 0
    while at < len(data):
        m = _EDGE.search(data, at + chunk)
        end = m.end() if m else len(data)
        yield at, data[at:end]
        at = end


def word_hashes(texts: list, chunk: int = CHUNK):
    """Hash every word of every text, A-Z lower-cased, without a Python loop over words.

    Yields (first, n, docs, hashes) for runs of n whole texts: the index of the run's first text, and for each word
    its text (relative to first) and a 64-bit hash. A word's hash is a polynomial of its bytes modulo 2^64, read off
    prefix sums, then finalised; words of different lengths get different offsets. A text longer than a chunk is
    hashed piece by piece, so beyond the text itself memory is 16 bytes a word.
    """
    at = 0
    while at < len(texts):
        raw, size, first = [], 0, at
        while at < len(texts) and (size < chunk or at == first):
            b = (texts[at] or "").encode("utf-8", "surrogatepass")
            if raw and size + len(b) > 2 * chunk:
                break
            raw.append(b)
            size += len(b) + 1
            at += 1
        if len(raw) == 1 and size > 2 * chunk:
            hashes = np.concatenate([_hashed(piece.lower())[2] for _, piece in _pieces(raw[0], chunk)])
            docs = np.zeros(len(hashes), dtype=np.int64)
        else:
            starts, _, hashes = _hashed(b"\n".join(raw).lower())  # bytes.lower: A-Z only
            docs = np.searchsorted(np.cumsum([0] + [len(b) + 1 for b in raw]), starts, side="right") - 1
        yield first, len(raw), docs, hashes


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word windows of one word-hash sequence; fewer words make one window."""
    if len(hashes) == 0:
        return hashes
    width = min(k, len(hashes))
    out = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + hashes[j : len(hashes) - width + 1 + j])
    return out
