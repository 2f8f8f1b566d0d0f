"""The queue of chunks to be embedded, as a stream with state: chunks come, results leave, failures wait for another try."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.sources.files import remove, scratch

RESULT = "id long, embedding array<float>, vector_status string, attempts int, error string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue(StatefulProcessor):
    """One shard of the queue.

    New chunks go to the model `batch` at a time. A call that fails puts its chunks into the state; their timer gives each a try of its own, so that one bad text
    doesn't hold up the others, after wait_ms, then twice as long and so on. After `most` tries a chunk is vec_err. Only waiting chunks are state.
    """

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], batch: int, most: int, wait_ms: int):
        self.embed, self.batch, self.most, self.wait_ms = embed, batch, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id long", "content string, attempts int, due long")

    def later(self, chunk: int, content: str, attempts: int, now: int) -> None:
        due = now + self.wait_ms * 2 ** (attempts - 1)
        self.waiting.updateValue((chunk,), (content, attempts, due))
        self.handle.registerTimer(due)

    def tried(self, rows: list[tuple[int, str, int]], now: int) -> Iterator[tuple]:
        """Results of one call for rows (id, content, tries so far); those that failed and may be tried again are put off."""
        try:
            vectors = self.embed([r[1] for r in rows])
            if len(vectors) != len(rows):
                raise ValueError(f"{len(vectors)} vectors for {len(rows)} texts")
        except Exception as e:  # noqa: BLE001 - whatever a model raises is an outcome of the chunk
            for chunk, content, attempts in rows:
                if attempts + 1 < self.most:
                    self.later(chunk, content, attempts + 1, now)
                else:
                    yield chunk, None, "vec_err", attempts + 1, f"{type(e).__name__}: {e}"
            return
        for (chunk, _, attempts), v in zip(rows, vectors, strict=True):
            yield chunk, [float(x) for x in v], "vec", attempts + 1, None

    def table(self, results: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(results, columns=["id", "embedding", "vector_status", "attempts", "error"]).astype({"id": "int64", "attempts": "int32", "embedding": object, "error": object})

    def came(self, pdf: pd.DataFrame, now: int) -> pd.DataFrame:
        """The results of new chunks."""
        blank = [t is None or t != t or not t.strip() for t in pdf["content"]]
        rows = [(int(i), t, 0) for i, t in zip(pdf["id"], pdf["content"], strict=True)]
        done = [(i, None, "vec_err", 0, "no text") for (i, _, _), b in zip(rows, blank, strict=True) if b]
        ready = [r for r, b in zip(rows, blank, strict=True) if not b]
        for k in range(0, len(ready), self.batch):
            done += self.tried(ready[k : k + self.batch], now)
        return self.table(done)

    def at_once(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The results of chunks that have one try: none waits, so there is no state."""
        return (self.came(pdf, 0) for pdf in batches)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for pdf in rows:
            for i in pdf["id"]:
                self.waiting.removeKey((int(i),))  # a chunk that comes again has a new text
            yield self.came(pdf, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = [k[0] for k, v in self.waiting.iterator() if v[2] <= expiredTimerInfo.getExpiryTimeInMs()]
        for k in range(0, len(due), self.batch):
            done = []
            for chunk in due[k : k + self.batch]:
                content, attempts, _ = self.waiting.getValue((chunk,))
                self.waiting.removeKey((chunk,))
                done += self.tried([(chunk, content, attempts)], now)
            if done:
                yield self.table(done)

    def close(self) -> None:
        pass


def waiting(chunks: DataFrame) -> DataFrame:
    """The chunks that wait for a vector."""
    return chunks.where("id is not null and vector_status = 'to_vec' and parent_id is not null and embedding is null")


def vectorise_stream(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], shards: int = 256, batch: int = 100, most: int = 3, wait_ms: int = 60_000) -> DataFrame:
    """The results (id, embedding, vector_status, attempts, error) of a stream of chunks (id, parent_id, content, vector_status, embedding).

    Chunks that are to_vec, have a parent and no embedding are taken, others are passed over. A chunk without text is vec_err at once. Shards are dealt by a
    hash of the id, so no key is hot, and bound how many tasks a micro-batch can use. With more than one try a stream has timers, so it goes on
    until it is stopped, whatever its trigger. With one try nothing waits: chunks are taken where they are read, without shuffle or state.
    """
    if most == 1:
        return waiting(chunks).select("id", "content").mapInPandas(Queue(embed, batch, most, wait_ms).at_once, RESULT)
    keyed = waiting(chunks).select("id", "content", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    return keyed.groupBy("shard").transformWithStateInPandas(Queue(embed, batch, most, wait_ms), RESULT, "Append", "ProcessingTime")


def start(results: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing a stream of results to Parquet files under path, each result once (Spark's log of committed files). State is kept in RocksDB, on the executors and in the checkpoint."""
    spark = results.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return results.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def vectorised(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], **options) -> DataFrame:
    """The results of a table of chunks that is put through the queue once, by a stream over its files. Chunks have one try each: nothing would wait for their timers."""
    spark = chunks.sparkSession
    source, out, log = scratch(spark, "queue"), scratch(spark, "vectors"), scratch(spark, "queue-log")
    waiting(chunks).select("id", "parent_id", "content", "vector_status", "embedding").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1_000).parquet(source)
    start(vectorise_stream(stream, embed, most=1, **options), out, log, availableNow=True).awaitTermination()
    for path in (source, log):
        remove(spark, path)
    return spark.read.schema(RESULT).parquet(out)
