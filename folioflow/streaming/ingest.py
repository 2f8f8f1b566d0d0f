"""Structured Streaming: ingestion of new documents, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import structure as S
from folioflow.sources.files import scratch


def _stream(spark: SparkSession, batch: DataFrame, name: str) -> DataFrame:
    """The rows of a table as a file stream: written to shared scratch space, read with readStream."""
    path = scratch(spark, name)
    batch.write.parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 100).parquet(path)


def headings_of_new_documents(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, n_headings): each micro-batch of lines is parsed and appended; the append is keyed by batch, so that a retried batch overwrites itself."""
    out = scratch(spark, "headings")

    def append(batch: DataFrame, batch_id: int) -> None:
        S.parse_headings(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = _stream(spark, lines, "lines").writeStream.foreachBatch(append).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_headings"))


def event_windows(spark: SparkSession, events: DataFrame, size: str) -> DataFrame:
    """(start, event_type, n): tumbling windows over event time, however late an event comes.

    Each micro-batch adds its own counts, keyed by the batch, so that a retried batch overwrites itself; a window's count is their sum.
    No state is kept between batches and no row is dropped behind a watermark.
    """
    out = scratch(spark, "windows")
    e = _stream(spark, events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "events")

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.select(F.col("window.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = e.writeStream.foreachBatch(add).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema("start timestamp, event_type string, n long").parquet(out)
    return found.groupBy("start", "event_type").agg(F.sum("n").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
