"""Structured Streaming jobs over folders of rows; every one ends in the same tables when a batch is run again, or a checkpoint is lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmere.operators import store as T
from lexmere.streaming.tables import Appended, Bucketed, run_of


def _started(source: DataFrame, checkpoint: str, apply: Callable[[DataFrame, str, int], object]) -> StreamingQuery:
    run = run_of(source.sparkSession, checkpoint)
    each = lambda batch, number: apply(batch, run, number)
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(source: DataFrame, table: Bucketed, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 2) -> StreamingQuery:
    """Each micro-batch rewrites the buckets it touches; a batch that is run again changes nothing. The last `keep` versions stay."""

    def apply(batch: DataFrame, run: str, number: int) -> None:
        table.apply(batch, run, number, merge)
        table.expire(keep)

    return _started(source, checkpoint, apply)


def ingest(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Each document once: rows whose id is there already are ignored, and a batch writes its new rows alone."""
    return _started(spark.readStream.schema(schema).parquet(source), checkpoint, Appended(spark, path, schema, key).add)


def ingested(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """What J1 has written."""
    return Appended(spark, path, schema, key).read()


def events_table(spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> Bucketed:
    return Bucketed(spark, path, schema, "document_id", buckets)


def chunk_events(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str) -> StreamingQuery:
    """A batch's chunks replace what the table has for them."""
    keys = ["document_id", "chunk_index"]
    return merged(spark.readStream.schema(schema).parquet(source), events_table(spark, path, schema), checkpoint, lambda old, batch: T.replaced(old, batch, batch, keys))


def usage_upserts(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, changing: list[str], key: str = "id", arrival: str = "arrival") -> StreamingQuery:
    """K1, K2 on a stream: rows by key; where a key is there already, only the `changing` columns take the newest value."""
    return merged(spark.readStream.schema(schema).parquet(source), Bucketed(spark, path, schema, key), checkpoint, lambda old, batch: T.upserted(old, batch, key, changing, arrival))


def progress(steps: DataFrame) -> DataFrame:
    """(document_id, step, ok, error, ts) -> the latest status of each document; runs on a stream (update or complete mode) and on a table."""
    return steps.groupBy("document_id").agg(F.max_by(F.struct(F.when(F.col("ok"), F.col("step")).otherwise("failed").alias("status"), F.col("error").alias("error_message")), F.struct("ts", "step")).alias("last")).select("document_id", "last.status", "last.error_message")


def live_usage(usage: DataFrame) -> DataFrame:
    """Running totals per document; runs on a stream (update or complete mode) and on a table."""
    return usage.groupBy("document_id").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("calls"))


def windowed_usage(usage: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """J4 by event time: totals per day, closed once `late` has passed; later rows are dropped on a stream."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def drained(spark: SparkSession, query: StreamingQuery) -> None:
    """Wait for a query that stops when its source is read."""
    query.awaitTermination()
