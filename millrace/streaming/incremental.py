"""Appending new rows to a written table, once per key, from a stream or in resumed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet (resume)."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_new(spark: SparkSession, batch: DataFrame, path: str, key: str, order: str) -> None:
    """Appends the last row of each key of a batch that the table at ``path`` doesn't have. Running it twice changes nothing."""
    latest = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    try:
        latest = pending(latest, spark.read.schema(batch.schema).parquet(path), key)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    latest.write.mode("append").parquet(path)


def append_stream(spark: SparkSession, source: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Feeds a stream into the table at ``path`` with all that is there now, then stops."""
    return source.writeStream.foreachBatch(lambda batch, _: append_new(spark, batch, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, event_type, n) by tumbling window; on a stream rows later than ``late`` are dropped from closed windows."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
