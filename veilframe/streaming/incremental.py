"""The same pipelines over documents that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.schemas import ANNOTATED


def document_stream(spark: SparkSession, folder: str, schema: str = ANNOTATED, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def _marked(df: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; streams need a time with a zone, so a time without one is read in the session's zone."""
    if df.isStreaming and dict(df.dtypes)[time] == "timestamp_ntz":
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, delay)


def once_each(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Without documents delivered again within ``delay``; state is bounded by the watermark."""
    return _marked(stream, time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Rows and sums by time window and kind; works on streams and tables alike."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return _marked(events, time, delay).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    return _marked(events, time, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stage to each micro-batch and append its rows to ``out``.

    The batch id is part of the path and a batch is overwritten as a whole, so a
    batch that is repeated after a failure leaves its rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
