"""Extensions for event streams; each takes a streaming or a batch DataFrame with ``ts``, ``event_type`` and ``value``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per event type and window; events later than ``late`` are dropped in a stream."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, width: str = "2 hours", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per user, ended by a gap."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process_new(stream: DataFrame, each: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies ``each`` to what has arrived since the last call and appends the result; the checkpoint remembers.

    A batch writes to a folder of its own number, so a batch that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_windows(stream: DataFrame, out: str, checkpoint: str, *, width: str = "1 hour", late: str = "2 hours") -> list[StreamingQueryProgress]:
    """Counts and sums what has arrived into ``tumbling`` windows, keeps their state in the checkpoint, and ends; returns its progress.

    Each micro-batch writes the windows that it has changed to a folder of its own number. A run that is repeated after a
    failure replaces the folder of its last batch and goes on from its state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted = tumbling(stream, width, late)
    query = counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """Windows as the last micro-batch that changed them left them."""
    rows = spark.read.parquet(out)
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("window_start", "event_type", "r.*")
