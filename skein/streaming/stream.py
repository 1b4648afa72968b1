"""Streaming forms of batch operators; each gives the batch answer on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.labels import weak_label


def source(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, `per_trigger` at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if late else df


def sessions(events: DataFrame, time: str, user: str, gap: str = "12 hours", late: str | None = None) -> DataFrame:
    """Events of a user that follow each other within the gap: start, end, count.

    With `late`, events older than the watermark are dropped; in batch there is none.
    """
    e = _timed(events, time, late)
    w = F.session_window(time, gap)
    out = e.groupBy(w.alias("w"), user).agg(F.count("*").alias("n_events"))
    return out.select(user, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n_events")


def first_seen(messages: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Messages without repeats of a key that arrive within the watermark."""
    return _timed(messages, time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str | None = None) -> DataFrame:
    e = _timed(events, time, late)
    return e.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_micros("w.start").alias("start_us"), kind, "n", "total")


def labelled(messages: DataFrame, text: str) -> DataFrame:
    """Incoming messages with their weak label: stateless, so the batch operator serves as it is."""
    return weak_label(messages, text)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available once and append it to a Parquet table."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
