"""Hourly means and weather classes of readings that arrive as files.

The stream reads a folder, a bounded number of files at a time, keeps sums per site and hour as state until
the watermark has passed them, and writes the hours that a batch has changed. A batch has a folder of its own,
which is written anew if the batch is repeated after a failure; so a stopped stream goes on from its checkpoint without losing
or doubling readings. :func:`latest_hours` takes the last state of every hour from what has been written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.aggregates import r_mean


def read_arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; files that come later are read later."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def hourly_state(readings: DataFrame, keys: Sequence[str], time: str = "date", value: str = "value", delay: str = "2 days", classes: Mapping[str, Column] | None = None) -> DataFrame:
    """``*keys, *classes, start, n, value`` by hour, of a stream or of a table.

    ``classes``: further columns that are made from a reading alone (weather, time of day) and group it. The mean is missing where
    a reading of the hour is. Readings later than ``delay`` behind the latest one may be left out of a stream.
    """
    rows = readings.withColumns(dict(classes)) if classes else readings
    if rows.isStreaming:
        rows = rows.withWatermark(time, delay)
    hour = F.window(time, "1 hour").alias("hour")
    sums = rows.groupBy(*keys, *(classes or {}), hour).agg(F.count(F.lit(1)).alias("n"), r_mean(value).alias(value))
    return sums.select(*keys, *(classes or {}), F.col("hour.start").alias("start"), "n", value)


def write_changes(hours: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start to write what every batch has changed, a folder per batch below ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = hours.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_hours(spark: SparkSession, out: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The last written state of every hour: of rows with equal keys that of the latest batch."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(out)
    others = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others]).select(*schema.names)
