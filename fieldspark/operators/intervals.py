"""Membership of readings in windows of time, as an equi-join on days.

Windows are cut at midnight, so that a reading meets only the pieces of its own day. Pieces of one key and day are merged
where they touch or overlap: a reading lies in one piece at most, however many windows cover it, and no row
is doubled. A key that holds most readings is dealt out by day; what one day of one key has beyond that is split by
the engine's skew handling, as both sides of the join are plain tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouping import attach_row
from .joins import r_join

DAY = "1 day"


def daily_pieces(windows: DataFrame, by: Sequence[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """Disjoint pieces ``*by, day, piece_start, piece_end`` of windows, within the row's columns ``low`` and ``high``.

    Both ends belong to a window. A missing end does not limit it; a window that ends before it starts is none.
    """
    first = F.greatest(F.coalesce(F.col(start), F.col(low)), F.col(low))
    last = F.least(F.coalesce(F.col(end), F.col(high)), F.col(high))
    kept = windows.filter(F.coalesce(F.col(start) <= F.col(end), F.lit(True)))
    cut = kept.select(*by, first.alias("a"), last.alias("b")).filter("a <= b")
    day = F.explode(F.sequence(F.to_date("a"), F.to_date("b")))
    days = cut.withColumn("day", day).withColumns({"a": F.greatest("a", F.col("day").cast("timestamp")), "b": F.least("b", (F.date_add("day", 1)).cast("timestamp"))})
    # Equal pieces first, before they are sorted.
    days = days.groupBy(*by, "day", "a").agg(F.max("b").alias("b"))
    order = W.partitionBy(*by, "day").orderBy("a")
    reached = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")
    numbered = days.withColumn("__new", new).withColumn("__piece", F.sum("__new").over(order))
    return numbered.groupBy(*by, "day", "__piece").agg(F.min("a").alias("piece_start"), F.max("b").alias("piece_end")).drop("__piece")


def in_any_window(readings: DataFrame, windows: DataFrame, by: Sequence[str], time: str, start: str, end: str) -> DataFrame:
    """Readings that lie in at least one window of their key, each once, with its columns.

    Both ends count. A missing ``start`` or ``end`` does not limit; readings without a time and of keys without a window go.
    Times are timestamps, and midnight is that of the session's time zone.
    """
    if {"__day", "__time", "piece_start", "piece_end"} & set(readings.columns):
        raise ValueError("a column of the readings has the name of a working column")
    extent = readings.agg(F.min(time).cast("timestamp").alias("__low"), F.max(time).cast("timestamp").alias("__high"))
    spans = windows.select(*by, F.col(start).cast("timestamp").alias("__a"), F.col(end).cast("timestamp").alias("__b"))
    pieces = daily_pieces(attach_row(spans, extent), by, "__a", "__b", "__low", "__high").withColumnRenamed("day", "__day")
    timed = readings.withColumns({"__time": F.col(time).cast("timestamp"), "__day": F.to_date(F.col(time).cast("timestamp"))})
    met = r_join(timed, pieces, [*by, "__day"], "inner")
    return met.filter(F.col("__time").between(F.col("piece_start"), F.col("piece_end"))).select(*readings.columns)
