"""Micro-climate tables by plot and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import time_of_day
from ..operators.grouping import daily_summary, scale
from ..operators.joins import anomaly_vs, r_join
from ..operators.ordered import distinct_first
from ..operators.sets import union_all
from .climate import weather_class


def air_temperature(readings: DataFrame, channel: str = "temp200cm") -> DataFrame:
    """Unflagged air readings of one channel as ``siteID, date, hour, airTemp``."""
    ok = F.col("value").isNotNull() & F.col("flag").isNull() & (F.col("logger") == channel)
    return readings.filter(ok).select(
        F.col("site").alias("siteID"), F.to_date("date").alias("date"), F.hour("date").alias("hour"), F.col("value").alias("airTemp")
    )


def compile_series(soil: DataFrame, air: DataFrame, sunniness: DataFrame, precipitation: DataFrame) -> DataFrame:
    """Soil and air readings with sunniness, time-of-day class and gridded precipitation.

    Days of the precipitation grid without readings are kept.
    """
    soil = soil.withColumn("hour", F.hour("Date")).withColumn("__day", F.to_date("Date")).drop("Date")
    soil = soil.withColumnRenamed("__day", "date")
    both = union_all(soil, air)
    both = r_join(both, sunniness, ["siteID", "date"], "left").withColumn("TOD", time_of_day("hour"))
    return r_join(precipitation, both, ["siteID", "date"], "left")


def daily_plots(
    series: DataFrame, start: str, end: str, keys: Sequence[str] = ("siteID", "turfID", "blockID", "Treatment", "date", "sunniness", "TOD", "ID"), value: str = "Value"
) -> DataFrame:
    """Daily summary per plot and time-of-day class with the weather class; transition hours are left out."""
    days = series.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("TOD") != "spinup"))
    return daily_summary(days, list(keys), value).withColumn("weather", weather_class("sunniness"))


def with_cover(daily: DataFrame, cover: DataFrame, on: Sequence[str] = ("siteID", "turfID", "blockID", "Treatment"), tod: str = "day") -> DataFrame:
    """Daytime rows joined to one cover row per plot, the first by its values."""
    one = distinct_first(cover, on, [c for c in cover.columns if c not in on])
    return r_join(daily.filter(F.col("TOD") == tod), one, list(on), "left")


def standardised(df: DataFrame, centred: Sequence[str], scaled: Sequence[str]) -> DataFrame:
    """Model covariates: some centred only, some also divided by their standard deviation."""
    out, _ = scale(df, list(centred), sd=False)
    if scaled:
        out, _ = scale(out, list(scaled))
    return out


def treatment_contrast(
    df: DataFrame, on: Sequence[str], reference: str, treatments: Sequence[str], value: str, treatment: str = "Treatment"
) -> DataFrame:
    """Value of each listed treatment minus the reference in the same block and date."""
    out = anomaly_vs(df, F.col(treatment) == reference, on, [value], suffix="_delta")
    return out.filter(F.col(treatment).isin(list(treatments)))


def frost_window(df: DataFrame, start: str, end: str, skip: Column | None = None) -> DataFrame:
    """Rows of the frost season, both ends included."""
    out = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out if skip is None else out.filter(~skip)
