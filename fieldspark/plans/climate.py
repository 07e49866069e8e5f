"""Climate zones, sunniness and weather classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import r_mean, weighted_mean
from ..functions.missing import ColumnLike, as_col, case_when, if_else, is_in, ratio
from ..models.envelope import quantile_envelope
from ..operators.grouping import annual_then_mean
from ..operators.joins import fill_from_alternative, r_join
from ..operators.reshape import complete
from ..operators.sets import substitute_rows
from ..session import cut_lineage


def weather_class(sunniness: ColumnLike) -> Column:
    """``sunny`` above 0.66, ``variable`` above 0.33, ``cloudy`` below it, NULL exactly at 0.33."""
    s = as_col(sunniness)
    return case_when((s > 0.66, "sunny"), (s > 0.33, "variable"), (s < 0.33, "cloudy"))


def temperature_level(c: ColumnLike) -> Column:
    """Summer mean as 6.5 (below 9), 10.5 (above 10.5) or 8.5."""
    t = as_col(c)
    return if_else(t < 9, F.lit(6.5), if_else(t > 10.5, F.lit(10.5), F.lit(8.5)))


def climate_zones(
    monthly: DataFrame,
    daily: DataFrame,
    normals: DataFrame | None = None,
    first_year: int = 2009,
    weight: str = "rows",
    key: str = "siteID",
) -> DataFrame:
    """Climate table per site.

    ``monthly`` (site, date, value) gives the June to September mean temperature, ``daily``
    (site, date, Precipitation) the mean of yearly precipitation sums.
    """
    summer = monthly.filter(F.month("date").between(6, 9) & (F.year("date") >= first_year))
    temp = summer.groupBy(key).agg(r_mean("value").alias("temp0916"))
    days = daily.filter(F.year("date") >= first_year).select(key, F.year("date").alias("Year"), "Precipitation")
    precip = annual_then_mean(days, [key], "Year", "Precipitation", "precip0916", weight)
    out = r_join(precip, temp, [key], "full").withColumn("tempLevel", temperature_level("temp0916"))
    return out if normals is None else r_join(out, normals, [key], "left")


def clean_radiation(
    radiation: DataFrame, skip_loggers: Sequence[str] = (), skip_sites: Sequence[str] = (), cap: float | None = None, since: str | None = None
) -> DataFrame:
    """Usable radiation readings without repeats."""
    out = radiation.filter(~is_in("logger", skip_loggers) & ~is_in("site", skip_sites))
    if cap is not None:
        out = out.filter(F.col("value") < cap)
    if since is not None:
        out = out.filter(F.to_date("date") > F.lit(since).cast("date"))
    return out.distinct()


def hourly_above_minimum(radiation: DataFrame) -> DataFrame:
    """Mean by site, hour and day of readings above their logger's minimum: ``site, hour, day, value``.

    The readings are added up by logger and hour first, and moved once, as sums; the minimum is taken off these few rows.
    """
    rows = radiation.filter(F.col("value").isNotNull()).select("logger", "site", F.hour("date").alias("hour"), F.to_date("date").alias("day"), F.col("value").cast("double").alias("value"))
    parts = cut_lineage(rows.groupBy("logger", "site", "hour", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least")))
    least = parts.groupBy("logger", "site").agg(F.min("least").alias("least"))
    above = r_join(parts.drop("least"), least, ["logger", "site"], "inner")
    return above.groupBy("site", "hour", "day").agg((F.sum(F.col("total") - F.col("n") * F.col("least")) / F.sum("n")).alias("value"))


def sunniness_index(
    radiation: DataFrame,
    sites: Sequence[str] | None = None,
    fallback: DataFrame | None = None,
    substitutes: Sequence[tuple[Column, Mapping[str, Column], Column | None]] = (),
    tau: float = 0.95,
    df: int = 10,
) -> DataFrame:
    """Share of possible radiation per site and day, 0 to 1.

    Readings are set above the logger's minimum and averaged by hour. The upper envelope of each
    site and hour over the season is the possible radiation; the day's index is the mean ratio
    to it, weighted by it. Gaps are completed, then filled from the fallback site and from
    substituted sites.
    """
    hourly = hourly_above_minimum(radiation)
    fitted = quantile_envelope(hourly, ["site", "hour"], "day", "value", tau, df)
    daily = (
        fitted.withColumn("prop", ratio("value", "fitted"))
        .groupBy(F.col("site").alias("siteID"), F.col("day").alias("date"))
        .agg(weighted_mean("prop", "fitted").alias("sunniness"))
        .withColumn("sunniness", F.when(F.col("sunniness") > 1, F.lit(1.0)).otherwise(F.col("sunniness")))
    )
    # One row per site and day from here on; the steps below read it several times.
    daily = cut_lineage(daily)
    if sites is not None:
        daily = complete(daily, "siteID", sites, ["date"])
    if fallback is not None:
        daily = fill_from_alternative(daily, fallback.filter(F.col("pref") == 1).drop("pref"), "siteID", "date", "sunniness")
    for rows, values, replace in substitutes:
        daily = substitute_rows(daily, rows, values, replace)
    return daily.select("siteID", "date", "sunniness")
