"""Plant biomass predicted from cover and height."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import r_mean
from ..functions.missing import ColumnLike, as_col, ratio
from ..operators.joins import r_join
from ..operators.reshape import gather

PLOT_AREA_M2 = 0.0625


def per_area(c: ColumnLike, area: float = PLOT_AREA_M2) -> Column:
    """Grams per plot as grams per square metre."""
    return as_col(c) / F.lit(area)


def clean_biomass(parts: DataFrame, round_no: int = 1, skip_treatments: Sequence[str] = ("RTC", "RTC2nd")) -> DataFrame:
    """Mean harvest of a round per plot and removed group."""
    kept = parts.filter((F.col("Round") == round_no) & ~F.col("Treatment").isin(list(skip_treatments)))
    return kept.groupBy("Year", "siteID", "Block", "Treatment", "Removed_FG").agg(r_mean("Biomass", na_rm=True).alias("Biomass"))


def slope_through_origin(df: DataFrame, keys: Sequence[str], y: Column, x: Column) -> DataFrame:
    """Least-squares slope without intercept, ``Σxy / Σx²``, over rows with both values."""
    known = x.isNotNull() & y.isNotNull()
    rows = df.select(*keys, F.when(known, x).alias("__x"), F.when(known, y).alias("__y"))
    return rows.groupBy(*keys).agg(
        ratio(F.sum(F.col("__x") * F.col("__y")), F.sum(F.col("__x") * F.col("__x"))).alias("slope"),
        F.count("__x").alias("n"),
    )


def biomass_model(
    harvest: DataFrame, plots: DataFrame, groups: Mapping[str, tuple[str, str]], on: Sequence[str], area: float = PLOT_AREA_M2
) -> tuple[DataFrame, DataFrame]:
    """Slopes of harvested biomass on cover × height per group, and the predictions for all plots.

    ``groups`` maps a group to its cover and height columns. ``harvest`` has the key ``on``,
    ``functionalGroup`` and ``Biomass``; ``plots`` has the key, covers and heights.
    """
    volume = plots.select(*on, *[(F.col(c) * F.col(h)).alias(g) for g, (c, h) in groups.items()])
    volumes = gather(volume, list(groups), "functionalGroup", "volume")
    fit = r_join(harvest, volumes, [*on, "functionalGroup"], "left")
    slopes = slope_through_origin(fit, ["functionalGroup"], per_area("Biomass", area), F.col("volume"))
    predicted = r_join(volumes, slopes.select("functionalGroup", "slope"), ["functionalGroup"], "left")
    predicted = predicted.withColumn("biomass", F.col("volume") * F.col("slope"))
    return slopes, predicted.select(*on, "functionalGroup", "biomass")
