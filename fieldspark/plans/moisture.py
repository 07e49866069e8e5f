"""Soil moisture of two campaigns in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_in, paste, row_mean
from ..operators.grouping import attach
from ..operators.joins import r_join
from ..operators.sets import union_all

# Comments of usable readings, and parts of turf names of other experiments.
USABLE_COMMENTS = ("fewer readings", "above table", "above table 100%")
OTHER_TURFS = "TT1|TT2|TT3|TT4|RTC|P"


def pooled_moisture(df: DataFrame, probes: Sequence[str] = ("M1", "M2", "M3", "M4"), keys: Sequence[str] = ("date", "turfID")) -> DataFrame:
    """First campaign: mean of all probe readings of a turf and day, attached to its rows."""
    ok = (is_in("comments", USABLE_COMMENTS) | F.col("comments").isNull()) & ~F.col("turfID").rlike(OTHER_TURFS)
    kept = df.filter(ok & F.col("treatment").isNotNull())
    kept = kept.withColumns({p: F.col(p).cast("string").try_cast("double") for p in probes})
    total, n = F.lit(0.0), F.lit(0)
    for p in probes:
        total = total + F.coalesce(F.sum(p), F.lit(0.0))
        n = n + F.count(p)
    out = attach(kept, list(keys), SM=F.try_divide(total, n))
    return out.filter(F.col("treatment") != "XC").drop(*probes)


def probe_moisture(df: DataFrame, probes: Sequence[str]) -> DataFrame:
    """Second campaign: mean of the probes of each row, where ``u`` reads 0."""
    cleaned = df.withColumns({p: F.regexp_replace(F.col(p).cast("string"), "u", "0").try_cast("double") for p in probes})
    return cleaned.withColumn("SM", row_mean(*probes)).drop(*probes)


def map_controls(moisture: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of shared controls renamed to their turf in this experiment; other rows of the older one are dropped."""
    alias = aliases.select(F.col("TTtreat").alias("__old"), F.col("turfID").alias("__new"))
    controls = r_join(moisture, alias, {"turfID": "__old"}, "inner").withColumn("turfID", F.col("__new")).drop("__new")
    return union_all(moisture.filter(~F.col("turfID").contains("TTC")), controls)


def compile_moisture(first: DataFrame, second: DataFrame) -> DataFrame:
    return union_all(first, second)


def plot_turf(site: str = "siteID", block: str = "blockID", treatment: str = "Treatment"):
    """Turf name from site, block and treatment."""
    return paste(F.substring(F.col(site), 1, 3), block, treatment)
