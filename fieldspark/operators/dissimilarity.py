"""Community dissimilarity between samplings of the same plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ratio
from .joins import r_join


def dissimilarity(
    df: DataFrame, turf: Sequence[str], time: str, t0: object, species: str = "species", cover: str = "cover"
) -> DataFrame:
    """Bray-Curtis and quantitative Jaccard of each sampling against the baseline of its turf.

    Works on the long table. Only species present at both times contribute to the shared cover,
    so one equi-join on turf and species finds it; the work is linear in the rows.
    """
    long = df.groupBy(*turf, time, species).agg(F.sum(cover).alias("__c")).filter(F.col("__c") > 0)
    base = long.filter(F.col(time) == t0).drop(time).withColumnRenamed("__c", "__b")
    base_totals = base.groupBy(*turf).agg(F.sum("__b").alias("base_total"))
    totals = (
        r_join(long, base, [*turf, species], "left")
        .groupBy(*turf, time)
        .agg(F.sum("__c").alias("total"), F.sum(F.least("__c", F.coalesce(F.col("__b"), F.lit(0.0)))).alias("shared"))
    )
    out = r_join(totals, base_totals, list(turf), "inner")
    out = out.withColumn("bray", 1 - ratio(2 * F.col("shared"), F.col("total") + F.col("base_total")))
    return out.withColumn("jaccard", ratio(2 * F.col("bray"), 1 + F.col("bray"))).select(*turf, time, "bray", "jaccard")
