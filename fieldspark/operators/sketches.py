"""Stored summaries that add up: quantiles and species sets without a second reading of the data.

A table of sketches has one small binary value per day, plot or year. Longer periods, whole sites and the sets that two
samplings share come from those, not from the readings: merging is associative, so that partial sums of sketches are
sketches again. Quantiles are within a stated error of rank; sets are counted exactly while they are below the
sketch's size, and within a stated error above it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of a quantile sketch: the larger, the more values it keeps.
QUANTILE_K = 1024
#: Sets of up to 2 ** this many values are counted exactly.
SET_LG = 12


def rank_error(k: int = QUANTILE_K) -> float:
    """Rank error of a quantile sketch of accuracy ``k`` that is passed in one of a hundred cases: 2.446 / k ** 0.9433 (published)."""
    return 2.446 / k**0.9433


def set_error(lg: int = SET_LG) -> float:
    """Relative error of a set's size, three standard errors, above the size that is exact."""
    return 3 / (2**lg - 1) ** 0.5


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """``*keys, n, sketch`` per group: the values' number and their sketch. Missing values and NaN do not count."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("__v", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """Sketches of coarser groups, by merging; a table of the same form."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row per group and probability: the table's columns without the sketch, ``prob``, ``quantile``."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    kept = [c for c in sketches.columns if c != "sketch"]
    pairs = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double("sketch", asked).alias("quantile"))
    return sketches.select(*kept, F.explode(pairs).alias("__p")).select(*kept, F.col("__p.prob").alias("prob"), F.col("__p.quantile").alias("quantile"))


def set_sketches(df: DataFrame, keys: Sequence[str], value: str, lg: int = SET_LG) -> DataFrame:
    """``*keys, sketch``: the set of a group's values. Missing values are in no set."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.theta_sketch_agg(value, lg).alias("sketch"))


def united_sketches(sketches: DataFrame, keys: Sequence[str], lg: int = SET_LG) -> DataFrame:
    """Sets of coarser groups: everything that is in one of the merged sets."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def set_size(sketch: Column | str) -> Column:
    return F.theta_sketch_estimate(sketch).cast("long")


def compared_sets(sketches: DataFrame, keys: Sequence[str], role: Mapping[str, Column]) -> DataFrame:
    """Two sets per key against each other: ``*keys, n_first, n_second, n_both, n_gained, n_lost, n_either``.

    ``role`` has a condition for ``first`` and one for ``second``; sets that meet one are united. A key with only one of the two has
    the other empty: nothing in both.
    """
    sides = {name: united_sketches(sketches.filter(role[name]), keys).withColumnRenamed("sketch", name) for name in ("first", "second")}
    both = sides["first"].join(sides["second"], list(keys), "full")
    a, b = F.col("first"), F.col("second")
    known = a.isNotNull() & b.isNotNull()
    zero = F.lit(0).cast("long")
    size = lambda c: F.when(c.isNotNull(), set_size(c)).otherwise(zero)
    return both.select(
        *keys,
        size(a).alias("n_first"),
        size(b).alias("n_second"),
        F.when(known, set_size(F.theta_intersection("first", "second"))).otherwise(zero).alias("n_both"),
        F.when(known, set_size(F.theta_difference("second", "first"))).otherwise(size(b)).alias("n_gained"),
        F.when(known, set_size(F.theta_difference("first", "second"))).otherwise(size(a)).alias("n_lost"),
        F.when(known, set_size(F.theta_union("first", "second"))).otherwise(size(F.coalesce(a, b))).alias("n_either"),
    )
