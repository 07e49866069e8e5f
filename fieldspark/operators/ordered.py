"""Operators that depend on row order.

A table has no row order, so each of them takes the order columns, with a unique tie-breaker. A
window runs one group in one task. Where a group may be too large for that, the group is cut
along the order at quantiles of the order column, each piece runs on its own, and the pieces are
linked by a small table with one row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import r_join

# Rows of one group that a single task may sort.
GROUP_LIMIT = 4_000_000
# Most pieces a table is cut into; also bounds the split points held on the driver.
MAX_PIECES = 4096


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, from one map-side combined count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.max("n")).first()[0] or 0)


def _number(df: DataFrame, col: str) -> Column:
    """An ordered column as a number in the same order."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.col(col).cast("timestamp").cast("double")
    if isinstance(kind, T.StringType):
        raise TypeError(f"{col} is text; order by a number or a time")
    return F.col(col).cast("double")


def _check_order(df: DataFrame, *cols: str) -> None:
    """Text has no split points; it is refused at every size, not only where a group is cut."""
    for c in cols:
        _number(df, c)


def _splits(df: DataFrame, col: str, pieces: int) -> list[float]:
    probs = [i / pieces for i in range(1, pieces)]
    return df.select(_number(df, col).alias("v")).approxQuantile("v", probs, 1.0 / (4 * pieces)) if probs else []


def with_pieces(df: DataFrame, order: str, tie: str | None = None, pieces: int = 64, out: str = "__piece") -> DataFrame:
    """Number the rows by range of ``order`` into about equal pieces, in order.

    A value frequent enough to fill a piece alone is cut further along ``tie``. The split points
    are at most :data:`MAX_PIECES` numbers.
    """
    pieces = max(1, min(pieces, MAX_PIECES))
    cuts = _splits(df, order, pieces)
    distinct = sorted(set(cuts))
    heavy = sorted({v for v in distinct if cuts.count(v) > 1})
    inf = float("inf")
    out_df = df.withColumn("__ord", _number(df, order))
    if distinct:
        cut = Bucketizer(splits=[-inf, *distinct, inf], inputCol="__ord", outputCol="__b", handleInvalid="keep")
        out_df = cut.transform(out_df).withColumn("__b", F.col("__b").cast("long"))
    else:
        out_df = out_df.withColumn("__b", F.lit(0).cast("long"))
    at_heavy = F.coalesce(F.col("__ord").isin(heavy), F.lit(False)) if heavy else F.lit(False)
    # Split points belong to the piece above them, so a heavy value comes first in its piece.
    major = F.col("__b") * 2 + F.when(at_heavy, 0).otherwise(1)
    minor = F.lit(0).cast("long")
    if heavy and tie is not None:
        ties = sorted(set(_splits(df.filter(_number(df, order).isin(heavy)), tie, pieces)))
        if ties:
            cut = Bucketizer(splits=[-inf, *ties, inf], inputCol="__t", outputCol="__tb", handleInvalid="keep")
            out_df = cut.transform(out_df.withColumn("__t", _number(df, tie)))
            minor = F.when(at_heavy, F.col("__tb").cast("long")).otherwise(F.lit(0).cast("long"))
    out_df = out_df.withColumn(out, major * (MAX_PIECES + 1) + minor)
    return out_df.drop("__ord", "__b", "__t", "__tb")


def _piece_count(largest: int, limit: int) -> int:
    return min(MAX_PIECES, 4 * (largest // max(limit, 1) + 1))


def lag_in_group(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, col: str, out: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """The previous value of ``col`` within its group, NULL on the first row. ``order`` and ``tie`` are numbers or times."""
    _check_order(df, order, tie)
    largest = largest_group(df, keys)
    if largest <= limit:
        return df.withColumn(out, F.lag(col).over(Window.partitionBy(*keys).orderBy(order, tie)))
    cut = with_pieces(df, order, tie, _piece_count(largest, limit))
    lasts = cut.groupBy(*keys, "__piece").agg(F.max_by(F.struct(F.col(col).alias("v")), F.struct(order, tie)).alias("__last"))
    # One row per group and piece, so this window is small.
    before = lasts.withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__piece"))).drop("__last")
    linked = r_join(cut, before, [*keys, "__piece"], "left")
    w = Window.partitionBy(*keys, "__piece").orderBy(order, tie)
    first = F.row_number().over(w) == 1
    value = F.when(first, F.col("__before.v")).otherwise(F.lag(col).over(w))
    return linked.withColumn(out, value).drop("__piece", "__before")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, value: Column, out: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Cumulative sum within a group; once a value is missing, the rest of the group is NULL.

    ``order`` and ``tie`` are numbers or times.
    """
    _check_order(df, order, tie)
    df = df.withColumn("__x", value)
    largest = largest_group(df, keys)
    if largest <= limit:
        w = Window.partitionBy(*keys).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
        seen = F.max(F.col("__x").isNull().cast("int")).over(w)
        return df.withColumn(out, F.when(seen == 0, F.sum("__x").over(w))).drop("__x")
    cut = with_pieces(df, order, tie, _piece_count(largest, limit))
    sums = cut.groupBy(*keys, "__piece").agg(F.coalesce(F.sum("__x"), F.lit(0)).alias("__s"), F.max(F.col("__x").isNull().cast("int")).alias("__na"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "__piece",
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"),
        F.coalesce(F.max("__na").over(before), F.lit(0)).alias("__na_before"),
    )
    linked = r_join(cut, offsets, [*keys, "__piece"], "left")
    w = Window.partitionBy(*keys, "__piece").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.greatest(F.max(F.col("__x").isNull().cast("int")).over(w), F.col("__na_before"))
    total = F.col("__off") + F.coalesce(F.sum("__x").over(w), F.lit(0))
    return linked.withColumn(out, F.when(seen == 0, total)).drop("__x", "__piece", "__off", "__na_before")


def distinct_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row per key by ``order_by``, missing values last; the other columns are kept.

    This is an aggregate, so repeats are reduced before the shuffle.
    """
    order = [e for c in order_by for e in (F.col(c).isNull().alias(f"{c}_na"), F.col(c))]
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def sampling_index(df: DataFrame, key: Sequence[str], time: str, out: str = "sampling") -> DataFrame:
    """Dense index of the sampling times of each key, one row per key and time.

    The times are made distinct first, so the window holds the times of a key, not its rows.
    """
    times = df.select(*key, time).distinct()
    return times.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(time)))


def dense_position(levels: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Position 1..n of each row of a list of categories (one row per category)."""
    return levels.withColumn("__all", F.lit(1)).withColumn(out, F.row_number().over(Window.partitionBy("__all").orderBy(*order))).drop("__all")


def spike_filter(
    df: DataFrame, key: Sequence[str], order: str, tie: str, col: str, threshold: float, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Keep readings less than ``threshold`` above the previous reading of the same logger.

    The rule is signed, so falls are kept; the first reading and readings next to a missing one
    have no difference and are dropped.
    """
    out = lag_in_group(df, key, order, tie, col, "__prev", limit)
    return out.filter(F.col(col) - F.col("__prev") < threshold).drop("__prev")


def frost_days(
    df: DataFrame, key: Sequence[str], date: str, tie: str, tmin: str, out: str = "frost_days", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Running number of days with a minimum below zero; NULL from the first missing minimum on."""
    return running_sum(df, key, date, tie, (F.col(tmin) < 0).cast("long"), out, limit)


def cumsum_by(df: DataFrame, key: Sequence[str], time: str, col: str, out: str = "cumulative") -> DataFrame:
    """Running total of the sums per time step; one row per key and time after the first step."""
    yearly = df.groupBy(*key, time).agg(F.sum(col).alias(col))
    w = Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return yearly.withColumn(out, F.sum(col).over(w))
