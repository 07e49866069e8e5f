"""Exact and approximate quantiles, and the summaries built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import r_join
from .ordered import GROUP_LIMIT, _piece_count, largest_group, with_pieces


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    method: str = "exact",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Quantiles by linear interpolation, missing values ignored.

    ``exact`` uses the built-in aggregate while every group fits a task. Beyond ``limit`` rows in
    a group it counts equal values, cuts them into pieces by value, and sorts only the pieces
    that hold a wanted rank. ``approx`` uses mergeable sketches.
    """
    names = list(names or [f"q{round(p * 100, 6):g}" for p in probs])
    data = df.select(*keys, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    if method == "approx":
        agg = data.groupBy(*keys).agg(F.percentile_approx("__v", list(probs), 10000).alias("__q"))
        return agg.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    largest = largest_group(data, keys)
    if largest <= limit:
        agg = data.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("__q"))
        return agg.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    return _split_quantiles(data, list(keys), list(probs), names, _piece_count(largest, limit))


def _split_quantiles(data: DataFrame, keys: list[str], probs: list[float], names: list[str], pieces: int) -> DataFrame:
    whole = not keys
    if whole:
        data, keys = data.withColumn("__all", F.lit(1)), ["__all"]
    values = with_pieces(data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")), "__v", None, pieces)
    per_piece = values.groupBy(*keys, "__piece").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    per_piece = per_piece.select(
        *keys,
        "__piece",
        "__m",
        F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"),
        F.sum("__m").over(Window.partitionBy(*keys)).alias("__total"),
    )
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("__total") - 1) * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)])
    wanted = (
        per_piece.withColumn("__r", F.explode(ranks))
        .select(*keys, "__piece", "__start", "__m", "__r.i", "__r.h")
        .withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))))
        .filter((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__start") + F.col("__m")))
    )
    held = r_join(values, wanted.select(*keys, "__piece").distinct(), [*keys, "__piece"], "left_semi")
    upto = Window.partitionBy(*keys, "__piece").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__upto", F.sum("__n").over(upto))
    found = (
        r_join(wanted, held, [*keys, "__piece"], "inner")
        .filter(
            (F.col("__start") + F.col("__upto") > F.col("__rank"))
            & (F.col("__start") + F.col("__upto") - F.col("__n") <= F.col("__rank"))
        )
        .groupBy(*keys, "i", "h")
        .agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        .withColumn("q", F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo")))
    )
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    return out.drop("__all") if whole else out


def box_stats(df: DataFrame, keys: Sequence[str], col: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 × IQR, and the number of values outside."""
    q = quantiles(df, keys, col, [0.25, 0.5, 0.75], ["q1", "median", "q3"], limit=limit)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("__lo", F.col("q1") - 1.5 * iqr).withColumn("__hi", F.col("q3") + 1.5 * iqr)
    rows = df.select(*keys, F.col(col).alias("__x")).filter(F.col("__x").isNotNull())
    joined = r_join(rows, q, list(keys), "inner")
    inside = F.col("__x").between(F.col("__lo"), F.col("__hi"))
    return joined.groupBy(*keys).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
    )
