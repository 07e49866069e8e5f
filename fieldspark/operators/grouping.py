"""Grouped summaries and group values attached to rows.

Attaching a group value is an aggregate joined back, not a window over the whole group: the
aggregate combines on the map side and the join can be split, so no task has to hold a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.missing import if_else, ratio
from .joins import r_join


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row, as a scalar subquery; two rows are an error."""
    one = row.select(F.struct(*row.columns).alias("__one"))
    return df.withColumn("__one", one.scalar()).select(*df.columns, *[F.col(f"__one.{c}").alias(c) for c in row.columns])


def attach(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates as extra columns on every row; without keys, of the whole table."""
    exprs = [e.alias(n) for n, e in aggs.items()]
    if not keys:
        return attach_row(df, df.agg(*exprs))
    return r_join(df, df.groupBy(*keys).agg(*exprs), list(keys), "left")


def community_summary(
    df: DataFrame,
    keys: Sequence[str],
    traits: Sequence[str] = (),
    cover: str = "cover",
    species: str = "species",
    kind: str = "freq",
    na_rm: bool = True,
    shift: Mapping[str, float] | None = None,
) -> DataFrame:
    """Richness, diversity, evenness, total cover and weighted trait means and variances.

    One aggregate over one shuffle, whatever the number of traits.
    """
    exprs = [
        A.n_distinct(species).cast("long").alias("richness"),
        A.shannon(cover, na_rm).alias("diversity"),
        A.r_sum(cover, na_rm).alias("sumcover"),
    ]
    for t in traits:
        exprs.append(A.weighted_mean(t, cover).alias(f"wmean_{t}"))
        exprs.append(A.weighted_var(t, cover, kind, (shift or {}).get(t, 0.0)).alias(f"wvar_{t}"))
    out = df.groupBy(*keys).agg(*exprs)
    return out.withColumn("evenness", A.evenness("diversity", "richness"))


def sum_by(df: DataFrame, keys: Sequence[str], col: str, out: str = "sumcover", na_rm: bool = False) -> DataFrame:
    """Group total attached to its rows."""
    return attach(df, keys, **{out: A.r_sum(col, na_rm)})


def collapse_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str], na_rm: bool = False) -> DataFrame:
    """Rows that share a key become one row of sums."""
    return df.groupBy(*keys).agg(*[A.r_sum(c, na_rm).alias(c) for c in cols])


def annual_then_mean(df: DataFrame, key: Sequence[str], year: str, col: str, out: str, weight: str = "rows") -> DataFrame:
    """Yearly sums, then their mean per key.

    ``rows`` weights each year by its number of rows (the sum was attached to rows before the
    mean was taken); ``years`` gives each year the same weight.
    """
    yearly = df.groupBy(*key, year).agg(A.r_sum(col).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    if weight == "rows":
        value = F.try_divide(F.sum(F.col("__sum") * F.col("__n")), F.sum("__n"))
        value = F.when(F.count("__sum") == F.count(F.lit(1)), value)
    elif weight == "years":
        value = A.r_mean("__sum")
    else:
        raise ValueError("weight must be 'rows' or 'years'")
    return yearly.groupBy(*key).agg(value.alias(out))


def daily_summary(readings: DataFrame, keys: Sequence[str], value: str = "value", na_rm: bool = False) -> DataFrame:
    """Mean, maximum, minimum and range per key."""
    out = readings.groupBy(*keys).agg(
        A.r_mean(value, na_rm).alias("meanTemp"),
        A.r_max(value, na_rm).alias("maxTemp"),
        A.r_min(value, na_rm).alias("minTemp"),
    )
    return out.withColumn("magTemp", F.col("maxTemp") - F.col("minTemp"))


def hourly_mean(readings: DataFrame, keys: Sequence[str], time: str = "date", value: str = "value", na_rm: bool = False) -> DataFrame:
    """Mean per key, date and hour."""
    t = F.col(time)
    return (
        readings.select(*keys, F.hour(t).alias("hour"), F.to_date(t).alias("day"), value)
        .groupBy(*keys, "hour", "day")
        .agg(A.r_mean(value, na_rm).alias(value))
    )


def subtract_min(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Values above the group minimum."""
    out = attach(df, keys, __min=F.min(col))
    return out.withColumn(col, F.col(col) - F.col("__min")).drop("__min")


def ratio_of_sums(df: DataFrame, keys: Sequence[str], num: Column, den: Column, out: str, percent: bool = True) -> DataFrame:
    """Ratio of two grouped sums; NULL where the second is 0."""
    value = ratio(F.sum(num), F.sum(den))
    return df.groupBy(*keys).agg((value * F.lit(100.0) if percent else value).alias(out))


def dominance(df: DataFrame, keys: Sequence[str], col: str, threshold: float, out: str = "dominance") -> DataFrame:
    """``dominant`` above a group-mean threshold, ``subordinate`` below, NULL exactly at it."""
    flagged = attach(df, keys, __mean=A.r_mean(col))
    m = F.col("__mean")
    return flagged.withColumn(out, F.when(m > threshold, "dominant").when(m < threshold, "subordinate")).drop("__mean")


def mean_se(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Mean, standard error and number of known values."""
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        A.standard_error(col).alias("se"),
    )


def crosstab_sum(df: DataFrame, row: Sequence[str], col: str, levels: Sequence[str], val: str) -> DataFrame:
    """Cross table of sums, empty cells 0. ``levels`` are listed, so no extra job looks for them."""
    return df.groupBy(*row).pivot(col, list(levels)).agg(F.sum(val)).fillna(0.0, subset=list(levels))


def having_n(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with exactly ``n`` rows."""
    return attach(df, keys, __n=F.count(F.lit(1))).filter(F.col("__n") == n).drop("__n")


def filter_group_max(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows that hold the maximum of their group."""
    return attach(df, keys, __max=F.max(col)).filter(F.col(col) == F.col("__max")).drop("__max")


def first_crossing(df: DataFrame, key: Sequence[str], date: str, cond: Column) -> DataFrame:
    """Rows at the first date on which ``cond`` holds."""
    hit = df.filter(cond)
    return attach(hit, key, __first=F.min(date)).filter(F.col(date) == F.col("__first")).drop("__first")


def scale(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    center: bool = True,
    sd: bool = True,
    prefix: str = "s",
) -> tuple[DataFrame, DataFrame]:
    """Centre and/or standardise; missing values are ignored and stay missing.

    Returns the table and the fitted centres and scales (one row per group), which
    :func:`apply_scale` uses on new data.
    """
    fit_exprs = []
    for c in cols:
        fit_exprs.append((F.avg(c) if center else F.lit(0.0)).alias(f"{c}_center"))
        fit_exprs.append((F.stddev_samp(c) if sd else F.lit(1.0)).alias(f"{c}_scale"))
    fit_exprs.append(F.count(F.lit(1)).alias("n"))
    fitted = df.groupBy(*by).agg(*fit_exprs) if by else df.agg(*fit_exprs)
    return apply_scale(df, fitted, cols, by, prefix), fitted


def apply_scale(df: DataFrame, fitted: DataFrame, cols: Sequence[str], by: Sequence[str] = (), prefix: str = "s") -> DataFrame:
    """Standardise with centres and scales fitted before."""
    slim = fitted.select(*by, *[f"{c}_{p}" for c in cols for p in ("center", "scale")])
    out = r_join(df, slim, list(by), "left") if by else attach_row(df, slim)
    out = out.withColumns({f"{prefix}{c}": ratio(F.col(c) - F.col(f"{c}_center"), F.col(f"{c}_scale")) for c in cols})
    return out.drop(*[f"{c}_{p}" for c in cols for p in ("center", "scale")])


def band_flag(df: DataFrame, ref_filter: Column, col: str, half_width: float, out: str = "in_band") -> DataFrame:
    """Flag values within ``half_width`` of the mean of the reference rows."""
    mean = df.filter(ref_filter).agg(F.avg(col).alias("__mean"))
    flagged = attach_row(df, mean)
    band = F.col(col).between(F.col("__mean") - half_width, F.col("__mean") + half_width)
    return flagged.withColumn(out, band).drop("__mean")


def climatology(df: DataFrame, keys: Sequence[str], date: str, value: str, nominal_year: int = 2018) -> DataFrame:
    """Long-term mean by day of year, laid on a nominal year."""
    out = (
        df.select(*keys, F.dayofyear(date).alias("doy"), value)
        .groupBy(*keys, "doy")
        .agg(F.avg(value).alias("lt_value"))
    )
    origin = F.lit(f"{nominal_year}-01-01").cast("date")
    return out.withColumn("nominal_date", F.date_add(origin, F.col("doy") - 1))


def season_anomaly(df: DataFrame, keys: Sequence[str], date: str, value: str, season_of: Column, nominal_year: int = 2018) -> DataFrame:
    """Yearly season mean minus the long-term season mean of daily climatology.

    ``season_of`` maps a column named ``month`` to a season name or NULL (ignored).
    """
    by_day = climatology(df, keys, date, value, nominal_year)
    lt = (
        by_day.withColumn("month", F.month("nominal_date"))
        .withColumn("season", season_of)
        .filter(F.col("season").isNotNull())
        .groupBy(*keys, "season")
        .agg(F.avg("lt_value").alias("lt_mean"))
    )
    yearly = (
        df.withColumn("month", F.month(date))
        .withColumn("season", season_of)
        .filter(F.col("season").isNotNull())
        .groupBy(*keys, F.year(date).alias("year"), "season")
        .agg(F.avg(value).alias("season_mean"))
    )
    out = r_join(yearly, lt, [*keys, "season"], "left")
    return out.withColumn("anomaly", F.col("season_mean") - F.col("lt_mean"))


def reorder_levels(df: DataFrame, cat: str, stat: Column, descending: bool = False) -> DataFrame:
    """Ordinal position of each category by a statistic, ties by name.

    The ranking runs on the category list, one row per category.
    """
    from .ordered import dense_position

    levels = df.groupBy(cat).agg(stat.alias("stat"))
    order = F.col("stat").desc_nulls_last() if descending else F.col("stat").asc_nulls_last()
    return dense_position(levels, [order, F.col(cat)], f"{cat}_ord")


def share_flag(cond: Column, yes: str, no: str) -> Column:
    return if_else(cond, yes, no)
