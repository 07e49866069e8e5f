"""Aggregate expressions with an explicit missing-value policy.

All of them are built from Spark's own declarative aggregates, so they combine on the map side
and a group that holds most of the rows is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col


def _policy(c: Column, value: Column, na_rm: bool) -> Column:
    return value if na_rm else F.when(F.count(F.lit(1)) == F.count(c), value)


def r_sum(c: ColumnLike, na_rm: bool = False) -> Column:
    """Sum; NULL if a value is missing unless ``na_rm``, and 0 when nothing is left."""
    col = as_col(c)
    return _policy(col, F.coalesce(F.sum(col), F.lit(0)), na_rm)


def r_mean(c: ColumnLike, na_rm: bool = False) -> Column:
    return _policy(as_col(c), F.avg(as_col(c)), na_rm)


def r_min(c: ColumnLike, na_rm: bool = False) -> Column:
    return _policy(as_col(c), F.min(as_col(c)), na_rm)


def r_max(c: ColumnLike, na_rm: bool = False) -> Column:
    return _policy(as_col(c), F.max(as_col(c)), na_rm)


def r_var(c: ColumnLike, na_rm: bool = False) -> Column:
    """Sample variance; NULL for fewer than two values."""
    col = as_col(c)
    return _policy(col, F.when(F.count(col) > 1, F.var_samp(col)), na_rm)


def r_sd(c: ColumnLike, na_rm: bool = False) -> Column:
    return F.sqrt(r_var(c, na_rm))


def n_distinct(c: ColumnLike, na_rm: bool = False) -> Column:
    """Distinct values; a missing value counts as one more value unless ``na_rm``."""
    col = as_col(c)
    known = F.count_distinct(col)
    return known if na_rm else known + F.max(col.isNull().cast("int"))


def weighted_mean(x: ColumnLike, w: ColumnLike, na_rm: bool = True) -> Column:
    """``sum(xw)/sum(w)`` over rows with a known ``x``; NULL if such a row has no weight."""
    xc, wc = as_col(x), as_col(w)
    value = F.try_divide(F.sum(xc * wc), F.sum(F.when(xc.isNotNull(), wc)))
    no_weight = F.max((xc.isNotNull() & wc.isNull()).cast("int")) == 1
    value = F.when(~no_weight, value)
    return _policy(xc, value, na_rm)


def weighted_var(x: ColumnLike, w: ColumnLike, kind: str = "freq", shift: float = 0.0) -> Column:
    """Weighted variance over rows with both values known, in one pass of moments.

    ``freq`` divides by ``sum(w) - 1``; ``reliability`` scales by ``sum(w) / (sum(w)^2 - sum(w^2))``.
    Pass a ``shift`` near the mean when values are large against their spread.
    """
    if kind not in ("freq", "reliability"):
        raise ValueError("kind must be 'freq' or 'reliability'")
    known = as_col(x).isNotNull() & as_col(w).isNotNull()
    xc = F.when(known, as_col(x).cast("double") - F.lit(float(shift)))
    wc = F.when(known, as_col(w).cast("double"))
    sw, sww = F.sum(wc), F.sum(wc * wc)
    ss = F.sum(wc * xc * xc) - F.try_divide(F.sum(wc * xc) * F.sum(wc * xc), sw)
    ss = F.greatest(ss, F.lit(0.0))
    if kind == "freq":
        return F.when(sw > 1, F.try_divide(ss, sw - 1))
    return F.when(sw * sw > sww, F.try_divide(ss * sw, sw * sw - sww))


def shannon(cover: ColumnLike, na_rm: bool = False) -> Column:
    """Shannon index with natural log in one pass; zero covers contribute nothing."""
    c = as_col(cover)
    s = F.sum(c)
    clogc = F.sum(F.when(c > 0, c * F.ln(c)).when(c == 0, F.lit(0.0)))
    return _policy(c, F.when(s > 0, F.ln(s) - F.try_divide(clogc, s)), na_rm)


def evenness(h: ColumnLike, richness: ColumnLike) -> Column:
    """``H / ln(richness)``; NULL when there is one species."""
    return F.try_divide(as_col(h), F.ln(as_col(richness).cast("double")))


def standard_error(c: ColumnLike) -> Column:
    col = as_col(c)
    return F.when(F.count(col) > 1, F.try_divide(F.stddev_samp(col), F.sqrt(F.count(col).cast("double"))))


def percent_of_sums(num: ColumnLike, den: ColumnLike) -> Column:
    """100 × ratio of two sums; NULL where the second is 0."""
    return F.try_divide(F.sum(as_col(num)) * F.lit(100.0), F.sum(as_col(den)))
