"""Selecting, deriving and filtering columns and rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_in


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order."""
    a, b = df.columns.index(first), df.columns.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return df.columns[a : b + 1]


def select_range(df: DataFrame, *parts: str, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Select by names and ``first:last`` ranges, then drop and rename (new name → old name)."""
    names: list[str] = []
    for part in parts or tuple(df.columns):
        found = column_range(df, *part.split(":")) if ":" in part else [part]
        names += [n for n in found if n not in names]
    back = {old: new for new, old in (rename or {}).items()}
    return df.select([F.col(n).alias(back.get(n, n)) for n in names if n not in drop])


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same function over many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def empty_columns(df: DataFrame, cols: Sequence[str], rule: str = "null") -> list[str]:
    """Columns with no value (``null``) or never above zero (``positive``), from one aggregate row."""
    if rule == "null":
        exprs = [F.count(c).alias(c) for c in cols]
    elif rule == "positive":
        exprs = [F.coalesce(F.max((F.col(c) > 0).cast("int")), F.lit(0)).alias(c) for c in cols]
    else:
        raise ValueError("rule must be 'null' or 'positive'")
    row = df.agg(*exprs).first()
    return [c for c in cols if row[c] == 0]


def drop_empty_cols(df: DataFrame, rule: str = "null", cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*empty_columns(df, cols or df.columns, rule))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in any (listed) column."""
    return df.dropna("any", subset=list(subset) if subset else None)


def categorize(df: DataFrame, col: str, levels: Sequence[Any], labels: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """Ordered category: label text plus an ordinal column ``<out>_ord``; other values become NULL.

    Labels belong to levels by name, never by sorted position.
    """
    out = out or col
    names = list(labels or levels)
    if len(names) != len(levels):
        raise ValueError("levels and labels differ in length")
    src = F.col(col)
    label, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (level, name) in reversed(list(enumerate(zip(levels, names)))):
        label = F.when(src == level, F.lit(str(name))).otherwise(label)
        order = F.when(src == level, F.lit(i)).otherwise(order)
    return df.select("*", label.alias("__label"), order.alias(f"{out}_ord")).drop(out).withColumnRenamed("__label", out)


def time_bound(df: DataFrame, col: str, text: str) -> Column:
    """A bound in the type of the column, so that the comparison reaches the scan."""
    return F.lit(text).cast(df.schema[col].dataType)


def select_series(
    df: DataFrame,
    site: str | Sequence[str] | None = None,
    start: str = "2000-01-01",
    end: str = "2100-01-01",
    loggers: Sequence[str] = (),
    include: bool = True,
    cap: float | None = None,
    time: str = "date",
) -> DataFrame:
    """Readings of a period (bounds excluded), of sites, of a logger list or of all others."""
    t = F.col(time)
    out = df.filter((t > time_bound(df, time, start)) & (t < time_bound(df, time, end)))
    if site is not None:
        out = out.filter(is_in("site", [site] if isinstance(site, str) else site))
    out = out.filter(is_in("logger", loggers) == F.lit(include))
    return out if cap is None else out.filter(F.col("value") < cap)
