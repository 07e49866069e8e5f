"""Wide and long tables, key grids, nested rows and glued columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ColumnLike, as_col, paste
from .joins import r_join, unique_by
from .ordered import GROUP_LIMIT
from .projection import column_range


def gather(
    df: DataFrame, cols: Sequence[str] | str, key: str = "key", value: str = "value", na_rm: bool = False
) -> DataFrame:
    """Wide to long. ``cols`` is a list or a ``first:last`` range."""
    if isinstance(cols, str):
        cols = column_range(df, *cols.split(":"))
    ids = [c for c in df.columns if c not in cols]
    out = df.unpivot(ids, list(cols), key, value)
    return out.filter(F.col(value).isNotNull()) if na_rm else out


def spread(
    df: DataFrame,
    keys: Sequence[str],
    key: str,
    value: str,
    levels: Sequence[object],
    fill: object = None,
) -> DataFrame:
    """Long to wide with the listed levels; two values for one cell stop the query."""
    cells = unique_by(df, [*keys, key], [value], "cells")
    out = cells.groupBy(*keys).pivot(key, list(levels)).agg(F.first(value))
    return out if fill is None else out.fillna(fill, subset=[str(v) for v in levels])


def levels_of(df: DataFrame, col: str, limit: int = 10_000) -> list[object]:
    """Distinct values of a category column, in order; an error beyond ``limit``."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} levels")
    return sorted(r[0] for r in rows)


def complete(df: DataFrame, key: str, levels: Sequence[object], over: Sequence[str]) -> DataFrame:
    """Add rows so that each distinct ``over`` combination has every level of ``key``.

    The listed levels are exploded on each combination; missing rows hold NULL.
    """
    frame = df.select(*over).distinct().withColumn(key, F.explode(F.array(*[F.lit(v) for v in levels])))
    return r_join(frame, df, [*over, key], "left").select(df.columns)


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Split one text column into several; missing parts are NULL."""
    parts = F.split(F.col(col), sep)
    out = df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into)})
    return out.drop(col) if remove and col not in into else out


def unite(df: DataFrame, out: str, cols: Sequence[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Glue columns as text; a missing part reads ``NA``."""
    glued = df.withColumn(out, paste(*cols, sep=sep))
    return glued.drop(*[c for c in cols if c != out]) if remove else glued


def interaction(*cols: ColumnLike) -> Column:
    """Composite category of several categories, NULL if one is missing."""
    return F.concat(*[p for i, c in enumerate(cols) for p in ((F.lit("."), as_col(c).cast("string")) if i else (as_col(c).cast("string"),))])


def nest(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "data", max_rows: int = GROUP_LIMIT // 40
) -> DataFrame:
    """Rows of each key as an array of structs, sorted by ``order_by``, which is unique.

    A key with more than ``max_rows`` rows is held in several rows, numbered by ``part``, so that
    no row or task holds an unbounded group. Nothing is dropped: :func:`unnest` gives back all rows.
    """
    rest = [*order_by, *[c for c in df.columns if c not in keys and c not in order_by]]
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(max_rows))).cast("int").alias("__parts"))
    sized = r_join(df, counts, list(keys), "left")
    # The part follows from the row's id, so a repeated task puts the row in the same part.
    part = F.pmod(F.xxhash64(*order_by), F.col("__parts")).cast("int")
    return sized.withColumn("part", part).groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(out))


def unnest(df: DataFrame, col: str = "data") -> DataFrame:
    """One row per array entry."""
    others = [c for c in df.columns if c not in (col, "part")]
    return df.select(*others, F.inline(col))
