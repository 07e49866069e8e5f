"""Unions and key differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import anti


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union with the name of the origin in a column."""
    return union_all(*[df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def substitute_rows(df: DataFrame, rows: Column, values: Mapping[str, Column], replace: Column | None = None) -> DataFrame:
    """Append a relabelled copy of some rows, after removing the rows they replace."""
    copy = df.filter(rows).withColumns(dict(values))
    kept = df if replace is None else df.filter(~F.coalesce(replace, F.lit(False)))
    return union_all(kept, copy.select(df.columns))


def key_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys in one table but not in the other, with the side that has them."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    only_a = anti(left, right, list(key)).withColumn("only_in", F.lit("a"))
    only_b = anti(right, left, list(key)).withColumn("only_in", F.lit("b"))
    return only_a.unionByName(only_b)


def unique(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
