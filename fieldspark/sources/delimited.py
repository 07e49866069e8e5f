"""Delimited text files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import parse_number
from ..operators.sets import union_all


def read_delim(
    spark: SparkSession, path: str | list[str], sep: str = ";", columns: Sequence[str] | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """All columns as text. With ``columns`` nothing has to be read to find the schema."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("inferSchema", False)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def decimal_comma(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Columns written with a decimal comma as doubles; unreadable text is NULL."""
    return df.withColumns({c: parse_number(c, ",") for c in numeric})


def read_decimal_comma(
    spark: SparkSession, path: str | list[str], numeric: Sequence[str], sep: str = ";", columns: Sequence[str] | None = None
) -> DataFrame:
    return decimal_comma(read_delim(spark, path, sep, columns), numeric)


def read_parts(
    parts: Sequence[DataFrame], casts: Mapping[str, str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """Union of the parts of one table, each cast and stripped of unwanted columns first."""
    casts = casts or {}
    cleaned = [
        p.drop(*drop).withColumns({c: F.col(c).cast("string").try_cast(t) for c, t in casts.items() if c in p.columns})
        for p in parts
    ]
    return union_all(*cleaned)
