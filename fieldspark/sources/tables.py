"""Database or Parquet tables, saved datasets and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import CORE


def load_tables(
    spark: SparkSession, source: str | Mapping[str, str], names: Sequence[str], partition: Mapping[str, Mapping[str, str]] | None = None
) -> dict[str, DataFrame]:
    """Tables by name from a Parquet folder or a JDBC source.

    Both are lazy: projections and filters reach the files or the database. ``partition`` gives
    JDBC split options per large table (partitionColumn, lowerBound, upperBound, numPartitions).
    """
    if isinstance(source, str):
        return {n: spark.read.parquet(f"{source.rstrip('/')}/{n}.parquet") for n in names}
    out = {}
    for n in names:
        options = {**source, "dbtable": n, **(partition or {}).get(n, {})}
        out[n] = spark.read.format("jdbc").options(**options).load()
    return out


def conform(df: DataFrame, relation: str) -> DataFrame:
    """Columns of a core relation in their declared types; unreadable text becomes NULL."""
    from pyspark.sql import functions as F

    schema: T.StructType = CORE[relation]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{relation} lacks columns {missing}")
    return df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Dataset handed from one job to the next, partitioned for pruning."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def write_result_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """Result table as CSV with a header; NULL is written as ``NA``."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Save a table whose rows lie by key, and read it: groups and joins by these keys move nothing any more.

    The one shuffle is paid here. Every bucket is one file per value of ``partition_by``. A hot key is one bucket's, as in any
    table that spares the shuffle; keys that hold a large share of the rows belong in ``partition_by`` or in a plain table.
    """
    rows = df.repartition(buckets, *keys).sortWithinPartitions(*partition_by, *keys)
    writer = rows.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def replace_parts(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Write the partitions anew that ``df`` has rows of; all others stay, and so do the buckets. Columns go by name."""
    spark = df.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    rows = df.select(*spark.table(name).columns).repartition(buckets, *keys)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(name)
