"""What the operators share: tables, session settings, stored intermediates, files of constants."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_settings, ensure_checkpoint_dir

# Arrow batches that keep a Python worker small whatever the rows hold.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
# Operators of many stored steps would fill the disk otherwise: shuffle files go when the step that made them has ended.
# A DataFrame that is executed again makes them anew.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators count on: adaptive skew handling, small Arrow batches, shuffle files removed early."""
    for key, value in (BATCHES | CLEANUP).items():
        spark.conf.set(key, value)
    return apply_runtime_settings(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor repeats no earlier work."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_apart(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns; extra ones, whatever their names, take no part."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df.select(*[F.col(f"`{n}`") for n in names])


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to every Arrow batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; tasks get its bytes, at most a few MB."""
    with open(path, "rb") as f:
        return f.read()
