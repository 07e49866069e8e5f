"""Logger files of any size: lines that know their place, without reading a file in one piece.

Spark deals files out in blocks, and a block's rows come in the file's order. So a line's number is its place in its block
plus the lines of the blocks before it, a running sum over one small row per block. What a file's first
lines say about the others is one row per file, which is laid beside the block rows. Lines are joined with their
block's row only: no file, however large, meets in one task, and lines move only where there are too many blocks to
send their table round.

The files are opened once: very many small ones cost more to open than to read. Their lines are stored in columns, where
a path and a block number take next to nothing, and blocks, headers and lines are read from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import site_from_name
from ..session import cut_lineage, ensure_checkpoint_dir
from .loggers import EXCLUDED_NAMES, keep_file, logger_kind, parse_button_lines, parse_channel_lines, parse_two_column_lines

#: Lines of a file that may belong to its header.
HEADER_LINES = 30


def file_path() -> Column:
    """The file of a row, as its name is written; Spark gives it as a URI, in which a plus sign is itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _placed(spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str], encoding: str) -> DataFrame:
    """Lines with file, block, and a number that grows by one from line to line of a block."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root)
    # The bytes as they are in the file; a carriage return is part of no value.
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), r"\r", "")
    rows = raw.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), line.alias("line"))
    return rows.filter(keep_file("path", include, exclude))


def _stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the checkpoint folder, in a few parts per core."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    rows.coalesce(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scan_log_lines(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = ("csv", "txt"),
    exclude: Sequence[str] = EXCLUDED_NAMES,
    encoding: str = "UTF-8",
    header_lines: int = HEADER_LINES,
) -> DataFrame:
    """Lines of all files below ``root``: ``path, line_no`` (from 0), ``line``, ``head``.

    ``head`` has the file's first ``header_lines`` lines (all, if there are fewer). Empty files have no lines; the line after a last line end is none.
    Files are kept by extension and name as in :func:`~fieldspark.sources.loggers.scan_logs`, and have no largest size.
    """
    rows = _stored(_placed(spark, root, include, exclude, encoding))
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = cut_lineage(blocks.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"))
    # The header may reach into a second block, where blocks are tiny.
    starts = blocks.filter(F.col("before") < header_lines)
    top = rows.join(starts, ["path", "block"]).withColumn("line_no", F.col("before") + F.col("at") - F.col("first")).filter(F.col("line_no") < header_lines)
    heads = top.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("head"))
    headed = cut_lineage(blocks.join(heads, "path"))
    out = rows.join(headed, ["path", "block"])
    return out.select("path", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "line", "head")


def button_readings(spark: SparkSession, root: str, encoding: str = "UTF-8", header_lines: int = 19) -> DataFrame:
    """Readings of button loggers: ``path, date, unit, value``."""
    return parse_button_lines(scan_log_lines(spark, root, encoding=encoding).drop("head"), header_lines)


def channel_readings(lines: DataFrame) -> DataFrame:
    """Readings of the multi-channel files among scanned lines: ``path, date, logger, value``."""
    first = F.get("head", F.lit(0))
    kept = lines.filter(logger_kind(first) == "multi").withColumn("first_line", first).drop("head")
    return parse_channel_lines(kept)


def two_column_readings(lines: DataFrame) -> DataFrame:
    """Readings of the two-channel files among scanned lines: ``path, date, value, logger, site``.

    The body follows the line ``Sample``; a file without one in its header stops the query.
    """
    second = lambda n: F.get(F.split(F.get("head", F.lit(n)), "\t"), F.lit(1))
    start = F.array_position(F.transform("head", F.trim), "Sample")
    start = F.when(start > 0, start).otherwise(F.raise_error(F.concat(F.lit("no Sample line in "), F.col("path"))).cast("long"))
    kept = lines.filter(logger_kind(F.get("head", F.lit(0))) == "two")
    body = kept.select("path", "line_no", "line", second(2).alias("site_header"), second(3).alias("depth_header"), start.alias("start"))
    return parse_two_column_lines(body.filter(F.col("line_no") >= F.col("start")).drop("start"))


def logger_readings(spark: SparkSession, root: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Readings of both kinds of files below ``root``: ``path, date, logger, value, site, type, file``.

    The site of a multi-channel file is in its name, that of a two-channel file in its header or path. Files of neither
    kind give no rows.
    """
    lines = scan_log_lines(spark, root, include=("txt",), encoding=encoding)
    name = F.element_at(F.split("path", "/"), -1)
    multi = channel_readings(lines).withColumns({"site": site_from_name(name), "type": F.lit("ITAS"), "file": name})
    two = two_column_readings(lines).withColumns({"type": F.lit("UTL"), "file": name})
    return multi.unionByName(two)
