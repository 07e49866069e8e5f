"""Logger files: recursive scan, keys from paths, and the three body formats.

The scan is one distributed read. Every parser works on lines, so it is the same expression for
a folder of files and for lines that already lie in a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import dmy_hms, mdy_hms, ymd_hms
from ..functions.missing import ColumnLike, as_col, parse_number
from ..functions.text import clean_logger_id, site_from_name, strip_stray_bytes, without_extension

# Files whose name contains one of these hold no readings.
EXCLUDED_NAMES = ("log", "empty", "unknown")


def keep_file(path: ColumnLike, include: Sequence[str] = ("csv", "txt"), exclude: Sequence[str] = EXCLUDED_NAMES) -> Column:
    """File has a wanted extension and no excluded word in its name."""
    p = F.lower(as_col(path))
    wanted = p.rlike(r"\.(" + "|".join(include) + ")$")
    name = F.element_at(F.split(p, "/"), -1)
    return wanted & ~name.rlike("|".join(exclude)) if exclude else wanted


def scan_logs(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = ("csv", "txt"),
    exclude: Sequence[str] = EXCLUDED_NAMES,
    encoding: str = "UTF-8",
    max_bytes: int = 256 << 20,
) -> DataFrame:
    """Files below ``root`` as rows ``path, text``.

    Logger files are small, and their headers give meaning to the lines, so a file is read whole;
    one above ``max_bytes`` stops the query.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .filter(keep_file("path", include, exclude))
    )
    ok = F.when(F.col("length") <= max_bytes, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("logger file too large: "), F.col("path"))).cast("boolean")
    )
    return files.filter(ok).select("path", F.decode("content", encoding).alias("text"))


def file_lines(files: DataFrame) -> DataFrame:
    """Files as rows ``path, first_line, line_no, line`` (numbered from 0)."""
    rows = F.split(F.regexp_replace("text", r"\r", ""), "\n")
    return files.select("path", F.get(rows, F.lit(0)).alias("first_line"), F.posexplode(rows).alias("line_no", "line"))


def with_path_keys(df: DataFrame, spec: Mapping[str, int], path: str = "path", id_col: str = "loggerID") -> DataFrame:
    """Columns from parts of the path, counted from the end (-1 is the file name).

    The logger ID is the file name without extension; ``ID`` is ``<logger>_<year>``.
    """
    parts = F.split(F.col(path), "/")
    out = df.withColumns({name: F.try_element_at(parts, F.lit(i)) for name, i in spec.items()})
    out = out.withColumn(id_col, without_extension(F.element_at(parts, -1)))
    if "Year" in spec:
        out = out.withColumn("ID", F.concat_ws("_", clean_logger_id(id_col), F.col("Year")))
    return out


def parse_button_lines(lines: DataFrame, header_lines: int = 19) -> DataFrame:
    """Button-logger lines to ``date, unit, value``.

    ``.txt`` files split the value into an integer and a fraction field; ``.csv`` files have a
    header and US dates.
    """
    f = F.split(F.trim("line"), ",")
    is_csv = F.lower(F.col("path")).endswith(".csv")
    value = F.when(
        is_csv | (F.size(f) == 3), parse_number(F.get(f, F.lit(2)))
    ).otherwise(parse_number(F.concat_ws(".", F.get(f, F.lit(2)), F.get(f, F.lit(3)))))
    date = F.when(is_csv, mdy_hms(F.get(f, F.lit(0)))).otherwise(dmy_hms(F.get(f, F.lit(0))))
    keep = (~is_csv | (F.col("line_no") >= header_lines)) & (F.trim("line") != "")
    rest = [c for c in lines.columns if c not in ("line", "line_no", "first_line")]
    return lines.filter(keep).select(*rest, date.alias("date"), F.get(f, F.lit(1)).alias("unit"), value.alias("value"))


def parse_button_logs(files: DataFrame) -> DataFrame:
    return parse_button_lines(file_lines(files))


def logger_kind(first_line: ColumnLike) -> Column:
    """``multi`` for multi-channel files, ``two`` for two-channel files, NULL for others."""
    c = as_col(first_line)
    return F.when(c.contains("Label"), "multi").when(c.contains("Versi"), "two")


def parse_channel_lines(lines: DataFrame) -> DataFrame:
    """Multi-channel lines to ``date, logger, value`` (one row per channel).

    ``first_line`` names the channels. The unit row is skipped, over- and underflow marks become
    missing, and a separate time column, which has no name, is joined to the date.
    """
    names = F.transform(F.split("first_line", "\t"), lambda x: F.lower(F.replace(F.trim(x), F.lit("-"), F.lit(""))))
    fields = F.split(strip_stray_bytes("line"), "\t")
    own_time = F.get(names, F.lit(1)).isin("", "x2")
    stamp = F.when(
        own_time, F.concat_ws(" ", F.substring_index(F.get(fields, F.lit(0)), " ", 1), F.get(fields, F.lit(1)))
    ).otherwise(F.get(fields, F.lit(0)))
    body = lines.filter((F.col("line_no") > 1) & (F.trim("line") != ""))
    rest = [c for c in lines.columns if c not in ("line", "line_no", "first_line")]
    skip = F.when(own_time, 2).otherwise(1)
    pairs = F.arrays_zip(names.alias("logger"), fields.alias("raw"))
    wide = body.select(*rest, dmy_hms(stamp).alias("date"), skip.alias("__skip"), F.posexplode(pairs).alias("__i", "__p"))
    raw = F.col("__p.raw")
    value = F.when(~raw.isin("#-INF", "#+INF"), parse_number(raw, ","))
    return wide.filter((F.col("__i") >= F.col("__skip")) & F.col("__p.logger").isNotNull()).select(
        *rest, "date", F.col("__p.logger").alias("logger"), value.alias("value")
    )


def parse_itas(files: DataFrame) -> DataFrame:
    """Multi-channel logger files with site, type and file columns."""
    lines = file_lines(files).filter(logger_kind("first_line") == "multi")
    name = F.element_at(F.split("path", "/"), -1)
    return parse_channel_lines(lines).withColumns(
        {"site": site_from_name(name), "type": F.lit("ITAS"), "file": name}
    )


def depth_channel(depth: ColumnLike) -> Column:
    """``temp30cm``/``temp200cm`` from a depth tag; other tags stay as they are."""
    tag = F.replace(as_col(depth), F.lit(" "), F.lit(""))
    return F.when(tag.isin("200cm", "30cm"), F.concat(F.lit("temp"), tag)).otherwise(tag)


def site_from_path(path: ColumnLike) -> Column:
    """Folder of the file, or the one above when that is named after the logger type."""
    parts = F.split(as_col(path), "/")
    last = F.try_element_at(parts, F.lit(-2))
    return F.when(last == "UTL", F.try_element_at(parts, F.lit(-3))).otherwise(last)


def parse_two_column_lines(lines: DataFrame) -> DataFrame:
    """Two-channel lines with columns ``site_header, depth_header`` to ``date, value, logger, site``."""
    f = F.split(F.trim("line"), r"[\t ]+")
    stamp = F.concat_ws(" ", F.get(f, F.lit(0)), F.get(f, F.lit(1)))
    header = F.trim(F.coalesce(F.col("site_header"), F.lit("")))
    blank = header.isin("", "Nr. 1 - luft")
    rest = [c for c in lines.columns if c not in ("line", "line_no", "first_line", "site_header", "depth_header")]
    return lines.filter(F.trim("line") != "").select(
        *rest,
        ymd_hms(stamp).alias("date"),
        parse_number(F.get(f, F.lit(2)), ",").alias("value"),
        depth_channel("depth_header").alias("logger"),
        site_from_name(F.when(blank, site_from_path("path")).otherwise(header)).alias("site"),
    )


def parse_utl(files: DataFrame) -> DataFrame:
    """Two-channel logger files: the body starts after the line ``Sample``."""
    rows = F.split(F.regexp_replace("text", r"\r", ""), "\n")
    start = F.array_position(F.transform(rows, F.trim), "Sample")
    start = F.when(start > 0, start).otherwise(
        F.raise_error(F.concat(F.lit("no Sample line in "), F.col("path"))).cast("long")
    )
    second = lambda n: F.get(F.split(F.get(rows, F.lit(n)), "\t"), F.lit(1))
    kept = files.filter(logger_kind(F.get(rows, F.lit(0))) == "two")
    lines = kept.select(
        "path",
        second(2).alias("site_header"),
        second(3).alias("depth_header"),
        F.posexplode(F.slice(rows, start.cast("int") + 1, F.size(rows))).alias("line_no", "line"),
    )
    out = parse_two_column_lines(lines)
    return out.withColumns({"type": F.lit("UTL"), "file": F.element_at(F.split("path", "/"), -1)})


def read_loggers(spark: SparkSession, root: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Both multi- and two-channel files of a folder; files of neither kind are left out."""
    files = scan_logs(spark, root, include=("txt",), encoding=encoding)
    return parse_itas(files).unionByName(parse_utl(files), allowMissingColumns=True)


def unrecognised_files(files: DataFrame) -> DataFrame:
    """Files of neither kind, for a quarantine table."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    return files.filter(logger_kind(first).isNull()).select("path", first.alias("first_line"))
