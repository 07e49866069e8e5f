"""Text clean-up and key building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col, paste

# Site code by pattern, tried in this order on the lower-case file name.
SITE_PATTERNS = (
    ("ulv|ule", "ulv"),
    ("gud", "gud"),
    ("skj", "skj"),
    ("ram", "ram"),
    ("ves", "ves"),
    ("fau", "fau"),
    ("vik", "vik"),
    ("arn|arh", "arh"),
    (".vs|qqvs", "ovs"),
    ("h.g|hqqg", "hog"),
    ("qqlr|aqqlr|.lr|aal|ålr|ål", "alr"),
    ("l.v|laqqv|lqqv|lqv", "lav"),
)


def site_from_name(c: ColumnLike, strict: bool = True) -> Column:
    """Three-letter site code from a messy file name.

    An unknown name is an error when ``strict``; otherwise it is NULL, so that the caller can
    divert such rows to a quarantine table.
    """
    name = F.lower(as_col(c))
    out = F.when(name.rlike(SITE_PATTERNS[0][0]), F.lit(SITE_PATTERNS[0][1]))
    for pattern, code in SITE_PATTERNS[1:]:
        out = out.when(name.rlike(pattern), F.lit(code))
    if strict:
        return out.otherwise(F.raise_error(F.concat(F.lit("no site in file name "), F.coalesce(name, F.lit("NA")))).cast("string"))
    return out


def digits_only(c: ColumnLike) -> Column:
    """Keep the digits 0-9."""
    return F.regexp_replace(as_col(c), "[^0-9]", "")


def species_code(c: ColumnLike) -> Column:
    """Species names with dots for blanks and underscores, trimmed."""
    return F.regexp_replace(F.trim(as_col(c)), "[ _]", ".")


def without_extension(c: ColumnLike, extensions: tuple[str, ...] = ("csv", "txt")) -> Column:
    return F.regexp_replace(as_col(c), r"\.(" + "|".join(extensions) + r")\b", "")


def turf_key(site: ColumnLike, block: ColumnLike, treatment: ColumnLike) -> Column:
    """Three letters of the site, block and treatment glued; a missing part reads ``NA``."""
    return paste(F.substring(as_col(site), 1, 3), block, treatment)


def strip_stray_bytes(c: ColumnLike) -> Column:
    """Replace the letters that single-byte logger software writes in place of ``o``."""
    return F.translate(as_col(c), "øØ", "oO")


def clean_logger_id(c: ColumnLike) -> Column:
    """Logger id without file extension, zero padding and model suffix."""
    # The parts that file names add to a logger id.
    return F.regexp_replace(as_col(c), r"\.csv|\.txt|000000| DS1922L", "")
