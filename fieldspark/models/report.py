"""Readable term tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import case_when

# Pieces of model terms and the text shown for them, applied in this order.
TERM_LABELS = (
    ("GB", "F"),
    ("GF", "B"),
    ("FB", "G"),
    ("smossHeight", "moss"),
    ("smossCov", "moss"),
    ("sPrecip70", "P"),
    ("sTemp70", "t"),
    ("Treatment", ""),
    (":", " x "),
)


def relabel_terms(df: DataFrame, labels: Sequence[tuple[str, str]] = TERM_LABELS, drop: str = "^sd_|^.?Intercept", col: str = "term") -> DataFrame:
    """Replace pieces of the term text in order; rows that match ``drop`` are left out."""
    out = F.col(col)
    for old, new in labels:
        out = F.regexp_replace(out, old, new)
    return df.filter(~F.col(col).rlike(drop)).withColumn(col, out)


def term_class(term: Column) -> Column:
    """Main effect or which climate interaction, from the relabelled term."""
    short, long_ = F.length(term) < 7, F.length(term) > 7
    return case_when(
        (term.contains("x t") & short, "PFG x t"),
        (term.contains("x P") & short, "PFG x P"),
        (term.contains("x t x P") & long_, "PFG x t x P"),
        default="Main effects",
    )


def term_group(term: Column) -> Column:
    """Plant group or climate variable a relabelled term is about."""
    return case_when(
        (term.contains("G"), "Graminoids"),
        (term.contains("F"), "Forbs"),
        (term.contains("B"), "Bryophytes"),
        (term.contains("C"), "Intact vegetation"),
        (term.isin("t", "P"), "Climate"),
    )


def report_table(df: DataFrame, digits: int = 3, names: Mapping[str, str] | None = None) -> DataFrame:
    """Numbers rounded, columns renamed."""
    rounded = [F.round(c.name, digits).alias(c.name) if c.dataType.simpleString() == "double" else F.col(c.name) for c in df.schema.fields]
    return df.select(rounded).withColumnsRenamed(dict(names or {}))
