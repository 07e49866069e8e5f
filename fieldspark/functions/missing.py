"""Missing-value rules for column expressions.

One missing value exists: NULL. NaN and infinite results become NULL, negated membership keeps
NULL rows, a NULL condition gives NULL, and pasting a NULL gives the text ``NA``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def is_in(c: ColumnLike, values: Iterable[Any]) -> Column:
    """Membership that is never NULL, so ``~is_in`` keeps rows whose value is missing."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def if_else(cond: Column, yes: Any, no: Any, missing: Any = None) -> Column:
    """Two-way choice; a NULL condition gives ``missing``."""
    return F.when(cond.isNull(), as_lit(missing)).when(cond, as_lit(yes)).otherwise(as_lit(no))


def case_when(*branches: tuple[Column, Any], default: Any = None) -> Column:
    """First true branch wins; a NULL condition is no match."""
    out = F.when(branches[0][0], as_lit(branches[0][1]))
    for cond, value in branches[1:]:
        out = out.when(cond, as_lit(value))
    return out.otherwise(as_lit(default))


def paste(*cols: ColumnLike, sep: str = "") -> Column:
    """Glue values as text; a missing value reads ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def recode(c: ColumnLike, mapping: Mapping[Any, Any], default: str = "keep") -> Column:
    """Replace values by lookup; unmatched values stay (``keep``) or become NULL (``null``)."""
    if default not in ("keep", "null"):
        raise ValueError("default must be 'keep' or 'null'")
    col = as_col(c)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), col)
    return F.coalesce(found, col) if default == "keep" else found


def finite(c: ColumnLike) -> Column:
    """NaN and infinities as NULL."""
    col = as_col(c)
    bad = F.isnan(col) | col.isin(float("inf"), float("-inf"))
    return F.when(~bad, col)


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """Division that is NULL where the denominator is 0."""
    return F.try_divide(as_col(num), as_col(den))


def parse_number(c: ColumnLike, decimal: str = ".") -> Column:
    """Text to double; unreadable text gives NULL."""
    col = F.trim(as_col(c))
    if decimal != ".":
        col = F.replace(col, F.lit(decimal), F.lit("."))
    return col.try_cast("double")


def coalesce_blank(a: ColumnLike, b: ColumnLike) -> Column:
    """``a`` unless it is missing or blank, else ``b``."""
    return F.coalesce(F.when(F.trim(as_col(a)) != "", as_col(a)), as_col(b))


def update_where(cond: Column, value: Any, c: ColumnLike) -> Column:
    """``value`` where ``cond`` holds, else the old value (also where ``cond`` is NULL)."""
    return F.when(cond, as_lit(value)).otherwise(as_col(c))


def row_sum(*cols: ColumnLike) -> Column:
    """Sum over columns of one row, missing values ignored; 0 when all are missing."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(as_col(c).cast("double"), F.lit(0.0))
    return total


def row_mean(*cols: ColumnLike) -> Column:
    """Mean over columns of one row, missing values ignored; NULL when all are missing."""
    n = F.lit(0)
    for c in cols:
        n = n + as_col(c).isNotNull().cast("int")
    return F.try_divide(row_sum(*cols), n)
