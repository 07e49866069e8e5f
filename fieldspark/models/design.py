"""Design matrices with treatment contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = str | tuple[str, ...]
INTERCEPT = "Intercept"


def _names(term: Term) -> tuple[str, ...]:
    return tuple(term.split(":")) if isinstance(term, str) else tuple(term)


def design_columns(
    terms: Sequence[Term], factors: Mapping[str, Sequence[object]] | None = None, intercept: bool = True
) -> dict[str, Column]:
    """Column expressions of a design.

    ``terms`` name variables and interactions (``"tr:x"``). ``factors`` lists the levels of each
    category, the reference level first. Inside a term a factor drops its reference level when
    the rest of the term is in the design too, otherwise it keeps all levels.
    """
    factors = factors or {}
    sets = [frozenset(_names(t)) for t in terms]
    known = set(sets) | ({frozenset()} if intercept else set())
    out: dict[str, Column] = {INTERCEPT: F.lit(1.0)} if intercept else {}
    for term in terms:
        parts = _names(term)
        options: list[list[tuple[str, Column]]] = []
        for p in parts:
            if p not in factors:
                options.append([(p, F.col(p).cast("double"))])
                continue
            levels = list(factors[p])
            if frozenset(parts) - {p} in known:
                levels = levels[1:]
            options.append([(f"{p}_{v}", F.when(F.col(p).isNotNull(), (F.col(p) == v).cast("double"))) for v in levels])
        for combo in product(*options):
            value = combo[0][1]
            for _, c in combo[1:]:
                value = value * c
            out["__".join(n for n, _ in combo)] = value
    return out


def model_matrix(
    df: DataFrame,
    terms: Sequence[Term],
    factors: Mapping[str, Sequence[object]] | None = None,
    intercept: bool = True,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """The design as columns beside the kept columns, and the names of its columns."""
    cols = design_columns(terms, factors, intercept)
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()]), list(cols)
