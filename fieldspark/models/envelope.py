"""Upper quantile envelope over time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bspline_basis(x: np.ndarray, df: int, degree: int = 3) -> np.ndarray:
    """Cubic B-spline basis with ``df`` columns and knots at quantiles of ``x``, without the first column."""
    inner = np.quantile(x, np.linspace(0, 1, df - degree + 2)[1:-1]) if df > degree else np.array([])
    lo, hi = x.min(), x.max()
    knots = np.r_[[lo] * (degree + 1), inner, [hi] * (degree + 1)]
    n = len(knots) - degree - 1
    basis = np.zeros((len(x), len(knots) - 1))
    for i in range(len(knots) - 1):
        basis[:, i] = (x >= knots[i]) & (x < knots[i + 1])
    last = int(np.max(np.nonzero(np.diff(knots) > 0))) if hi > lo else degree
    basis[x >= hi, :] = 0
    basis[x >= hi, last] = 1
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(knots) - 1 - d))
        for i in range(len(knots) - 1 - d):
            a = knots[i + d] - knots[i]
            b = knots[i + d + 1] - knots[i + 1]
            left = (x - knots[i]) / a * basis[:, i] if a > 0 else 0
            right = (knots[i + d + 1] - x) / b * basis[:, i + 1] if b > 0 else 0
            new[:, i] = left + right
        basis = new
    return basis[:, 1:n]


def check_fit(b: np.ndarray, y: np.ndarray, tau: float, iterations: int = 200, tol: float = 1e-7) -> np.ndarray:
    """Coefficients that minimise the check loss, by majorised least squares with a shrinking guard."""
    coef, *_ = np.linalg.lstsq(b, y, rcond=None)
    scale = max(float(np.std(y)), 1e-9)
    eps = 0.1 * scale
    for _ in range(iterations):
        r = y - b @ coef
        w = 1.0 / (eps + np.abs(r))
        lhs = (b * w[:, None]).T @ b
        rhs = b.T @ (w * y + (2 * tau - 1))
        lhs[np.diag_indices_from(lhs)] *= 1 + 1e-12
        try:
            new = np.linalg.solve(lhs, rhs)
        except np.linalg.LinAlgError:
            new = np.linalg.lstsq(lhs, rhs, rcond=None)[0]
        moved = np.max(np.abs(b @ (new - coef)))
        coef = new
        if moved < tol * scale and eps <= 1e-6 * scale:
            break
        eps = max(eps * 0.8, 1e-6 * scale)
    return coef


def quantile_envelope(
    df: DataFrame, keys: Sequence[str], day: str, y: str, tau: float = 0.95, df_spline: int = 10, out: str = "fitted"
) -> DataFrame:
    """Fitted ``tau`` quantile of ``y`` over days, per key, as a spline of ``df_spline`` columns.

    The values of a key and day are averaged first, so a group has one row per day of the series
    and fits one task however many readings there were.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(day).isNotNull()).groupBy(*keys, day).agg(F.avg(y).alias(y))
    rows = rows.withColumn("__t", F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, v = pdf["__t"].to_numpy(float), pdf[y].to_numpy(float)
        columns = min(df_spline, max(len(x) - 1, 0))
        if columns >= 4 and x.max() > x.min():
            b = np.c_[np.ones(len(x)), bspline_basis(x, columns)]
            pdf[out] = b @ check_fit(b, v, tau)
        else:
            pdf[out] = np.quantile(v, tau)
        return pdf.drop(columns="__t")

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in rows.columns if c != "__t") + f", `{out}` double"
    return rows.groupBy(*keys).applyInPandas(fit, schema)
