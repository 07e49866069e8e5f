"""Least squares by orthogonal factors, for designs whose cross products lose the digits.

Sums of products square the condition of a design: with raw years and their squares nothing is left of a slope. Here
a task turns its rows of a group into a triangular factor, a few rows at a time, and factors of one group are merged by stacking and
factoring again, first in parts and then as a whole. A factor has as many rows as columns, whatever the number of rows
behind it, so that a group of any size is never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .design import Term, design_columns

#: Parts in which factors are merged first, and groups that a task holds factors of at a time.
PARTS, HELD = 32, 2048


def merged_factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of stacked rows or factors, square, with a diagonal that is not negative."""
    q = rows.shape[1]
    r = np.linalg.qr(np.vstack([rows, np.zeros((max(0, q - len(rows)), q))]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def solve_factor(r: np.ndarray, n: int) -> dict:
    """Estimates, standard errors and residuals from the factor of design and response. Columns are scaled first."""
    p = len(r) - 1
    x, y = r[:p, :p], r[:p, p]
    size = np.sqrt((x**2).sum(axis=0))
    size[size == 0] = 1.0
    u, s, vt = np.linalg.svd(x / size)
    keep = s > s.max(initial=0) * p * np.finfo(float).eps
    back = vt.T[:, keep] / s[keep]
    beta = back @ (u.T[keep] @ y) / size
    # A direction that the design does not have leaves its part of the response in the residuals.
    rss = float(r[p, p] ** 2 + ((u.T[~keep] @ y) ** 2).sum())
    dof = n - int(keep.sum())
    sigma2 = rss / dof if dof > 0 else np.nan
    return {"beta": beta, "se": np.sqrt((back**2).sum(axis=1) * sigma2) / size, "rss": rss, "dof": dof, "sigma2": sigma2}


def ols_qr(df: DataFrame, y: str, terms: Sequence[Term], factors: Mapping[str, Sequence[object]] | None = None, by: Sequence[str] = (), intercept: bool = True) -> DataFrame:
    """Least-squares fit per group, with the columns of :func:`~fieldspark.models.least_squares.ols`.

    Only complete rows count; a group without one has no rows. Columns that depend on others share their effect
    (least norm). The error of an estimate grows with the condition of the design, not with its square.
    """
    design = design_columns(terms, factors, intercept)
    names = list(design)
    q = len(names) + 1
    cols = [f"__x{i}" for i in range(q)]
    if {"n", "r", "part", *cols} & set(by):
        raise ValueError("a group column has the name of a working column")
    rows = df.select(*by, *[c.cast("double").alias(x) for x, c in zip(cols, [*design.values(), F.col(y)])]).dropna(subset=cols)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = "".join(f"`{k}` {types[k]}, " for k in by)
    schema = f"{head}part int, n long, r array<double>"

    def factored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() % PARTS
        held: dict[tuple, tuple[int, np.ndarray]] = {}

        def given() -> pd.DataFrame:
            out = pd.DataFrame([(*key, part, n, r.ravel()) for key, (n, r) in held.items()], columns=[*by, "part", "n", "r"])
            return out

        for pdf in batches:
            groups = pdf.groupby(list(by), dropna=False, sort=False) if by else [((), pdf)]
            for key, own in groups:
                # Missing keys are one group, and None is what they go back as.
                key = tuple(None if pd.isna(k) else k for k in key)
                n, r = held.get(key, (0, np.zeros((0, q))))
                held[key] = n + len(own), merged_factor(np.vstack([r, own[cols].to_numpy(float)]))
            if len(held) >= HELD:
                yield given()
                held.clear()
        if held:
            yield given()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        r = merged_factor(np.vstack([np.asarray(x).reshape(q, q) for x in pdf["r"]]))
        first = pdf.iloc[:1].copy()
        first["n"], first["r"] = pdf["n"].sum(), [r.ravel()]
        return first

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                s = solve_factor(np.asarray(row["r"]).reshape(q, q), row["n"])
                with np.errstate(divide="ignore", invalid="ignore"):
                    stat = np.where(s["se"] > 0, s["beta"] / s["se"], np.nan)
                out = pd.DataFrame({"term": names, "estimate": s["beta"], "std_error": s["se"], "statistic": stat})
                out["n"], out["df_residual"], out["sigma2"], out["rss"] = row["n"], s["dof"], s["sigma2"], s["rss"]
                for k in by:
                    out[k] = row[k]
                yield out[[*by, "term", "estimate", "std_error", "statistic", "n", "df_residual", "sigma2", "rss"]]

    parts = rows.mapInPandas(factored, schema).groupBy(*by, "part").applyInPandas(merged, schema)
    whole = parts.withColumn("part", F.lit(0)).groupBy(*by, "part").applyInPandas(merged, schema)
    return whole.mapInPandas(fitted, f"{head}term string, estimate double, std_error double, statistic double, n long, df_residual long, sigma2 double, rss double")
