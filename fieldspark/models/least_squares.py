"""Least squares from grouped moments.

The scan adds up cross products; what is solved afterwards is one small system per group, on the
executors, one row per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ratio
from ..operators.grouping import attach_row
from ..operators.joins import r_join
from .design import Term, design_columns


def moments(
    df: DataFrame, x: Mapping[str, Column], y: Column, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Cross products of the design and the response per group, over complete rows.

    Columns: ``n``, ``sw``, ``m`` — the upper triangle of ``[X y]'W[X y]``, row by row.
    """
    names = [f"__x{i}" for i in range(len(x))] + ["__y"]
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*by, *[c.alias(n) for n, c in zip(names, [*x.values(), y])], w.alias("__w")).dropna(subset=[*names, "__w"])
    # One text expression for the triangle instead of a call per product.
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    triangle = ", ".join(f"sum(__w * {a} * {b})" for a, b in pairs)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("__w").alias("sw"), F.expr(f"array({triangle})").alias("m")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def unpack(tri: Sequence[float], size: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = tri
    return out + np.triu(out, 1).T


def solve(tri: Sequence[float], p: int, n: int) -> dict[str, np.ndarray | float]:
    """Estimates, covariance and residual sum of squares from packed moments."""
    z = unpack(tri, p + 1)
    xtx, xty, yty = z[:p, :p], z[:p, p], z[p, p]
    size = np.sqrt(np.diag(xtx))
    size[size == 0] = 1.0
    scaled = xtx / np.outer(size, size)
    inv = np.linalg.pinv(scaled, hermitian=True)
    rank = int(np.linalg.matrix_rank(scaled, hermitian=True))
    beta = (inv @ (xty / size)) / size
    rss = max(float(yty - beta @ xty), 0.0)
    dof = n - rank
    sigma2 = rss / dof if dof > 0 else np.nan
    return {"beta": beta, "cov": sigma2 * inv / np.outer(size, size), "rss": rss, "dof": dof, "sigma2": sigma2}


def ols(
    df: DataFrame,
    y: str,
    terms: Sequence[Term],
    factors: Mapping[str, Sequence[object]] | None = None,
    by: Sequence[str] = (),
    intercept: bool = True,
    weight: Column | None = None,
) -> DataFrame:
    """Least-squares fit per group: one row per term with estimate, standard error and statistic."""
    design = design_columns(terms, factors, intercept)
    names = list(design)
    p = len(names)
    grouped = moments(df, design, F.col(y).cast("double"), by, weight)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row in pdf.to_dict("records"):
                if row["n"] == 0 or row["m"] is None:
                    continue
                s = solve(row["m"], p, row["n"])
                se = np.sqrt(np.clip(np.diag(s["cov"]), 0, None))
                with np.errstate(divide="ignore", invalid="ignore"):
                    stat = np.where(se > 0, s["beta"] / se, np.nan)
                part = pd.DataFrame({"term": names, "estimate": s["beta"], "std_error": se, "statistic": stat})
                part["n"], part["df_residual"], part["sigma2"], part["rss"] = row["n"], s["dof"], s["sigma2"], s["rss"]
                for k in by:
                    part[k] = row[k]
                parts.append(part[[*by, "term", "estimate", "std_error", "statistic", "n", "df_residual", "sigma2", "rss"]])
            if parts:
                yield pd.concat(parts)

    types = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}
    head = ", ".join(f"`{k}` {types[k]}" for k in by)
    tail = "term string, estimate double, std_error double, statistic double, n long, df_residual long, sigma2 double, rss double"
    return grouped.mapInPandas(fit, f"{head}, {tail}" if head else tail)


def trend(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Straight line per group: slope, intercept and share of variance explained."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n")
    )


def poly_trend(df: DataFrame, keys: Sequence[str], y: str, x: str, degree: int = 2) -> DataFrame:
    """Polynomial trend per group in powers of ``x`` minus its group mean.

    The fitted curve equals that of orthogonal polynomials. The centre is returned as the term
    ``center``.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.filter(both).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    centres = rows.groupBy(*keys).agg(F.avg("__x").alias("__c")) if keys else rows.agg(F.avg("__x").alias("__c"))
    joined = r_join(rows, centres, list(keys), "left") if keys else attach_row(rows, centres)
    d = F.col("__x") - F.col("__c")
    powers = joined.withColumns({f"x{k}": F.pow(d, F.lit(float(k))) for k in range(1, degree + 1)})
    fit = ols(powers.withColumnRenamed("__y", y), y, [f"x{k}" for k in range(1, degree + 1)], by=keys)
    fit = fit.select(*keys, "term", "estimate", "std_error")
    centre = centres.select(*keys, F.lit("center").alias("term"), F.col("__c").alias("estimate"), F.lit(None).cast("double").alias("std_error"))
    return fit.unionByName(centre)


def r_squared(fit_rss: Column, total: Column) -> Column:
    return 1 - ratio(fit_rss, total)
