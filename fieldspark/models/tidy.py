"""Term tables, criteria, fitted values and predictions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import r_join
from .design import Term, design_columns
from .mixed import MixedFit


def with_limits(terms: DataFrame, z: float = 1.96) -> DataFrame:
    """Lower and upper limits from the standard error."""
    half = F.col("std_error") * z
    return terms.withColumns({"lower": F.col("estimate") - half, "upper": F.col("estimate") + half})


def tidy(fit: MixedFit, like: DataFrame) -> DataFrame:
    """Fixed effects and group standard deviations of a mixed model."""
    se = np.sqrt(np.clip(np.diag(fit.cov), 0, None))
    rows = [(t, float(b), float(s), float(b / s) if s > 0 else None) for t, b, s in zip(fit.terms, fit.beta, se)]
    rows += [(f"sd_{g}", math.sqrt(v), None, None) for g, v in fit.group_variance.items()]
    rows.append(("sd_residual", math.sqrt(fit.sigma2), None, None))
    out = like.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, statistic double")
    return with_limits(out)


def glance(fit: MixedFit, like: DataFrame) -> DataFrame:
    """One row of criteria."""
    return like.sparkSession.createDataFrame(
        [(fit.n, fit.sigma2, fit.loglik, fit.aic, fit.bic)], "n long, sigma2 double, logLik double, AIC double, BIC double"
    )


def glance_ols(terms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Criteria of least-squares fits, from their term tables."""
    n, rss = F.col("n").cast("double"), F.col("rss")
    one = terms.groupBy(*by).agg(F.first("n").alias("n"), F.first("rss").alias("rss"), F.first("sigma2").alias("sigma2"), F.count(F.lit(1)).alias("__p"))
    loglik = -0.5 * n * (F.ln(2 * math.pi * rss / n) + 1)
    out = one.withColumn("logLik", loglik)
    k = F.col("__p") + 1
    return out.withColumns({"AIC": -2 * F.col("logLik") + 2 * k, "BIC": -2 * F.col("logLik") + F.ln(n) * k}).drop("__p")


def linear_predictor(
    estimates: Mapping[str, float], terms: Sequence[Term], factors: Mapping[str, Sequence[object]] | None = None, intercept: bool = True
) -> Column:
    """Prediction of a fit as a column expression."""
    out = F.lit(0.0)
    for name, col in design_columns(terms, factors, intercept).items():
        out = out + F.lit(float(estimates[name])) * col
    return out


def standard_error_of_fit(
    fit: MixedFit,
) -> Column:
    """Standard error of the fixed-effect prediction, ``sqrt(x'Vx)``."""
    terms, factors, intercept, _ = fit.design_args
    cols = list(design_columns(terms, factors, intercept).values())
    total = F.lit(0.0)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            total = total + F.lit(float(fit.cov[i, j])) * a * b
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def predict(fit: MixedFit, new: DataFrame, out: str = "fitted", group_effects: bool = False, default: float = 0.0) -> DataFrame:
    """Predictions on new data, with or without group effects; unknown groups have effect 0.

    Standardise the new data with the centres and scales of the training data first.
    """
    terms, factors, intercept, groups = fit.design_args
    value = linear_predictor(dict(zip(fit.terms, fit.beta)), terms, factors, intercept)
    if not group_effects:
        return new.withColumn(out, value)
    effects = fit.effects.select(*groups, F.col("effect").alias("__effect"))
    joined = r_join(new, effects, list(groups), "left")
    return joined.withColumn(out, value + F.coalesce("__effect", F.lit(default))).drop("__effect")


def augment(fit: MixedFit, df: DataFrame, y: str) -> DataFrame:
    """Fitted values and residuals beside the data."""
    out = predict(fit, df, "fitted", group_effects=True)
    return out.withColumn("resid", F.col(y) - F.col("fitted"))


def coefficients(terms: DataFrame) -> dict[str, float]:
    """Estimates of one fit by name (one row per term)."""
    return {r["term"]: r["estimate"] for r in terms.select("term", "estimate").collect()}


def scenarios(df: DataFrame, changes: Mapping[str, Mapping[str, tuple[float, float]]]) -> DataFrame:
    """Every row under every scenario.

    ``changes`` maps a scenario to (factor, offset) per column; the few scenarios are exploded on
    each row, so nothing is shuffled.
    """
    cols = sorted({c for ch in changes.values() for c in ch})
    versions = [
        F.struct(
            F.lit(name).alias("scenario"),
            *[(F.col(c) * F.lit(float(ch.get(c, (1.0, 0.0))[0])) + F.lit(float(ch.get(c, (1.0, 0.0))[1]))).alias(c) for c in cols],
        )
        for name, ch in changes.items()
    ]
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(*versions)))


# Climate scenarios as (factor, offset) of precipitation, temperature and sunniness.
CLIMATE_SCENARIOS = {
    "current": {},
    "P85": {"precip": (1.17, 0.0)},
    "t85": {"temp": (1.0, 3.9)},
    "sun": {"sunniness": (0.9, 0.0)},
    "tP85": {"precip": (1.17, 0.0), "temp": (1.0, 3.9)},
    "tPsun85": {"precip": (1.17, 0.0), "temp": (1.0, 3.9), "sunniness": (0.9, 0.0)},
}
