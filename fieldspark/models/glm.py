"""Count and proportion regressions with fixed effects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .design import INTERCEPT, Term, design_columns


def glm(
    df: DataFrame,
    y: str,
    terms: Sequence[Term],
    family: str,
    factors: Mapping[str, Sequence[object]] | None = None,
    weight: str | None = None,
    max_iter: int = 50,
) -> DataFrame:
    """Fitted terms: estimate, standard error, statistic.

    ``family`` is ``poisson`` (log link), ``binomial`` (logit; ``y`` a proportion and ``weight`` its
    number of trials) or ``gaussian``. Site goes in as a fixed factor.
    """
    design = {n: c for n, c in design_columns(terms, factors, True).items() if n != INTERCEPT}
    extra = [F.col(weight).cast("double").alias("__w")] if weight else []
    rows = df.select(F.col(y).cast("double").alias("__y"), *extra, *[c.alias(f"__x{i}") for i, c in enumerate(design.values())]).dropna()
    # Every step of the fit and every figure of its summary reads the rows again: they are made once.
    rows = cut_lineage(rows)
    data = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(design))], outputCol="features").transform(rows)
    est = GeneralizedLinearRegression(family=family, labelCol="__y", featuresCol="features", maxIter=max_iter, tol=1e-10, regParam=0.0)
    if weight:
        est = est.setWeightCol("__w")
    model = est.fit(data)
    summary = model.summary
    names = [*design, INTERCEPT]
    est_values = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    errors, stats = summary.coefficientStandardErrors, summary.tValues
    rows_out = [
        (n, float(b), float(s), float(t), float(summary.deviance), float(summary.aic))
        for n, b, s, t in zip(names, est_values, errors, stats)
    ]
    return df.sparkSession.createDataFrame(
        rows_out, "term string, estimate double, std_error double, statistic double, deviance double, aic double"
    )


def fit_by(df: DataFrame, key: str, spec: Mapping[object, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A fit per level of ``key``, each with its own model, in one tagged table.

    ``spec`` maps a level to a function from its rows to a term table, for example one family per
    trait. The loop runs over models, not over rows, and the rows are made once for all of them.
    """
    df = cut_lineage(df.filter(F.col(key).isin(*spec)))
    out: DataFrame | None = None
    for level, fit in spec.items():
        part = fit(df.filter(F.col(key) == level)).withColumn(key, F.lit(level))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    return out
