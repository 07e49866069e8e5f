"""Count, proportion and Gaussian regressions of all groups and families at once.

Rows of one group and one design are added up first: trials, responses and the part of the deviance that no
coefficient changes are all that the fits need of them. The fits are iteratively reweighted least squares
whose state is a small table, one row per group. A step is one aggregation of cross products for all groups that
have not settled, joined with their coefficients, and one small system per group solved on the executors. So the number of
jobs is that of the steps, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import attach_row
from ..operators.joins import r_join
from ..session import cut_lineage
from .design import Term, design_columns
from .least_squares import unpack

FAMILIES = ("gaussian", "poisson", "binomial")
#: Columns of a step's sums.
STEP = ("__now", "__large", "__m", "__g")
#: A step that makes the deviance larger by more than this share is halved.
WORSE = 1e-9


def _patterns(df: DataFrame, by: Sequence[str], y: str, design: Mapping[str, Column], family: Column, weight: str | None) -> DataFrame:
    """Rows added up by group and design: ``x0..``, ``family``, ``n`` rows, ``w`` weights, ``wy``, and ``fixed``.

    ``fixed`` is the saturated part of the deviance: sum w y log y (counts), sum w (y log y + (1 - y) log(1 - y))
    (proportions), sum w y^2 (Gaussian).
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    names = [f"x{i}" for i in range(len(design))]
    rows = df.select(*by, family.alias("family"), F.col(y).cast("double").alias("y"), w.alias("w"), *[c.cast("double").alias(n) for n, c in zip(names, design.values())])
    rows = rows.dropna(subset=["family", "y", "w", *names]).filter("w > 0")
    known = F.col("family").isin(*FAMILIES)
    fits = F.when(F.col("family") == "poisson", F.col("y") >= 0).when(F.col("family") == "binomial", F.col("y").between(0, 1)).otherwise(True)
    rows = rows.filter(F.when(known & fits, True).otherwise(F.raise_error(F.concat(F.lit("no response of its family: "), "family", F.lit(" "), F.col("y").cast("string"))).cast("boolean")))
    log = "CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0D END"
    fixed = F.expr(f"CASE family WHEN 'gaussian' THEN y * y WHEN 'poisson' THEN {log.format('y')} ELSE {log.format('y')} + {log.format('(1 - y)')} END")
    return rows.groupBy(*by, "family", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * fixed).alias("fixed"))


def _step_sums(rows: DataFrame, by: Sequence[str], p: int) -> DataFrame:
    """Per group at its coefficients: deviance, the triangle of X'WX, and the score X'(y - mu)."""
    eta = " + ".join(f"beta[{i}] * x{i}" for i in range(p))
    at = rows.withColumn("eta", F.expr(eta))
    # Beyond these the means are 0, 1 or out of range in doubles anyway.
    at = at.withColumn("eta", F.expr("CASE family WHEN 'gaussian' THEN eta WHEN 'poisson' THEN least(greatest(eta, -700D), 700D) ELSE least(greatest(eta, -36D), 36D) END"))
    at = at.withColumn("mu", F.expr("CASE family WHEN 'gaussian' THEN eta WHEN 'poisson' THEN exp(eta) ELSE 1 / (1 + exp(-eta)) END"))
    # Canonical links: the working weight is the variance, and the deviance needs sums of y only.
    at = at.withColumns(
        {
            "v": F.expr("w * CASE family WHEN 'gaussian' THEN 1D WHEN 'poisson' THEN mu ELSE mu * (1 - mu) END"),
            "r": F.expr("wy - w * mu"),
            "d": F.expr("CASE family WHEN 'gaussian' THEN fixed - 2 * wy * mu + w * mu * mu WHEN 'poisson' THEN 2 * (fixed - wy * eta - wy + w * mu) ELSE 2 * (fixed - wy * eta + w * greatest(eta, 0D) + w * ln(1 + exp(-abs(eta)))) END"),
        }
    )
    triangle = ", ".join(f"sum(v * x{i} * x{j})" for i in range(p) for j in range(i, p))
    score = ", ".join(f"sum(r * x{i})" for i in range(p))
    # What the deviance is the difference of, for its rounding.
    large = F.expr("abs(fixed) + abs(wy * eta) + abs(w * mu)")
    return at.groupBy(*by).agg(F.sum("d").alias("__now"), F.sum(large).alias("__large"), F.expr(f"array({triangle})").alias("__m"), F.expr(f"array({score})").alias("__g"))


def glm_by(
    df: DataFrame,
    by: Sequence[str],
    y: str,
    terms: Sequence[Term],
    family: str | Column,
    factors: Mapping[str, Sequence[object]] | None = None,
    weight: str | None = None,
    max_steps: int = 25,
    tolerance: float = 1e-12,
) -> DataFrame:
    """A regression per group: ``*by, term, estimate, std_error, statistic, n, df_residual, deviance, family, steps, settled``.

    ``family``: ``gaussian`` (identity), ``poisson`` (log) or ``binomial`` (logit; ``y`` a proportion and ``weight`` its
    trials), one for all, or a column that is constant within a group, as each trait has its own. Only complete
    rows with a positive weight count. A response outside its family's range is an error, an unknown family too. Columns that
    depend on others share their effect (least norm). A group whose steps have not settled after ``max_steps``
    says so. The Gaussian's variance is estimated; that of the others is 1.
    """
    design = design_columns(terms, factors, True)
    names, p = list(design), len(design)
    if set(by) & {"family", "y", "w", "n", "wy", "fixed", "eta", "mu", "v", "r", "d", "beta", "before", "deviance", "cov", "rank", "steps", "settled", *[f"x{i}" for i in range(p)]}:
        raise ValueError("a group column has the name of a working column")
    kind = family if isinstance(family, Column) else F.lit(family)
    rows = cut_lineage(_patterns(df, by, y, design, kind, weight))
    first = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min("family").alias("family"), F.max("family").alias("other"), F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    several = F.raise_error(F.lit("a group has several families")).cast("string")
    first = first.withColumn("family", F.when(F.col("family") == F.col("other"), F.col("family")).otherwise(several))
    # The mean everywhere: the intercept is its link, half a response away from the ends.
    mean = "(wy + 0.5D) / (w + 1)"
    start = F.expr(f"CASE family WHEN 'gaussian' THEN 0D WHEN 'poisson' THEN ln({mean}) ELSE ln({mean} / (1 - {mean})) END")
    intercept = F.array(start, *[F.lit(0.0)] * (p - 1))
    state = first.select(*by, "n", "family", intercept.alias("beta"), F.lit(None).cast("array<double>").alias("before"), F.lit(None).cast("double").alias("deviance"), F.lit(None).cast("array<double>").alias("cov"), F.lit(0).alias("rank"), F.lit(0).alias("steps"), F.lit(False).alias("settled"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    rows = rows.drop("n", "family")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_next(r, p, tolerance) for r in pdf.to_dict("records")], columns=[c for c in pdf.columns if c not in STEP])

    done: list[DataFrame] = []
    state = cut_lineage(state)
    for _ in range(max_steps + 1):
        sums = _step_sums(_with(rows, state.select(*by, "family", "beta"), by), by, p)
        state = cut_lineage(_with(state, sums, by).select(*state.columns, *STEP).mapInPandas(solve, fields))
        done.append(state.filter("settled"))
        state = state.filter("NOT settled")
        if state.isEmpty():
            break
    fits = done[0]
    for part in [*done[1:], state]:
        fits = fits.unionAll(part)
    return _term_rows(fits, by, names)


def _with(df: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the one row of their group."""
    return r_join(df, one, list(by), "inner") if by else attach_row(df, one)


def _next(r: dict, p: int, tolerance: float) -> dict:
    """The state after a step: settled, a full step from a better point, or half of one that went too far."""
    out = {k: v for k, v in r.items() if k not in STEP}
    beta, now, before = np.asarray(r["beta"], float), float(r["__now"]), r["deviance"]
    out["steps"] = r["steps"] + 1
    m, g = unpack(r["__m"], p), np.asarray(r["__g"], float)
    finite = bool(np.isfinite(now) and np.isfinite(m).all() and np.isfinite(g).all())
    if finite:
        size = np.sqrt(np.clip(np.diag(m), 0, None))
        size[size == 0] = 1.0
        scaled = m / np.outer(size, size)
        inv = np.linalg.pinv(scaled, hermitian=True) / np.outer(size, size)
        step = inv @ g
    known = before is not None and np.isfinite(before)
    # What the step can still gain, g' inv g, is about twice the deviance left to lose.
    settled = finite and abs(float(g @ step)) <= tolerance * (abs(now) + 0.1) or finite and known and r["family"] == "gaussian"
    if not settled and known and not (finite and now <= before + WORSE * (abs(before) + 0.1) + 1e-13 * r["__large"]):
        out["beta"] = (beta + np.asarray(r["before"], float)) / 2
        return out
    if not finite:
        raise ArithmeticError("the first step of a fit has no finite sums")
    out["deviance"], out["cov"], out["before"], out["settled"] = now, inv.ravel(), beta, settled
    out["rank"] = int(np.linalg.matrix_rank(scaled, hermitian=True))
    # The last step is taken too: it is small, and what is left after it is smaller by its square.
    out["beta"] = beta + step
    return out


def _term_rows(fits: DataFrame, by: Sequence[str], names: list[str]) -> DataFrame:
    p = len(names)
    rows = fits.withColumn("df_residual", F.col("n") - F.col("rank")).withColumn("scale", F.when(F.col("family") == "gaussian", F.when(F.col("df_residual") > 0, F.col("deviance") / F.col("df_residual"))).otherwise(F.lit(1.0)))
    each = rows.select(*by, "n", "df_residual", "deviance", "family", "steps", "settled", "cov", "scale", F.posexplode("beta").alias("i", "estimate"))
    error = F.sqrt(F.greatest(F.get("cov", F.col("i") * (p + 1)), F.lit(0.0)) * F.col("scale"))
    term = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    out = each.select(*by, term.alias("term"), "estimate", error.alias("std_error"), "n", "df_residual", "deviance", "family", "steps", "settled")
    return out.select(*by, "term", "estimate", "std_error", F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error")).alias("statistic"), "n", "df_residual", "deviance", "family", "steps", "settled")
