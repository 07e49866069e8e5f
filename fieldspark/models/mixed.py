"""Gaussian random-intercept models on aggregates.

The likelihood only needs cross products over all rows, and sums per lowest group. The group table
stays distributed. A whole lattice of variance ratios is evaluated in one Spark job, which returns
one small row per lattice point; the lattice then closes in on the best point.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import r_join
from ..session import cut_lineage
from .design import Term, design_columns
from .least_squares import moments, unpack


@dataclass
class MixedFit:
    """Fixed effects, variance components and criteria of a fitted model."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    group_variance: dict[str, float]
    loglik: float
    n: int
    reml: bool
    design_args: tuple = field(repr=False, default=())
    effects: DataFrame | None = field(repr=False, default=None)

    @property
    def n_params(self) -> int:
        return len(self.terms) + len(self.group_variance) + 1

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_params

    @property
    def bic(self) -> float:
        return -2 * self.loglik + math.log(self.n) * self.n_params


def _group_sums(df: DataFrame, design: Mapping, y: str, groups: Sequence[str]) -> DataFrame:
    cols = [c.alias(f"__x{i}") for i, c in enumerate(design.values())] + [F.col(y).cast("double").alias("__y")]
    names = [f"__x{i}" for i in range(len(design))] + ["__y"]
    rows = df.select(*groups, *cols).dropna(subset=names)
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)])


def _lattice_terms(sums: DataFrame, top: str, nested: bool, size: int, points: list[tuple[float, float]]) -> list:
    """Log-determinant and cross-product corrections per lattice point.

    ``points`` are (outer ratio, inner ratio); the inner one is 0 without nesting.
    """
    # Expressions go over as text: one call each instead of one per operator.
    lattice = ", ".join(f"named_struct('i', {i}, 'a', {a!r}D, 'b', {b!r}D)" for i, (a, b) in enumerate(points))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    rows = sums.selectExpr("*", f"inline(array({lattice}))").withColumn("k", F.expr("1 / (1 + b * n)"))
    inner = ["sum(ln(1 + b * n)) AS ld", "sum(n * k) AS m", *[f"sum(k * s{i}) AS u{i}" for i in range(size)]]
    if nested:
        inner += [f"sum(b * k * s{i} * s{j}) AS c{i}_{j}" for i, j in pairs]
    tops = rows.groupBy("i", "a", top).agg(*[F.expr(e) for e in inner]).withColumn("w", F.expr("a / (1 + a * m)"))
    corr = ", ".join(f"sum(w * u{i} * u{j}" + (f" + c{i}_{j})" if nested else ")") for i, j in pairs)
    return tops.groupBy("i").agg(F.expr("sum(ld + ln(1 + a * m)) AS ld"), F.expr(f"array({corr}) AS c")).collect()


def lmm(
    df: DataFrame,
    y: str,
    terms: Sequence[Term],
    groups: Sequence[str],
    factors: Mapping[str, Sequence[object]] | None = None,
    reml: bool = False,
    intercept: bool = True,
    rounds: int = 7,
    width: int = 9,
) -> MixedFit:
    """Random-intercept model with one group level or two nested ones (outer first)."""
    if len(groups) not in (1, 2):
        raise ValueError("one or two group levels")
    design = design_columns(terms, factors, intercept)
    names = list(design)
    p = len(names)
    df = df.filter(F.col(y).isNotNull())
    total = moments(df, design, F.col(y).cast("double")).first()
    n = int(total["n"])
    z = unpack(total["m"], p + 1)
    nested = len(groups) == 2
    sums = cut_lineage(_group_sums(df, design, y, list(groups)))
    seen: dict[tuple[float, float], tuple] = {}

    def evaluate(points: list[tuple[float, float]]) -> None:
        todo = [q for q in points if q not in seen]
        if not todo:
            return
        for row in _lattice_terms(sums, groups[0], nested, p + 1, todo):
            a = z - unpack(row["c"], p + 1)
            d = np.sqrt(np.clip(np.diag(a[:p, :p]), 1e-300, None))
            sc = a[:p, :p] / np.outer(d, d)
            inv = np.linalg.pinv(sc, hermitian=True) / np.outer(d, d)
            beta = inv @ a[:p, p]
            rss = max(float(a[p, p] - beta @ a[:p, p]), 1e-300)
            dof = n - p if reml else n
            dev = row["ld"] + dof * (math.log(2 * math.pi * rss / dof) + 1)
            if reml:
                dev += np.linalg.slogdet(sc)[1] + 2 * np.log(d).sum()
            seen[todo[row["i"]]] = (dev, beta, inv, rss / dof)

    # Zoom on the log scale; ratio 0 (no group variance) is always among the points.
    centre, span = [0.0, 0.0], 7.0
    best = (0.0, 0.0)
    for _ in range(rounds):
        offsets = [span * (2 * i / (width - 1) - 1) for i in range(width)]
        outer = [0.0, *[math.exp(centre[0] + o) for o in offsets]]
        inner = [0.0, *[math.exp(centre[1] + o) for o in offsets]] if nested else [0.0]
        evaluate([(a, b) for a in outer for b in inner])
        best = min(seen, key=lambda q: seen[q][0])
        centre = [math.log(v) if v > 0 else c for v, c in zip(best, centre)]
        span *= 0.3
    dev, beta, inv, sigma2 = seen[best]
    names_g = [groups[0]] if not nested else [groups[0], f"{groups[1]}:{groups[0]}"]
    variances = {g: float(sigma2 * t) for g, t in zip(names_g, best)}
    effects = _group_effects(sums, list(groups), beta, best, p)
    return MixedFit(names, beta, sigma2 * inv, float(sigma2), variances, float(-dev / 2), n, reml, (terms, factors, intercept, list(groups)), effects)


def _group_effects(sums: DataFrame, groups: list[str], beta: np.ndarray, theta: tuple[float, float], p: int) -> DataFrame:
    """Predicted group effects, one row per lowest group."""
    resid = F.expr(f"s{p}" + "".join(f" - ({float(b)!r}D) * s{i}" for i, b in enumerate(beta)))
    a, b = theta
    k = 1 / (1 + F.lit(b) * F.col("n"))
    rows = sums.select(*groups, "n", resid.alias("__r"))
    per_top = rows.groupBy(groups[0]).agg(
        (F.lit(a) * F.sum(k * F.col("__r")) / (1 + F.lit(a) * F.sum(F.col("n") * k))).alias("outer_effect")
    )
    out = r_join(rows, per_top, [groups[0]], "left")
    inner = F.lit(b) * k * (F.col("__r") - F.col("n") * F.col("outer_effect")) if len(groups) == 2 else F.lit(0.0)
    return out.select(*groups, "outer_effect", inner.alias("inner_effect")).withColumn(
        "effect", F.col("outer_effect") + F.col("inner_effect")
    )


def lmm_by(df: DataFrame, by: str, levels: Sequence[object], **spec) -> dict[object, MixedFit]:
    """One fit per listed level of ``by`` (trait or weather class)."""
    return {v: lmm(df.filter(F.col(by) == v), **spec) for v in levels}
