"""Summaries of posterior draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ratio
from ..operators.joins import r_join
from ..operators.ordered import GROUP_LIMIT
from ..operators.quantiles import quantiles


def r_hat(draws: DataFrame, by: Sequence[str] = ("param",), chain: str = "chain", value: str = "value") -> DataFrame:
    """Potential scale reduction from the means and variances of the chains."""
    chains = draws.groupBy(*by, chain).agg(F.avg(value).alias("__m"), F.var_samp(value).alias("__v"), F.count(value).cast("double").alias("__n"))
    n = F.avg("__n")
    within, between = F.avg("__v"), F.var_samp("__m")
    pooled = (n - 1) / n * within + between
    return chains.groupBy(*by).agg(F.sqrt(ratio(pooled, within)).alias("rhat"))


def summarise_draws(draws: DataFrame, by: Sequence[str] = ("param",), chain: str = "chain", value: str = "value", limit: int = GROUP_LIMIT) -> DataFrame:
    """Mean, sd, five quantiles and R-hat per parameter."""
    base = draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    q = quantiles(draws, by, value, [0.025, 0.25, 0.5, 0.75, 0.975], ["q2_5", "q25", "q50", "q75", "q97_5"], limit=limit)
    out = r_join(base, q, list(by), "left")
    return r_join(out, r_hat(draws, by, chain, value), list(by), "left")


def rank_residuals(sims: DataFrame, observed: DataFrame, by: Sequence[str] = ("obs_id",), sim: str = "y_sim", y: str = "y") -> DataFrame:
    """Rank of each observation among its simulated values, 0 to 1, ties counted half.

    ``observed`` has one row per observation. ``zero_share`` is the share of simulated zeros, to be
    compared with the observed zeros.
    """
    joined = r_join(sims, observed, list(by), "inner")
    below = (F.col(sim) < F.col(y)).cast("double") + 0.5 * (F.col(sim) == F.col(y)).cast("double")
    return joined.groupBy(*by).agg(
        F.avg(below).alias("rank_resid"),
        F.avg((F.col(sim) == 0).cast("double")).alias("zero_share"),
        F.max((F.col(y) == 0).cast("int")).alias("observed_zero"),
    )
