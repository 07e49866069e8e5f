"""Bootstrap intervals, kernel densities and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import attach, attach_row
from .joins import r_join
from .quantiles import quantiles

# Cumulative Poisson(1) probabilities in 16-bit steps; beyond the last one the weight is 7.
_POISSON1 = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(7)]
# Replicates drawn from one 64-bit hash.
_PER_HASH = 4


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform 16-bit number."""
    out = F.lit(7)
    for k in range(len(_POISSON1) - 1, -1, -1):
        out = F.when(u < _POISSON1[k], k).otherwise(out)
    return out


def mean_cl_boot(
    df: DataFrame, keys: Sequence[str], col: str, row_id: Sequence[str], replicates: int = 1000, seed: int = 1, level: float = 0.95
) -> DataFrame:
    """Mean and percentile bootstrap interval.

    Each row gets a Poisson weight per replicate from a hash of its id, so the draw is the same
    on every run and after a task is repeated. Replicates are summed on the map side: the shuffle
    carries one row per group and hash, with four replicates in it.
    """
    rows = df.select(*keys, F.col(col).cast("double").alias("__x"), F.xxhash64(*row_id).alias("__id")).filter(F.col("__x").isNotNull())
    hashes = -(-replicates // _PER_HASH)
    drawn = rows.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(hashes)))).withColumn("__h", F.xxhash64("__id", "__b", F.lit(seed)))
    weights = [poisson_weight(F.shiftrightunsigned("__h", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(_PER_HASH)]
    drawn = drawn.select(*keys, "__b", "__x", *[w.alias(f"w{i}") for i, w in enumerate(weights)])
    sums = drawn.groupBy(*keys, "__b").agg(
        *[F.try_divide(F.sum(F.col(f"w{i}") * F.col("__x")), F.sum(f"w{i}")).alias(f"m{i}") for i in range(_PER_HASH)]
    )
    number = lambda i: (F.col("__b") - 1) * _PER_HASH + i
    means = sums.select(*keys, F.inline(F.array(*[F.struct(number(i).alias("__r"), F.col(f"m{i}").alias("__m")) for i in range(_PER_HASH)])))
    means = means.filter(F.col("__r") < replicates)
    tail = (1 - level) / 2
    bounds = means.groupBy(*keys).agg(F.percentile("__m", F.array(F.lit(tail), F.lit(1 - tail))).alias("__q"))
    bounds = bounds.select(*keys, F.col("__q")[0].alias("lower"), F.col("__q")[1].alias("upper"))
    base = rows.groupBy(*keys).agg(F.avg("__x").alias("mean"), F.count("__x").alias("n"))
    return r_join(base, bounds, list(keys), "left") if keys else attach_row(base, bounds)


def histogram(df: DataFrame, keys: Sequence[str], col: str, width: float, origin: float = 0.0) -> DataFrame:
    """Counts per bin of equal width, closed at the lower end."""
    bin_no = F.floor((F.col(col) - F.lit(origin)) / F.lit(width)).cast("long")
    out = df.filter(F.col(col).isNotNull()).groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("bin_start", F.lit(origin) + F.col("bin") * F.lit(width))


def kde(
    df: DataFrame, keys: Sequence[str], col: str, lo: float, hi: float, points: int = 64, bw: float | None = None
) -> DataFrame:
    """Gaussian kernel density on a fixed grid of ``points`` from ``lo`` to ``hi``.

    Values are first spread over the two neighbouring grid points (linear binning), which leaves
    at most ``points`` weights per group whatever the number of rows; only those meet the grid.
    Without ``bw`` each group uses ``0.9 · min(sd, IQR/1.34) · n^(-1/5)``.
    """
    step = (hi - lo) / (points - 1)
    rows = df.select(*keys, F.col(col).cast("double").alias("__x")).filter(F.col("__x").between(lo, hi))
    pos = (F.col("__x") - F.lit(lo)) / F.lit(step)
    low = F.least(F.floor(pos).cast("int"), F.lit(points - 2))
    up = pos - low
    pairs = F.array(F.struct(low.alias("i"), (1 - up).alias("w")), F.struct((low + 1).alias("i"), up.alias("w")))
    binned = rows.select(*keys, F.inline(pairs)).groupBy(*keys, "i").agg(F.sum("w").alias("w"))
    if bw is None:
        stats = rows.groupBy(*keys).agg(F.stddev_samp("__x").alias("sd"), F.count("__x").alias("n"))
        q = quantiles(rows, keys, "__x", [0.25, 0.75], ["a", "b"])
        stats = r_join(stats, q, list(keys), "left") if keys else attach_row(stats, q)
        spread = F.least("sd", F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / 1.34))
        stats = stats.select(*keys, (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
        binned = r_join(binned, stats, list(keys), "left") if keys else attach_row(binned, stats)
    else:
        binned = binned.withColumn("bw", F.lit(float(bw)))
    total = attach(binned, keys, total=F.sum("w"))
    on_grid = total.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("g") - F.col("i")) * F.lit(step) / F.col("bw")
    dens = F.sum(F.col("w") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))))
    return on_grid.groupBy(*keys, "g").agg(dens.alias("density")).withColumn("x", F.lit(lo) + F.col("g") * F.lit(step))
