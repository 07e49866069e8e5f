"""Principal components, redundancy analysis and principal response curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import r_join
from ..session import cut_lineage
from .design import Term, design_columns
from .least_squares import unpack


def pca(df: DataFrame, row: str, key: str, value: str, levels: Sequence[object], k: int = 4) -> tuple[DataFrame, DataFrame]:
    """Scores of the first ``k`` axes of standardised variables, and the loadings.

    ``df`` is long; repeated values of a row and variable are averaged. Rows with a missing
    variable are left out. An axis points to where its largest loading is positive.
    """
    names = [str(v) for v in levels]
    cells = df.groupBy(row, key).agg(F.avg(value).alias("__v")).filter(F.col("__v").isNotNull())
    # One centre and scale per variable; the listed variables bound this table and each row's array.
    stats = cells.groupBy(key).agg(F.avg("__v").alias("__m"), F.stddev_samp("__v").alias("__s"))
    scaled = r_join(cells, stats, [key], "inner").withColumn(
        "__z", F.coalesce(F.try_divide(F.col("__v") - F.col("__m"), F.col("__s")), F.lit(0.0))
    )
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(key))
    rows = (
        scaled.withColumn("__i", place)
        .filter(F.col("__i") > 0)
        .groupBy(row)
        .agg(F.sort_array(F.collect_list(F.struct("__i", "__z"))).alias("__p"))
        .filter(F.size("__p") == len(names))
    )
    data = cut_lineage(rows.select(row, array_to_vector(F.col("__p.__z")).alias("__f")))
    model = PCA(k=k, inputCol="__f", outputCol="__pc").fit(data)
    load = model.pc.toArray()
    signs = np.sign(load[np.abs(load).argmax(axis=0), range(k)])
    axes = vector_to_array("__pc")
    scores = model.transform(data).select(row, *[(axes[i] * F.lit(float(signs[i]))).alias(f"PC{i + 1}") for i in range(k)])
    explained = model.explainedVariance.toArray()
    rows = [(n, f"PC{i + 1}", float(load[j, i] * signs[i]), float(explained[i])) for i in range(k) for j, n in enumerate(names)]
    loadings = df.sparkSession.createDataFrame(rows, "variable string, axis string, loading double, explained double")
    return scores, loadings


def rda(
    y_long: DataFrame,
    x: DataFrame,
    row: str,
    key: str,
    value: str,
    terms: Sequence[Term],
    factors: Mapping[str, Sequence[object]] | None = None,
    condition: Sequence[str] = (),
    k: int = 2,
    root: bool = False,
) -> dict[str, DataFrame]:
    """Redundancy analysis of a long species table on constraints.

    ``x`` has one row per sample; ``y_long`` lists values above zero, absent species count as 0.
    ``condition`` names terms that are partialled out. The jobs return cross products of the design
    (p × p); the species stay in a distributed table, one row each.

    Returns ``scores`` (samples), ``species`` (loadings) and ``axes`` (eigenvalue and shares).
    """
    design = design_columns(terms, factors, False)
    names = list(design)
    own = [i for i, n in enumerate(names) if n not in condition and not any(n.startswith(f"{c}_") for c in condition)]
    cond = [i for i in range(len(names)) if i not in own]
    p = len(names)
    cols = [f"__x{i}" for i in range(p)]
    base = cut_lineage(x.select(row, *[c.alias(n) for c, n in zip(design.values(), cols)]).dropna())
    # Repeated products go over as text: one call each instead of one per operator.
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    array_of = lambda parts: F.expr("array(" + ", ".join(parts) + ")")
    head = base.agg(
        F.count(F.lit(1)).alias("n"),
        array_of([f"sum({c})" for c in cols]).alias("s"),
        array_of([f"sum({cols[i]} * {cols[j]})" for i, j in pairs]).alias("m"),
    ).first()
    n = int(head["n"])
    mean = np.array(head["s"]) / n
    xtx = unpack(head["m"], p) - n * np.outer(mean, mean)

    val = F.sqrt(F.col(value)) if root else F.col(value).cast("double")
    cells = y_long.groupBy(row, key).agg(F.sum(val).alias("__v"))
    joined = r_join(cells, base, [row], "inner")
    # Centred cross products per species: sum(xy) - mean(x) * sum(y).
    per_species = joined.groupBy(key).agg(
        F.sum("__v").alias("sy"),
        F.sum(F.col("__v") * F.col("__v")).alias("syy"),
        *[F.expr(f"sum(({c} - ({float(mean[i])!r}D)) * __v)").alias(f"xy{i}") for i, c in enumerate(cols)],
    )
    per_species = cut_lineage(per_species)
    ss = F.col("syy") - F.col("sy") * F.col("sy") / F.lit(float(n))
    tot = per_species.agg(F.sum(ss).alias("ss"), array_of([f"sum(xy{i} * xy{j})" for i, j in pairs]).alias("m")).first()

    # Constraints freed from the conditioning terms: w = x_own - B' x_cond.
    if cond:
        b = np.linalg.pinv(xtx[np.ix_(cond, cond)], hermitian=True) @ xtx[np.ix_(cond, own)]
        t = np.zeros((p, len(own)))
        t[own, range(len(own))] = 1.0
        t[np.ix_(cond, range(len(own)))] = -b
    else:
        t = np.eye(p)
    wtw = t.T @ xtx @ t
    vals, vecs = np.linalg.eigh(wtw)
    good = vals > max(vals.max(), 0) * 1e-10
    half = t @ (vecs[:, good] / np.sqrt(vals[good]))  # maps x to orthonormal constraints
    q = half.shape[1]

    def combine(weights: np.ndarray, source: Sequence[str]) -> Column:
        return F.expr(" + ".join(f"({float(w)!r}D) * ({c})" for w, c in zip(weights, source)))

    eig, u = np.linalg.eigh(half.T @ unpack(tot["m"], p) @ half)
    order = np.argsort(eig)[::-1]
    eig, u = np.clip(eig[order], 0, None), u[:, order]
    k = min(k, q)
    u = u[:, :k] * np.sign(u[np.abs(u[:, :k]).argmax(axis=0), range(k)])
    to_axis = half @ u

    centred = [f"{c} - ({float(mean[i])!r}D)" for i, c in enumerate(cols)]
    scores = base.select(row, *[combine(to_axis[:, a], centred).alias(f"RDA{a + 1}") for a in range(k)])
    xy = [f"xy{i}" for i in range(p)]
    species = per_species.select(key, *[combine(to_axis[:, a], xy).alias(f"RDA{a + 1}") for a in range(k)])
    spark = y_long.sparkSession
    axes = spark.createDataFrame(
        [(f"RDA{a + 1}", float(eig[a] / (n - 1)), float(eig[a] / tot["ss"]) if tot["ss"] else None) for a in range(len(eig))],
        "axis string, eigenvalue double, share double",
    )
    coef = spark.createDataFrame(
        [(names[i], f"RDA{a + 1}", float(to_axis[i, a])) for a in range(k) for i in range(p)], "term string, axis string, coefficient double"
    )
    return {"scores": scores, "species": species, "axes": axes, "coefficients": coef}


def prc(
    y_long: DataFrame,
    x: DataFrame,
    row: str,
    key: str,
    value: str,
    treatment: str,
    time: str,
    treatments: Sequence[object],
    times: Sequence[object],
    k: int = 1,
) -> dict[str, DataFrame]:
    """Principal response curves: treatment within time, with time partialled out.

    The first treatment is the reference. ``curves`` gives the canonical coefficient of every other
    treatment at every time.
    """
    coded = x.select(row, F.col(treatment).alias("tr"), F.col(time).alias("ti"))
    # One indicator per treatment and time; a factor that keeps all times.
    joint = [f"{tr}@{ti}" for tr in treatments[1:] for ti in times]
    coded = coded.withColumn("both", F.concat_ws("@", F.col("tr").cast("string"), F.col("ti").cast("string")))
    fit = rda(y_long, coded, row, key, value, ["ti", "both"], {"ti": list(times), "both": joint}, condition=["ti"], k=k)
    split = F.split(F.expr("substr(term, 6)"), "@")
    curves = fit["coefficients"].filter(F.col("term").startswith("both_")).select(
        split[0].alias("treatment"), split[1].alias("time"), "axis", "coefficient"
    )
    return {**fit, "curves": curves}
