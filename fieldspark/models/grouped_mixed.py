"""Gaussian random-intercept models of all groups at once, by average-information steps on grouped sums.

A model needs, per lowest group of rows, their number and the sums of design and response, and cross products of
all rows. These are made in one scan. For given variance ratios (group variance over residual variance) everything else is sums over
those groups: the likelihood, its gradient, and the average of observed and expected information. One job
evaluates a few ratios of every model side by side; the next ones come from the best of them by a Newton step, a part
of it, or, at the start, from a coarse lattice. Models that have settled take no part in later jobs, and the number of
jobs does not depend on the number of models.

With H = I + a Z1 Z1' + b Z2 Z2' (outer and inner groups), a group's rows enter by k = 1 / (1 + b n) and an outer
group's by m = sum n k. So the inverse of H, and its products with the indicator matrices, never appear as matrices of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import r_join
from ..session import cut_lineage
from .design import Term, design_columns
from .least_squares import unpack

#: Ratios of the first job; with two levels all pairs.
LATTICE = (0.0, 0.01, 0.1, 0.5, 2.0, 10.0, 60.0)
#: Shares of a Newton step that are tried side by side, and after none of them was better.
SHARES, SMALLER = (1.0, 0.5, 0.15), (0.04, 0.01, 0.002)
#: A step that is to gain less in twice the log-likelihood is the last.
GAIN = 1e-9
#: Partial sums that a task holds before it gives them on.
HELD = 2048


def _group_table(df: DataFrame, by: Sequence[str], y: str, groups: Sequence[str], design: Mapping) -> DataFrame:
    """Per lowest group: ``n``, ``s`` (sums of design and response) and ``m`` (triangle of cross products)."""
    names = [f"__x{i}" for i in range(len(design))] + ["__y"]
    cols = [c.cast("double").alias(x) for x, c in zip(names, [*design.values(), F.col(y)])]
    rows = df.select(*by, *groups, *cols).dropna(subset=names)
    sums = ", ".join(f"sum({x})" for x in names)
    triangle = ", ".join(f"sum({a} * {b})" for i, a in enumerate(names) for b in names[i:])
    return rows.groupBy(*by, *groups).agg(F.count(F.lit(1)).cast("double").alias("n"), F.expr(f"array({sums})").alias("s"), F.expr(f"array({triangle})").alias("m"))


def _layout(q: int) -> dict[str, slice]:
    """Where the parts of a model's sums stand."""
    out, at = {}, 0
    for name, size in (("log", 1), ("t1", 1), ("t2", 1), *[(x, q * q) for x in ("C", "M1", "M2", "Q11", "Q12", "Q22")]):
        out[name] = slice(at, at + size)
        at += size
    out["all"] = slice(0, at)
    return out


def _matrix(column: pa.Array, q: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), q)


def _partial(q: int, sums) -> callable:
    """A task's sums per model and point, from a function of one point's rows."""
    size = _layout(q)["all"].stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def given() -> pa.RecordBatch:
            flat = pa.array(np.concatenate(list(held.values())))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * np.int32(size)), flat)
            return pa.record_batch([pa.array([g for g, _ in held], pa.int64()), pa.array([i for _, i in held], pa.int32()), lists], names=["g", "i", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, i = batch.column("g").to_numpy(), batch.column("i").to_numpy()
            keys, which = np.unique(np.stack([g, i]), axis=1, return_inverse=True)
            which = which.reshape(-1)
            order = np.argsort(which, kind="stable")
            ends = np.cumsum(np.bincount(which))
            for key, rows in zip(keys.T.tolist(), np.split(order, ends[:-1])):
                part = held.setdefault(tuple(key), np.zeros(size))
                part += sums(batch.take(pa.array(rows)))
            if len(held) >= HELD:
                yield given()
                held = {}
        if held:
            yield given()

    return run


def _inner_sums(q: int):
    """Of lowest groups: the parts that are sums over them alone."""
    at = _layout(q)

    def sums(rows: pa.RecordBatch) -> np.ndarray:
        n, b, s = rows.column("n").to_numpy(), rows.column("b").to_numpy(), _matrix(rows.column("s"), q)
        k = 1 / (1 + b * n)
        out = np.zeros(at["all"].stop)
        out[at["log"]] = np.log1p(b * n).sum()
        out[at["t2"]] = (n * k).sum()
        for name, weight in (("C", b * k), ("M2", k * k), ("Q22", n * k**3)):
            out[at[name]] = ((s * weight[:, None]).T @ s).ravel()
        return out

    return sums


def _outer_sums(q: int):
    """Of outer groups: what their own variance adds, and its products with the inner one."""
    at = _layout(q)

    def sums(rows: pa.RecordBatch) -> np.ndarray:
        a, m, n2, n3 = (rows.column(x).to_numpy() for x in ("a", "m", "n2", "n3"))
        v, v1, v2 = (_matrix(rows.column(x), q) for x in ("v", "v1", "v2"))
        w, share = a / (1 + a * m), 1 / (1 + a * m)
        both = lambda weight, x, y: (x * weight[:, None]).T @ y
        even = lambda x: (x + x.T).ravel()
        # Sum of n k e over the inner groups, with e = k s - w n k v their part of Z2' inv(H).
        inner = v1 - (w * n2)[:, None] * v
        out = np.zeros(at["all"].stop)
        out[at["log"]] = np.log1p(a * m).sum()
        out[at["t1"]] = (m * share).sum()
        out[at["t2"]] = -(w * n2).sum()
        out[at["C"]] = both(w, v, v).ravel()
        out[at["M1"]] = both(share**2, v, v).ravel()
        out[at["M2"]] = -even(both(w, v1, v)) + both(w * w * n2, v, v).ravel()
        out[at["Q11"]] = both(m * share**3, v, v).ravel()
        out[at["Q12"]] = even(both(share**2, v, inner)) / 2
        out[at["Q22"]] = -even(both(w, v2, v)) + both(w * w * n3, v, v).ravel() - both(w, inner, inner).ravel()
        return out

    return sums


def _added(q: int):
    size = _layout(q)["all"].stop

    def run(t: pa.Table) -> pa.Table:
        i = t["i"].to_numpy()
        parts = t["part"].combine_chunks().flatten().to_numpy().reshape(len(i), size)
        points = np.unique(i)
        sums = np.stack([parts[i == p].sum(axis=0) for p in points])
        lists = pa.ListArray.from_arrays(pa.array([0, sums.size], pa.int32()), pa.array(sums.ravel()))
        return pa.table({"g": t["g"][:1], "sums": lists})

    return run


def _evaluated(z: np.ndarray, sums: np.ndarray, n: float, reml: bool) -> dict:
    """Deviance, estimates, gradient and average information at one point."""
    q = len(z)
    p, at = q - 1, _layout(len(z))
    mat = {x: sums[at[x]].reshape(q, q) for x in ("C", "M1", "M2", "Q11", "Q12", "Q22")}
    a = z - mat["C"]
    size = np.sqrt(np.clip(np.diag(a[:p, :p]), 1e-300, None))
    scaled = a[:p, :p] / np.outer(size, size)
    inv = np.linalg.pinv(scaled, hermitian=True) / np.outer(size, size)
    beta = inv @ a[:p, p]
    rss = max(float(a[p, p] - beta @ a[:p, p]), 1e-300)
    values = np.linalg.eigvalsh(scaled)
    used = values[values > values.max() * p * np.finfo(float).eps]
    dof = n - len(used) if reml else n
    deviance = float(sums[at["log"]][0]) + dof * (math.log(2 * math.pi * rss / dof) + 1)
    if reml:
        deviance += float(np.log(used).sum() + 2 * np.log(size).sum())
    c = np.append(-beta, 1.0)
    square = np.array([c @ mat["M1"] @ c, c @ mat["M2"] @ c])
    trace = np.array([sums[at["t1"]][0], sums[at["t2"]][0]])
    if reml:
        trace = trace - [np.sum(inv * mat[x][:p, :p]) for x in ("M1", "M2")]
    cross = [(mat[x] @ c)[:p] for x in ("M1", "M2")]
    info = np.array([[c @ mat["Q11"] @ c, c @ mat["Q12"] @ c], [c @ mat["Q12"] @ c, c @ mat["Q22"] @ c]])
    info = info - np.array([[x @ inv @ y for y in cross] for x in cross])
    sigma2 = rss / dof
    return {"deviance": deviance, "beta": beta, "cov": (sigma2 * inv).ravel(), "sigma2": sigma2, "gradient": trace - dof * square / rss, "information": (info - np.outer(square, square) / rss) / sigma2}


def _newton(theta: np.ndarray, e: dict, levels: int) -> tuple[np.ndarray, float]:
    """The step from a point and what it is to gain; a ratio at 0 stays there unless the likelihood grows with it."""
    g, info = e["gradient"], e["information"]
    free = [i for i in range(levels) if theta[i] > 0 or g[i] < 0]
    step = np.zeros(2)
    if free:
        h = info[np.ix_(free, free)]
        own = np.diag(h).copy()
        if np.isfinite(h).all() and (own > 0).all() and np.linalg.eigvalsh(h / np.sqrt(np.outer(own, own))).min() > 1e-8:
            step[free] = -np.linalg.solve(h, g[free])
        else:
            step[free] = -g[free] / np.where(own > 0, own, 1.0)
    # Down to 0 at most; the gain is that of the step as taken.
    step = np.maximum(step, -theta)
    return step, float(-(g @ step) - 0.5 * step @ info @ step)


def _next(r: dict, levels: int, reml: bool) -> dict:
    out = {k: v for k, v in r.items() if k != "sums"}
    q = int((math.isqrt(8 * len(r["z"]) + 1) - 1) // 2)
    z = unpack(r["z"], q)
    size = _layout(q)["all"].stop
    points = np.asarray(r["points"], float).reshape(-1, 2)
    found = [_evaluated(z, s, r["n"], reml) for s in np.asarray(r["sums"], float).reshape(-1, size)]
    i = int(np.argmin([f["deviance"] for f in found]))
    out["steps"] = r["steps"] + 1
    before = r["deviance"]
    known = before is not None and np.isfinite(before)
    theta, shares = points[i], SHARES
    if known and not found[i]["deviance"] < before:
        # None was better: a smaller part of the same step, or the end if that was one.
        theta, step = np.asarray(r["theta"], float), np.asarray(r["step"], float)
        if r["small"]:
            out["settled"] = True
            return out
        out["small"], shares = True, SMALLER
    else:
        e = found[i]
        step, gain = _newton(theta, e, levels)
        out.update(theta=theta, step=step, deviance=e["deviance"], beta=e["beta"], cov=e["cov"], sigma2=e["sigma2"], small=False)
        if abs(gain) < GAIN or not step.any():
            out["settled"] = True
            return out
    out["points"] = np.concatenate([np.maximum(theta + s * step, 0) for s in shares])
    return out


def lmm_groups(
    df: DataFrame,
    by: Sequence[str],
    y: str,
    terms: Sequence[Term],
    groups: Sequence[str],
    factors: Mapping[str, Sequence[object]] | None = None,
    reml: bool = False,
    intercept: bool = True,
    max_steps: int = 25,
) -> DataFrame:
    """A random-intercept model per value of ``by``: one row per term.

    Columns: ``*by, term, estimate, std_error, statistic, n, sigma2, outer_variance, inner_variance, loglik, steps, settled``.
    ``groups``: one level or two nested ones, outer first; inner labels may repeat between outer groups. Only complete rows
    count. Likelihood (or restricted likelihood) and estimates are those of :func:`~fieldspark.models.mixed.lmm`. A model that
    has not settled after ``max_steps`` jobs says so.
    """
    if len(groups) not in (1, 2):
        raise ValueError("one or two group levels")
    if set(by) & {"g", "n", "s", "m", "z", "points", "theta", "step", "deviance", "beta", "cov", "sigma2", "small", "steps", "settled", "sums"}:
        raise ValueError("a column of by has the name of a working column")
    design = design_columns(terms, factors, intercept)
    names = list(design)
    p, q, levels = len(names), len(names) + 1, len(groups)
    table = cut_lineage(_group_table(df, by, y, groups, design))
    triangle = ", ".join(f"sum(m[{i}])" for i in range(q * (q + 1) // 2))
    total = table.groupBy(*by) if by else table.groupBy()
    first = total.agg(F.sum("n").alias("n"), F.expr(f"array({triangle})").alias("z")).filter("n > 0")
    lattice = [(a, b) for a in LATTICE for b in (LATTICE if levels == 2 else (0.0,))]
    empty = {"theta": "array<double>", "step": "array<double>", "deviance": "double", "beta": "array<double>", "cov": "array<double>", "sigma2": "double"}
    state = first.select(
        *by,
        F.monotonically_increasing_id().alias("g"),
        "n",
        "z",
        F.array(*[F.lit(x) for ab in lattice for x in ab]).alias("points"),
        *[F.lit(None).cast(kind).alias(x) for x, kind in empty.items()],
        F.lit(False).alias("small"),
        F.lit(0).alias("steps"),
        F.lit(False).alias("settled"),
    )
    state = cut_lineage(state)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    keyed = r_join(table.drop("m"), state.select(*by, "g"), list(by), "inner") if by else table.drop("m").withColumn("g", F.lit(0).cast("long"))
    if not by:
        state = state.withColumn("g", F.lit(0).cast("long"))
    # Outer and inner labels under names of their own; nulls are labels too.
    inner = cut_lineage(keyed.select("g", F.col(groups[0]).alias("outer"), "n", "s"))
    part = "g long, i int, part array<double>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_next(r, levels, reml) for r in pdf.to_dict("records")], columns=[c for c in pdf.columns if c != "sums"])

    done: list[DataFrame] = []
    for _ in range(max_steps):
        points = state.select("g", F.posexplode(F.expr("transform(sequence(0, size(points) - 1, 2), x -> struct(points[x] AS a, points[x + 1] AS b))")).alias("i", "t")).select("g", "i", "t.a", "t.b")
        rows = inner.join(points, "g")
        k = rows.withColumn("k", F.expr("1 / (1 + b * n)"))
        vector = lambda weight: F.expr(f"array({', '.join(f'sum({weight} * s[{j}])' for j in range(q))})")
        outer = k.groupBy("g", "i", "a", "outer").agg(F.expr("sum(n * k)").alias("m"), F.expr("sum(n * k * n * k)").alias("n2"), F.expr("sum(n * k * n * k * n * k)").alias("n3"), vector("k").alias("v"), vector("n * k * k").alias("v1"), vector("n * k * n * k * k").alias("v2"))
        parts = rows.drop("outer").mapInArrow(_partial(q, _inner_sums(q)), part).unionAll(outer.mapInArrow(_partial(q, _outer_sums(q)), part))
        sums = parts.groupBy("g").applyInArrow(_added(q), "g long, sums array<double>")
        state = cut_lineage(state.join(sums, "g").select(*state.columns, "sums").mapInPandas(solve, fields))
        done.append(state.filter("settled"))
        state = state.filter("NOT settled")
        if state.isEmpty():
            break
    fits = done[0]
    for more in [*done[1:], state]:
        fits = fits.unionAll(more)
    each = fits.select(*by, "n", "sigma2", (F.col("sigma2") * F.get("theta", F.lit(0))).alias("outer_variance"), (F.col("sigma2") * F.get("theta", F.lit(1))).alias("inner_variance"), (-F.col("deviance") / 2).alias("loglik"), "steps", "settled", "cov", F.posexplode("beta").alias("i", "estimate"))
    error = F.sqrt(F.greatest(F.get("cov", F.col("i") * (p + 1)), F.lit(0.0)))
    out = each.withColumns({"term": F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1), "std_error": error})
    out = out.withColumn("statistic", F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error")))
    return out.select(*by, "term", "estimate", "std_error", "statistic", "n", "sigma2", "outer_variance", "inner_variance", "loglik", "steps", "settled")
