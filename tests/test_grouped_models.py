import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.models import grouped_glm as GG
from fieldspark.models import grouped_mixed as GM
from fieldspark.models.glm import glm
from fieldspark.models.mixed import lmm


def responses(seed=1, groups=6, n=120):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for g in range(groups):
        family = ("poisson", "binomial", "gaussian")[g % 3]
        for _ in range(n):
            x, t = float(rng.normal()), str(rng.choice(["C", "A", "B"]))
            eta = 0.4 + 0.6 * x - 0.5 * (t == "A") + 0.2 * (g % 6)
            w = float(rng.integers(1, 9))
            y = {"poisson": float(rng.poisson(math.exp(eta))), "binomial": rng.binomial(int(w), 1 / (1 + math.exp(-eta))) / w, "gaussian": eta + float(rng.normal())}[family]
            rows.append((f"g{g}", family, x, t, y, w if family == "binomial" else 1.0))
    return rows


SCHEMA = "g string, family string, x double, t string, y double, w double"
LEVELS = {"t": ["C", "A", "B"]}


def test_every_group_equals_sparks_regression(spark):
    df = spark.createDataFrame(responses() + [("g0", "poisson", None, "A", 3.0, 1.0), ("g1", "binomial", 0.0, "A", 0.5, 0.0)], SCHEMA).repartition(3)
    got = {(r["g"], r["term"]): r for r in GG.glm_by(df, ["g"], "y", ["t", "x", "t:x"], F.col("family"), LEVELS, "w").collect()}
    for g in range(6):
        family = ("poisson", "binomial", "gaussian")[g % 3]
        own = df.filter((F.col("g") == f"g{g}") & (F.col("w") > 0))
        for r in glm(own, "y", ["t", "x", "t:x"], family, LEVELS, "w").collect():
            mine = got[f"g{g}", r["term"]]
            assert mine["estimate"] == pytest.approx(r["estimate"], abs=1e-6) and mine["std_error"] == pytest.approx(r["std_error"], rel=1e-6)
            assert mine["deviance"] == pytest.approx(r["deviance"], rel=1e-8) and mine["settled"]
    assert len(got) == 36 and {r["n"] for r in got.values()} == {120}


def test_steps_do_not_depend_on_the_number_of_groups(spark, monkeypatch):
    made = []
    whole = GG._step_sums
    monkeypatch.setattr(GG, "_step_sums", lambda *a: (made.append(1), whole(*a))[1])
    counts = []
    for groups in (3, 24):
        made.clear()
        df = spark.createDataFrame(responses(2, groups, 40), SCHEMA)
        assert GG.glm_by(df, ["g"], "y", ["x"], F.col("family"), weight="w").filter("settled").count() == 2 * groups
        counts.append(len(made))
    assert counts[1] <= counts[0] + 3 and counts[1] <= 12


def test_regression_edges(spark):
    rows = [("zero", "poisson", float(i % 2), "C", 0.0, 1.0) for i in range(10)]
    rows += [("split", "binomial", float(i), "C", float(i > 4), 1.0) for i in range(10)]
    rows += [("one", "gaussian", 1.0, "C", 5.0, 1.0), (None, "poisson", 1.0, "C", 2.0, 1.0), (None, "poisson", 2.0, "C", 3.0, 1.0)]
    rows += [("large", "poisson", i / 10, "C", float(round(math.exp(10 + i / 10))), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["g"], r["term"]): r for r in GG.glm_by(df, ["g"], "y", ["x"], F.col("family"), weight="w", max_steps=8).collect()}
    assert len(got) == 10 and not got["split", "x"]["settled"]
    assert got["one", "Intercept"]["std_error"] is None and got["one", "Intercept"]["df_residual"] == 0
    assert got["large", "x"]["estimate"] == pytest.approx(1, abs=1e-3) and got["large", "x"]["settled"]
    assert got[None, "x"]["estimate"] == pytest.approx(math.log(1.5), abs=1e-6)
    # No finite maximum: the means go to the data all the same.
    assert got["split", "x"]["estimate"] > 5 and got["zero", "Intercept"]["estimate"] < -5
    whole = GG.glm_by(df.filter("g = 'large'"), [], "y", ["x"], "poisson").collect()
    assert {r["term"]: r["estimate"] for r in whole}["x"] == pytest.approx(got["large", "x"]["estimate"], abs=1e-9)
    assert GG.glm_by(df.filter("false"), ["g"], "y", ["x"], "poisson").count() == 0
    with pytest.raises(Exception, match="several families"):
        GG.glm_by(df.withColumn("g", F.lit("a")).filter("y >= 0 AND y <= 1"), ["g"], "y", ["x"], F.col("family")).collect()
    with pytest.raises(Exception, match="no response of its family"):
        GG.glm_by(df, ["g"], "y", ["x"], "binomial").collect()


# --- mixed models


def plots(seed, traits=4, sites=9, blocks=4):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for k in range(traits):
        outer, inner = (1.5, 0.0, 0.0, 0.6)[k % 4], (0.8, 0.0, 1.2, 0.0)[k % 4]
        for s in range(sites):
            a = rng.normal() * outer
            for b in range(blocks):
                u = rng.normal() * inner
                for _ in range(int(rng.integers(1, 7))):
                    x, t = float(rng.normal()), str(rng.choice(["C", "A"]))
                    rows.append((f"t{k}", s, b, x, t, float(3 + 0.5 * x - (t == "A") + a + u + rng.normal())))
    return rows


PLOTS = "trait string, site int, block int, x double, t string, y double"


def deviance(rows, theta, reml):
    """From the whole covariance matrix, row by row."""
    y = np.array([r[5] for r in rows])
    x = np.array([[1.0, r[3], r[4] == "A"] for r in rows], float)
    same = lambda key: np.array([[key(p) == key(q) for q in rows] for p in rows], float)
    h = np.eye(len(rows)) + theta[0] * same(lambda r: r[1]) + theta[1] * same(lambda r: (r[1], r[2]))
    hi = np.linalg.inv(h)
    a = x.T @ hi @ x
    beta = np.linalg.solve(a, x.T @ hi @ y)
    e = y - x @ beta
    dof = len(y) - (3 if reml else 0)
    out = np.linalg.slogdet(h)[1] + dof * (math.log(2 * math.pi * (e @ hi @ e) / dof) + 1)
    return out + (np.linalg.slogdet(a)[1] if reml else 0), beta


@pytest.mark.parametrize("reml", [False, True])
@pytest.mark.parametrize("groups", [["site"], ["site", "block"]])
def test_mixed_models_of_all_traits_at_once(spark, reml, groups):
    rows = plots(7)
    df = spark.createDataFrame(rows + [("t0", 1, 1, None, "A", 2.0), ("t0", 1, 1, 2.0, "A", None)], PLOTS).repartition(3)
    fits = GM.lmm_groups(df, ["trait"], "y", ["x", "t"], groups, {"t": ["C", "A"]}, reml).collect()
    assert len(fits) == 12 and all(r["settled"] for r in fits)
    # The lattice and the steps after it; with the group table and the totals not more than eight jobs.
    assert max(r["steps"] for r in fits) <= 6
    for k in range(4):
        own = {r["term"]: r for r in fits if r["trait"] == f"t{k}"}
        mine = next(iter(own.values()))
        theta = mine["outer_variance"] / mine["sigma2"], mine["inner_variance"] / mine["sigma2"]
        data = [r for r in rows if r[0] == f"t{k}"]
        at, beta = deviance(data, theta, reml)
        assert -2 * mine["loglik"] == pytest.approx(at, abs=1e-7)
        assert [own[t]["estimate"] for t in ("Intercept", "x", "t_A")] == pytest.approx(beta.tolist(), abs=1e-8)
        # No point nearby is better, nor is the older search on a lattice.
        for a in (0.7, 1.0, 1.3):
            for b in (0.7, 1.0, 1.3):
                assert deviance(data, (theta[0] * a + (a - 1 if a > 1 else 0) * 0.01, theta[1] * b + ((b - 1 if b > 1 else 0) * 0.01 if len(groups) == 2 else 0)), reml)[0] >= at - 1e-6
    old = lmm(df.filter("trait = 't0'"), "y", ["x", "t"], groups, {"t": ["C", "A"]}, reml)
    first = next(r for r in fits if r["trait"] == "t0")
    assert first["loglik"] >= old.loglik - 1e-6 and first["loglik"] == pytest.approx(old.loglik, abs=1e-4)


def test_mixed_models_steps_and_edges(spark):
    rng = random.Random(4)
    rows = plots(3, 24, 6, 3) + [("few", 1, 1, 0.5, "C", 1.0), ("few", 2, 1, 1.5, "A", 2.0), ("few", 3, 1, 2.5, "C", 2.0), ("few", 3, 1, 0.1, "A", 1.0), ("few", 4, 1, 0.9, "A", 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, PLOTS)
    fits = GM.lmm_groups(df, ["trait"], "y", ["x"], ["site", "block"])
    got = fits.collect()
    assert len(got) == 50 and all(r["settled"] for r in got) and max(r["steps"] for r in got) <= 8
    assert all(r["outer_variance"] >= 0 and r["inner_variance"] >= 0 and np.isfinite(r["loglik"]) for r in got)
    whole = GM.lmm_groups(df.filter("trait = 't1'"), [], "y", ["x"], ["site", "block"]).collect()
    assert whole[0]["loglik"] == pytest.approx(next(r["loglik"] for r in got if r["trait"] == "t1"), abs=1e-9)
    assert GM.lmm_groups(df.filter("false"), ["trait"], "y", ["x"], ["site"]).count() == 0
    with pytest.raises(ValueError):
        GM.lmm_groups(df, ["trait"], "y", ["x"], ["site", "block", "t"])
