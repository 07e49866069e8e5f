"""Models against direct numpy solutions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.models import draws as DR
from fieldspark.models import ordination as OR
from fieldspark.models.design import design_columns, model_matrix
from fieldspark.models.envelope import bspline_basis, quantile_envelope
from fieldspark.models.glm import fit_by, glm
from fieldspark.models.least_squares import ols, poly_trend, trend
from fieldspark.models.mixed import lmm, lmm_by
from fieldspark.models.report import relabel_terms, report_table, term_class, term_group
from fieldspark.models.tidy import (
    CLIMATE_SCENARIOS, augment, coefficients, glance, glance_ols, linear_predictor, predict, scenarios, standard_error_of_fit, tidy, with_limits,
)

from .conftest import rows


@pytest.fixture(scope="module")
def plots(spark):
    rng = np.random.default_rng(1)
    n = 480
    pdf = pd.DataFrame({"site": np.repeat([f"s{i}" for i in range(8)], 60), "tr": rng.choice(["C", "F", "G"], n), "x": rng.normal(2, 1, n)})
    pdf["block"] = [f"b{i}" for i in rng.integers(0, 4, n)]
    site = dict(zip(pdf.site.unique(), rng.normal(0, 2, 8)))
    block = {k: v for k, v in zip(sorted({(a, b) for a, b in zip(pdf.site, pdf.block)}), rng.normal(0, 1, 32))}
    pdf["y"] = 1 + 0.5 * pdf.x + 2 * (pdf.tr == "F") - (pdf.tr == "G") * pdf.x + pdf.site.map(site) + [block[k] for k in zip(pdf.site, pdf.block)] + rng.normal(0, 1, n)
    return spark.createDataFrame(pdf).cache(), pdf


FACTORS = {"tr": ["C", "F", "G"]}


def design(pdf):
    f, g = (pdf.tr == "F").astype(float), (pdf.tr == "G").astype(float)
    return np.c_[np.ones(len(pdf)), f, g, pdf.x, f * pdf.x, g * pdf.x]


def test_contrasts(spark):
    full = design_columns(["tr", "x", "tr:x"], FACTORS)
    assert list(full) == ["Intercept", "tr_F", "tr_G", "x", "tr_F__x", "tr_G__x"]
    # Without the main effect of x, the interaction keeps all levels; without an intercept, so does the factor.
    assert list(design_columns(["tr", "tr:x"], FACTORS)) == ["Intercept", "tr_F", "tr_G", "tr_C__x", "tr_F__x", "tr_G__x"]
    assert list(design_columns(["tr"], FACTORS, intercept=False)) == ["tr_C", "tr_F", "tr_G"]
    df = spark.createDataFrame([("C", 2.0), (None, 1.0)], "tr string, x double")
    m, names = model_matrix(df, ["tr", "x"], FACTORS)
    assert [tuple(r) for r in m.select(*names).collect()] == [(1.0, 0.0, 0.0, 2.0), (1.0, None, None, 1.0)]


def test_ols_equals_numpy(plots):
    df, pdf = plots
    fit = ols(df, "y", ["tr", "x", "tr:x"], FACTORS)
    x = design(pdf)
    beta, rss, *_ = np.linalg.lstsq(x, pdf.y, rcond=None)
    cov = np.linalg.inv(x.T @ x) * rss[0] / (len(pdf) - 6)
    got = fit.toPandas().set_index("term")
    order = ["Intercept", "tr_F", "tr_G", "x", "tr_F__x", "tr_G__x"]
    np.testing.assert_allclose(got.loc[order].estimate, beta, rtol=1e-8)
    np.testing.assert_allclose(got.loc[order].std_error, np.sqrt(np.diag(cov)), rtol=1e-8)
    g = glance_ols(fit).first()
    ll = -len(pdf) / 2 * (np.log(2 * np.pi * rss[0] / len(pdf)) + 1)
    assert g["logLik"] == pytest.approx(ll) and g["AIC"] == pytest.approx(-2 * ll + 14)
    lim = with_limits(fit).filter("term = 'x'").first()
    assert lim["upper"] - lim["lower"] == pytest.approx(2 * 1.96 * lim["std_error"])


def test_ols_by_group_and_singular_design(plots):
    df, pdf = plots
    fit = ols(df.withColumn("x2", F.col("x") * 2), "y", ["x", "x2"], by=["tr"]).toPandas()
    for tr, part in pdf.groupby("tr"):
        got = fit[fit.tr == tr].set_index("term").estimate
        slope = np.polyfit(part.x, part.y, 1)[0]
        assert got["x"] + 2 * got["x2"] == pytest.approx(slope)


def test_trends(plots):
    df, pdf = plots
    t = trend(df, ["tr"], "y", "x").toPandas().set_index("tr")
    p = poly_trend(df, ["tr"], "y", "x", 2).toPandas().set_index(["tr", "term"]).estimate
    whole = poly_trend(df, [], "y", "x", 3).toPandas().set_index("term").estimate
    for tr, part in pdf.groupby("tr"):
        assert t.loc[tr].slope == pytest.approx(np.polyfit(part.x, part.y, 1)[0])
        c = p[tr, "center"]
        fitted = p[tr, "Intercept"] + p[tr, "x1"] * (part.x - c) + p[tr, "x2"] * (part.x - c) ** 2
        np.testing.assert_allclose(fitted, np.polyval(np.polyfit(part.x, part.y, 2), part.x), rtol=1e-7)
    d = pdf.x - whole["center"]
    np.testing.assert_allclose(whole["Intercept"] + sum(whole[f"x{k}"] * d**k for k in (1, 2, 3)), np.polyval(np.polyfit(pdf.x, pdf.y, 3), pdf.x), rtol=1e-6)


def profile(pdf, x, theta, groups, reml):
    """Deviance from the full covariance matrix."""
    n, p = x.shape
    v = np.eye(n)
    keys = pdf.site.to_numpy()
    v += theta[0] * (keys[:, None] == keys[None, :])
    if len(groups) == 2:
        kb = (pdf.site + pdf.block).to_numpy()
        v += theta[1] * (kb[:, None] == kb[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ pdf.y)
    r = pdf.y - x @ beta
    rss = r @ vi @ r
    dof = n - p if reml else n
    dev = np.linalg.slogdet(v)[1] + dof * (np.log(2 * np.pi * rss / dof) + 1)
    if reml:
        dev += np.linalg.slogdet(a)[1]
    return dev, beta, rss / dof, np.linalg.inv(a)


@pytest.mark.parametrize("groups,reml", [(["site"], False), (["site", "block"], True)])
def test_mixed_model_reaches_the_likelihood_optimum(plots, groups, reml):
    df, pdf = plots
    fit = lmm(df, "y", ["tr", "x", "tr:x"], groups, FACTORS, reml=reml)
    x = design(pdf)
    theta = [v / fit.sigma2 for v in fit.group_variance.values()]
    dev, beta, sigma2, inv = profile(pdf, x, theta, groups, reml)
    assert -2 * fit.loglik == pytest.approx(dev, abs=1e-6)
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-6)
    np.testing.assert_allclose(np.diag(fit.cov), sigma2 * np.diag(inv), rtol=1e-6)
    for i in range(len(theta)):
        for f in (0.9, 1.1):
            other = list(theta)
            other[i] *= f
            assert profile(pdf, x, other, groups, reml)[0] >= dev - 1e-6
    terms = {r["term"]: r for r in tidy(fit, df).collect()}
    assert terms["x"]["lower"] < terms["x"]["estimate"] < terms["x"]["upper"]
    assert glance(fit, df).first()["AIC"] == pytest.approx(fit.aic)
    fixed = predict(fit, df)
    mixed = augment(fit, df, "y")
    assert mixed.agg(F.avg(F.col("resid") ** 2)).first()[0] < fixed.agg(F.avg((F.col("y") - F.col("fitted")) ** 2)).first()[0]
    se = df.withColumn("se", standard_error_of_fit(fit)).toPandas().sort_values(["site", "x"]).se.to_numpy()
    want = np.sqrt(np.einsum("ij,jk,ik->i", x, fit.cov, x))
    np.testing.assert_allclose(np.sort(se), np.sort(want), rtol=1e-6)


def test_group_effects_are_the_best_predictions(plots):
    df, pdf = plots
    fit = lmm(df, "y", ["x"], ["site", "block"])
    x = np.c_[np.ones(len(pdf)), pdf.x]
    ts, tb = (v / fit.sigma2 for v in fit.group_variance.values())
    site, blk = pdf.site.to_numpy(), (pdf.site + pdf.block).to_numpy()
    cov = ts * (site[:, None] == site[None, :]) + tb * (blk[:, None] == blk[None, :])
    u = cov @ np.linalg.solve(cov + np.eye(len(pdf)), pdf.y - x @ fit.beta)
    want = pdf.assign(u=u).groupby(["site", "block"]).u.first()
    got = fit.effects.toPandas().set_index(["site", "block"]).effect
    np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-6)


def test_mixed_model_without_group_variance_is_ols(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.tile(["a", "b", "c", "d"], 50), "x": rng.normal(size=200)})
    pdf["y"] = pdf.x + rng.normal(size=200)
    pdf["y"] -= pdf.groupby("g").y.transform("mean") - pdf.y.mean()
    df = spark.createDataFrame(pdf)
    fit = lmm(df, "y", ["x"], ["g"])
    flat = coefficients(ols(df, "y", ["x"]))
    assert fit.group_variance["g"] == 0.0 and dict(zip(fit.terms, fit.beta))["x"] == pytest.approx(flat["x"])
    both = lmm_by(df.withColumn("k", F.lit("w")), "k", ["w"], y="y", terms=["x"], groups=["g"])
    assert both["w"].loglik == pytest.approx(fit.loglik)


def newton(x, y, w, family, steps=60):
    beta = np.zeros(x.shape[1])
    if family == "poisson":
        beta[0] = np.log(y.mean())
    for _ in range(steps):
        eta = x @ beta
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        v = mu if family == "poisson" else mu * (1 - mu)
        beta = beta + np.linalg.solve((x * (w * v)[:, None]).T @ x, x.T @ (w * (y - mu)))
    return beta, np.sqrt(np.diag(np.linalg.inv((x * (w * v)[:, None]).T @ x)))


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_glm_equals_newton(spark, family):
    rng = np.random.default_rng(2)
    x = np.c_[np.ones(300), rng.normal(size=300), rng.integers(0, 2, 300)]
    tot = rng.integers(5, 30, 300).astype(float)
    y = rng.poisson(np.exp(x @ [0.5, 0.3, -0.4])).astype(float) if family == "poisson" else rng.binomial(tot.astype(int), 1 / (1 + np.exp(-x @ [0.5, 0.3, -0.4]))) / tot
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x[:, 1], "t": np.where(x[:, 2] == 1, "b", "a"), "tot": tot}))
    got = glm(df, "y", ["x", "t"], family, {"t": ["a", "b"]}, None if family == "poisson" else "tot").toPandas().set_index("term").loc[["Intercept", "x", "t_b"]]
    beta, se = newton(x, y, np.ones(300) if family == "poisson" else tot, family)
    np.testing.assert_allclose(got.estimate, beta, rtol=1e-5)
    np.testing.assert_allclose(got.std_error, se, rtol=1e-5)


def test_rows_are_made_once_for_all_steps_of_a_fit(spark):
    """A fit reads its rows many times; what makes them runs once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(0, 60, 1, 2).selectExpr("CASE WHEN id % 2 = 0 THEN 'u' ELSE 'v' END AS t", "id % 7 AS x", "id % 5 + 1.0D AS y").mapInArrow(counted, "t string, x long, y double")
    spec = {t: (lambda d: glm(d, "y", ["x"], "poisson").select("term", "estimate")) for t in ("u", "v")}
    assert fit_by(df, "t", spec).count() == 4 and made.value == 60


def test_model_per_level(plots):
    df, _ = plots
    out = fit_by(df, "tr", {t: (lambda d: ols(d, "y", ["x"])) for t in ("C", "F")})
    assert out.groupBy("tr").count().count() == 2 and "term" in out.columns


def test_scenarios_and_predictor(spark):
    df = spark.createDataFrame([(100.0, 8.0, 0.5, "a")], "precip double, temp double, sunniness double, k string")
    got = {r["scenario"]: (round(r["precip"], 6), round(r["temp"], 6), round(r["sunniness"], 6)) for r in scenarios(df, CLIMATE_SCENARIOS).collect()}
    assert got["current"] == (100.0, 8.0, 0.5) and got["tPsun85"] == (117.0, 11.9, 0.45) and len(got) == 6
    assert df.select(linear_predictor({"Intercept": 1.0, "temp": 2.0}, ["temp"])).first()[0] == 17.0


def test_spline_basis_spans_cubics():
    x = np.linspace(0, 10, 50)
    b = np.c_[np.ones(50), bspline_basis(x, 10)]
    assert b.shape == (50, 11) and np.linalg.matrix_rank(b) == 11
    target = x**3 - 4 * x
    np.testing.assert_allclose(b @ np.linalg.lstsq(b, target, rcond=None)[0], target, atol=1e-8)


def test_envelope_leaves_the_wanted_share_below(spark):
    rng = np.random.default_rng(7)
    days = pd.date_range("2015-01-01", periods=400)
    pdf = pd.concat([pd.DataFrame({"site": s, "hour": 12, "day": days.date, "value": (2 + np.sin(np.arange(400) / 60)) * rng.random(400)}) for s in ("a", "b")])
    got = quantile_envelope(spark.createDataFrame(pdf), ["site", "hour"], "day", "value", 0.95).toPandas()
    for _, part in got.groupby("site"):
        assert abs((part.value <= part.fitted + 1e-6).mean() - 0.95) < 0.03
    short = quantile_envelope(spark.createDataFrame(pdf.head(3)), ["site", "hour"], "day", "value")
    assert short.count() == 3 and short.select("fitted").distinct().count() == 1


def test_envelope_minimises_the_check_loss(spark):
    from fieldspark.models.envelope import check_fit

    rng = np.random.default_rng(9)
    b = np.c_[np.ones(80), rng.normal(size=(80, 2))]
    y = b @ [1, 2, -1] + rng.exponential(size=80)
    loss = lambda c: np.sum(np.where(y > b @ c, 0.9, 0.1) * np.abs(y - b @ c))
    c = check_fit(b, y, 0.9)
    # The optimum of the check loss runs through three of the points: try all of them.
    best = min(loss(np.linalg.solve(b[list(i)], y[list(i)])) for i in __import__("itertools").combinations(range(80), 3) if abs(np.linalg.det(b[list(i)])) > 1e-9)
    assert loss(c) <= best * 1.001


def test_sunniness_is_bounded_and_filled(spark):
    from fieldspark.plans.climate import sunniness_index
    from fieldspark.sources.dictionaries import dictionaries

    rng = np.random.default_rng(3)
    stamps = pd.date_range("2015-06-01", periods=24 * 40, freq="h")
    data = [("uvb", s, t.to_pydatetime(), float(rng.random())) for s in ("Arhelleren", "Ovstedal") for t in stamps if not (s == "Ovstedal" and t.day == 5)]
    rad = spark.createDataFrame(data, "logger string, site string, date timestamp, value double")
    got = sunniness_index(rad, ["Arhelleren", "Ovstedal", "Veskre"], dictionaries(spark)["site_fallback"]).toPandas()
    assert len(got) == 3 * 40 and got.sunniness.max() <= 1 and got.sunniness.min() >= 0
    assert got.sunniness.notna().all()
    day = got[got.date.astype(str) == "2015-06-05"].set_index("siteID").sunniness
    assert day["Ovstedal"] == day["Arhelleren"] == day["Veskre"]


def test_draw_summary(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"param": "b", "chain": np.repeat([1, 2, 3], 200), "value": rng.normal(size=600) + np.repeat([0, 0, 1.0], 200)})
    r = DR.summarise_draws(spark.createDataFrame(pdf)).first()
    w = pdf.groupby("chain").value.var().mean()
    b = pdf.groupby("chain").value.mean().var()
    assert r["rhat"] == pytest.approx(np.sqrt((199 / 200 * w + b) / w))
    assert r["q97_5"] == pytest.approx(np.quantile(pdf.value, 0.975)) and r["mean"] == pytest.approx(pdf.value.mean())


def test_rank_residuals(spark):
    sims = spark.createDataFrame([(1, float(v)) for v in (0, 1, 2, 3)] + [(2, 0.0), (2, 0.0)], "obs_id int, y_sim double")
    obs = spark.createDataFrame([(1, 2.0), (2, 0.0)], "obs_id int, y double")
    assert rows(DR.rank_residuals(sims, obs)) == [(1, 0.625, 0.25, 0), (2, 0.5, 1.0, 1)]


def test_pca_equals_eigenvectors(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    long = pd.DataFrame([(i, f"v{j}", m[i, j]) for i in range(60) for j in range(5)], columns=["id", "trait", "value"])
    long = pd.concat([long, pd.DataFrame([(999, "v0", 1.0)], columns=long.columns)])
    df = spark.createDataFrame(long)
    scores, load = OR.pca(df.filter("id < 999"), "id", "trait", "value", [f"v{j}" for j in range(5)], 3)
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    val, vec = np.linalg.eigh(np.cov(z.T))
    got = scores.toPandas().sort_values("id")[["PC1", "PC2", "PC3"]].to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs(z @ vec[:, ::-1][:, :3]), atol=1e-8)
    assert load.groupBy("axis").agg(F.max_by("loading", F.abs("loading")).alias("m")).filter("m < 0").count() == 0
    exp = load.select("axis", "explained").distinct().toPandas().set_index("axis").explained
    assert exp["PC1"] == pytest.approx(val[-1] / val.sum())
    with_gap, _ = OR.pca(df, "id", "trait", "value", [f"v{j}" for j in range(5)], 2)
    assert with_gap.filter("id = 999").count() == 0


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(8)
    env = pd.DataFrame({"id": range(40), "tr": np.tile(["C", "F"], 20), "year": np.repeat([1, 2], 20).astype(int), "temp": rng.normal(size=40)})
    y = rng.poisson(2, size=(40, 6)).astype(float) + np.outer(env.temp > 0, [2, 0, 1, 0, 0, 3])
    long = pd.DataFrame([(i, f"sp{j}", y[i, j]) for i in range(40) for j in range(6) if y[i, j] > 0], columns=["id", "species", "cover"])
    return spark.createDataFrame(long), spark.createDataFrame(env), y, env


def direct_rda(y, x, cond=None):
    y, x = y - y.mean(0), x - x.mean(0)
    if cond is not None:
        cond = cond - cond.mean(0)
        x = x - cond @ np.linalg.lstsq(cond, x, rcond=None)[0]
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    u, s, vt = np.linalg.svd(fit, full_matrices=False)
    return s**2 / (len(y) - 1), vt, (s**2).sum() / (y**2).sum()


def test_rda_equals_direct_solution(sites):
    yl, xs, y, env = sites
    out = OR.rda(yl, xs, "id", "species", "cover", ["tr", "temp"], {"tr": ["C", "F"]})
    x = np.c_[env.tr == "F", env.temp].astype(float)
    val, vt, share = direct_rda(y, x)
    axes = out["axes"].toPandas().sort_values("axis")
    np.testing.assert_allclose(axes.eigenvalue[:2], val[:2], rtol=1e-8)
    assert axes.share.sum() == pytest.approx(share)
    sp = out["species"].toPandas().sort_values("species").RDA1.to_numpy()
    np.testing.assert_allclose(np.abs(sp / np.linalg.norm(sp)), np.abs(vt[0]), atol=1e-8)
    assert out["scores"].count() == 40
    rooted = OR.rda(yl, xs, "id", "species", "cover", ["temp"], root=True)["axes"].first()
    assert rooted["eigenvalue"] == pytest.approx(direct_rda(np.sqrt(y), env[["temp"]].to_numpy())[0][0])


def test_response_curves_partial_out_time(sites):
    yl, xs, y, env = sites
    out = OR.prc(yl, xs, "id", "species", "cover", "tr", "year", ["C", "F"], [1, 2])
    t = np.c_[env.year == 1, env.year == 2].astype(float)
    both = t * (env.tr == "F").to_numpy()[:, None]
    val, _, _ = direct_rda(y, both, t)
    got = out["axes"].toPandas().sort_values("axis").eigenvalue
    np.testing.assert_allclose(got[: len(val[val > 1e-10])], val[val > 1e-10], rtol=1e-6)
    assert rows(out["curves"], "treatment", "time") == [("F", "1"), ("F", "2")]


def test_report(spark):
    df = spark.createDataFrame([("TreatmentFB:sTemp70", 1.23456), ("(Intercept)", 1.0), ("sPrecip70", 2.0), ("sd_site", 3.0), ("TreatmentGB:sTemp70:sPrecip70", 0.5)], "term string, estimate double")
    out = relabel_terms(df)
    t = F.col("term")
    got = rows(report_table(out.select("term", term_class(t).alias("c"), term_group(t).alias("g"), "estimate"), 2))
    assert got == [("F x t x P", "PFG x t x P", "Forbs", 0.5), ("G x t", "PFG x t", "Graminoids", 1.23), ("P", "Main effects", "Climate", 2.0)]
