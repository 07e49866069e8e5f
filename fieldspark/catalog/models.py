"""Regressions, draws, ordinations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CELLS, DRAWS, cells, community, draws, r, rsql, table, traits_long, weather
from ..models import draws as DR
from ..models import ordination as OR
from ..models.design import model_matrix
from ..models.glm import fit_by, glm
from ..models.grouped_glm import glm_by
from ..models.grouped_mixed import lmm_groups
from ..models.least_squares import ols, poly_trend, trend
from ..models.mixed import lmm
from ..models.qr import ols_qr
from ..models.report import relabel_terms, report_table, term_class, term_group
from ..models.tidy import coefficients, glance_ols, linear_predictor, predict, scenarios, tidy, with_limits
from ..operators.grouping import scale
from ..operators.joins import r_join
from ..operators.reshape import gather
from .registry import query

TREATMENTS = {"Treatment": ["N", "A", "R"]}

# ---- design and least squares -----------------------------------------------------------------


@query("R-6", f"""WITH {CELLS} SELECT blockID, Treatment, Year, CAST(1 AS DOUBLE) AS Intercept, CAST((Treatment = 'A')::INT AS DOUBLE) AS Treatment_A, CAST((Treatment = 'R')::INT AS DOUBLE) AS Treatment_R,
CAST(n AS DOUBLE) AS n_x, CASE WHEN Treatment = 'A' THEN CAST(n AS DOUBLE) ELSE 0 END AS Treatment_A__n_x, CASE WHEN Treatment = 'R' THEN CAST(n AS DOUBLE) ELSE 0 END AS Treatment_R__n_x FROM cells""")
def design_matrix(spark, d):
    c = cells(spark, d).withColumnRenamed("n", "n_x").withColumn("Tr", F.col("Treatment"))
    out, names = model_matrix(c, ["Treatment", "n_x", "Treatment:n_x"], TREATMENTS, keep=["blockID", "Tr", "Year"])
    return out.select("blockID", F.col("Tr").alias("Treatment"), "Year", *names)


@query("M1", f"""WITH {CELLS} SELECT Treatment, {rsql("regr_slope(cover, n)", 5)} AS slope, {rsql("regr_intercept(cover, n)", 4)} AS intercept, count(*) AS n FROM cells GROUP BY Treatment""")
def least_squares_by_group(spark, d):
    c = cells(spark, d).withColumnRenamed("n", "x")
    fit = ols(c, "cover", ["x"], by=["Treatment"])
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    return fit.groupBy("Treatment").agg(r(pick("x"), 5).alias("slope"), r(pick("Intercept"), 4).alias("intercept"), F.max("n").alias("n"))


@query("M1", """SELECT l_returnflag, round(CAST(sum(l_quantity * l_linenumber) / sum(l_linenumber * l_linenumber) AS DOUBLE) + 1e-9, 6) AS slope FROM lineitem GROUP BY 1""")
def slope_without_intercept(spark, d):
    fit = ols(table(spark, d, "lineitem"), "l_quantity", ["l_linenumber"], by=["l_returnflag"], intercept=False)
    return fit.select("l_returnflag", r("estimate").alias("slope"))


@query("M1 M5")
def interaction_model(spark, d):
    c = cells(spark, d).withColumnRenamed("n", "x")
    fit = ols(c, "cover", ["Treatment", "x", "Treatment:x"], TREATMENTS)
    terms = with_limits(fit)
    return report_table(r_join(terms, glance_ols(fit).select("n", "AIC", "BIC"), ["n"], "left").select("term", "estimate", "std_error", "lower", "upper", "AIC", "BIC"), 3)


@query("M2", f"""WITH {CELLS} SELECT siteID, Treatment, {rsql("regr_slope(cover, Year)", 5)} AS slope, {rsql("regr_intercept(cover, Year)", 3)} AS intercept, {rsql("regr_r2(cover, Year)")} AS r2, regr_count(cover, Year)::BIGINT AS n FROM cells GROUP BY ALL""")
def trend_lines(spark, d):
    out = trend(cells(spark, d), ["siteID", "Treatment"], "cover", "Year")
    return out.select("siteID", "Treatment", r("slope", 5).alias("slope"), r("intercept", 3).alias("intercept"), r("r2").alias("r2"), "n")


@query("M3")
def polynomial_trends(spark, d):
    return poly_trend(cells(spark, d), ["Treatment"], "cover", "Year", 2)


@query("M3 M1", f"""WITH {CELLS}, c AS (SELECT Treatment, Year, CAST(cover AS DOUBLE) AS y, Year - avg(Year) OVER (PARTITION BY Treatment) AS d FROM cells),
e AS (SELECT *, d * d - avg(d * d) OVER (PARTITION BY Treatment) AS e FROM c),
m AS (SELECT Treatment, count(*) AS n, avg(y) AS y0, sum(d * d) AS dd, sum(d * e) AS de, sum(e * e) AS ee, sum(d * y) AS dy, sum(e * y) AS ey FROM e GROUP BY Treatment),
b AS (SELECT *, (dy * ee - ey * de) / (dd * ee - de * de) AS b1, (ey * dd - dy * de) / (dd * ee - de * de) AS b2 FROM m)
SELECT e.Treatment, e.Year, {rsql("y0 + b1 * d + b2 * e", 4)} AS fitted, {rsql("b2", 6)} AS curvature, n FROM (SELECT DISTINCT Treatment, Year, d, e FROM e) e JOIN b ON e.Treatment = b.Treatment""")
def raw_year_polynomials(spark, d):
    """Second-degree trends in the raw year; the SQL centres the years, which these fits do not need."""
    c = cells(spark, d).withColumn("Year2", F.col("Year").cast("double") * F.col("Year"))
    fit = ols_qr(c, "cover", ["Year", "Year2"], by=["Treatment"])
    of = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate"))).alias(t)
    wide = fit.groupBy("Treatment", "n").agg(*[of(t) for t in ("Intercept", "Year", "Year2")]).withColumnsRenamed({"Year": "b1", "Year2": "b2"})
    years = r_join(c.select("Treatment", "Year").distinct(), wide, "Treatment", "inner")
    x = F.col("Year").cast("double")
    return years.select("Treatment", "Year", r(F.col("Intercept") + F.col("b1") * x + F.col("b2") * x * x, 4).alias("fitted"), r("b2", 6).alias("curvature"), "n")


# ---- mixed and generalised models -------------------------------------------------------------


@query("M4 M5 W8")
def random_intercept_model(spark, d):
    c, _ = scale(r_join(cells(spark, d), weather(spark, d), "siteID"), ["tempLevel"], sd=False)
    fit = lmm(c, "cover", ["Treatment", "stempLevel", "Treatment:stempLevel"], ["siteID", "blockID"], TREATMENTS)
    return tidy(fit, c)


@query("M4 M5")
def restricted_likelihood_model(spark, d):
    c = cells(spark, d).withColumnRenamed("n", "x")
    fit = lmm(c, "cover", ["x", "Treatment"], ["siteID"], TREATMENTS, reml=True)
    return predict(fit, c, group_effects=True).groupBy("siteID", "Treatment").agg(F.avg("fitted").alias("fitted"), F.avg("cover").alias("observed"))


@query("M5 C23", f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_returnflag, scenario, {rsql("avg(a + b * (l_quantity * f1 + f2))", 3)} AS predicted, count(*) AS n FROM lineitem, f, (VALUES ('current', 1.0, 0.0), ('t85', 1.0, 3.9), ('sun', 0.9, 0.0), ('both', 0.9, 3.9)) AS s(scenario, f1, f2) GROUP BY ALL""")
def climate_scenario_predictions(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("temp"), "l_extendedprice")
    coef = coefficients(ols(li, "l_extendedprice", ["temp"]))
    cases = {"current": {}, "t85": {"temp": (1.0, 3.9)}, "sun": {"temp": (0.9, 0.0)}, "both": {"temp": (0.9, 3.9)}}
    rows = scenarios(li, cases).withColumn("predicted", linear_predictor(coef, ["temp"]))
    return rows.groupBy("l_returnflag", "scenario").agg(r(F.avg("predicted"), 3).alias("predicted"), F.count(F.lit(1)).alias("n"))


@query("M7")
def poisson_counts(spark, d):
    c = r_join(cells(spark, d), weather(spark, d), "siteID")
    return glm(c, "n", ["Treatment", "tempLevel"], "poisson", TREATMENTS)


@query("M7")
def binomial_survival(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(
        F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("p"), F.count(F.lit(1)).alias("tot")
    )
    o = o.withColumn("x", (F.col("year") - 1998).cast("double"))
    return glm(o, "p", ["x", "o_orderpriority"], "binomial", {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, weight="tot")


@query("M8 C24")
def model_per_trait(spark, d):
    long = gather(cells(spark, d).withColumn("n", F.col("n").cast("double")).select("siteID", "Treatment", "Year", "cover", "n"), ["cover", "n"], "trait", "value")
    spec = {
        "cover": lambda x: ols(x, "value", ["Treatment", "Year"], TREATMENTS).select("term", "estimate", "std_error"),
        "n": lambda x: glm(x, "value", ["Treatment", "Year"], "poisson", TREATMENTS).select("term", "estimate", "std_error"),
    }
    return fit_by(long, "trait", spec)


_SATURATED = """WITH v AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS Year, l_returnflag AS t, x.trait AS trait, x.value AS y
  FROM (SELECT *, unnest([{'trait': 'count', 'value': CAST(l_linenumber AS DOUBLE)}, {'trait': 'cover', 'value': l_quantity}, {'trait': 'share', 'value': CAST(l_discount > 0.05 AS DOUBLE)}]) AS x FROM lineitem)),
g AS (
  SELECT Year, trait, t, avg(y) AS m, CAST(count(*) AS DOUBLE) AS n, sum(y * y) - sum(y) * avg(y) AS rss,
    sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END) - CASE WHEN avg(y) > 0 THEN sum(y) * ln(avg(y)) ELSE 0 END AS pois, CASE WHEN avg(y) > 0 AND avg(y) < 1 THEN count(*) * (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) ELSE 0 END AS bin
  FROM v GROUP BY Year, trait, t),
s AS (SELECT Year, trait, CAST(sum(n) AS BIGINT) AS n, sum(rss) AS rss, CASE trait WHEN 'count' THEN 2 * sum(pois) WHEN 'cover' THEN sum(rss) ELSE -2 * sum(bin) END AS deviance FROM g GROUP BY Year, trait),
e AS (
  SELECT Year, trait, t, CASE trait WHEN 'count' THEN ln(m) WHEN 'cover' THEN m ELSE ln(m / (1 - m)) END AS l,
    CASE trait WHEN 'count' THEN 1 / (n * m) WHEN 'cover' THEN 1 / n ELSE 1 / (n * m * (1 - m)) END AS v FROM g)
"""


@query("M7 M8", _SATURATED + f"""
SELECT e.Year, e.trait, CASE e.t WHEN 'A' THEN 'Intercept' ELSE 'Treatment_' || e.t END AS term, {rsql("CASE e.t WHEN 'A' THEN e.l ELSE e.l - a.l END")} AS estimate,
  {rsql("sqrt((CASE e.t WHEN 'A' THEN e.v ELSE e.v + a.v END) * CASE e.trait WHEN 'cover' THEN rss / (s.n - 3) ELSE 1 END)")} AS std_error, s.n, {rsql("deviance", 3)} AS deviance
FROM e JOIN e a ON a.Year = e.Year AND a.trait = e.trait AND a.t = 'A' JOIN s ON s.Year = e.Year AND s.trait = e.trait""")
def families_by_year_and_trait(spark, d):
    li = table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("Year"), F.col("l_returnflag").alias("Treatment"), F.col("l_linenumber").cast("double").alias("count"), F.col("l_quantity").alias("cover"), (F.col("l_discount") > 0.05).cast("double").alias("share")
    )
    long = gather(li, ["count", "cover", "share"], "trait", "value")
    family = F.when(F.col("trait") == "count", "poisson").when(F.col("trait") == "cover", "gaussian").otherwise("binomial")
    fits = glm_by(long, ["Year", "trait"], "value", ["Treatment"], family, {"Treatment": ["A", "N", "R"]})
    return fits.select("Year", "trait", "term", r("estimate").alias("estimate"), r("std_error").alias("std_error"), "n", r("deviance", 3).alias("deviance"))


@query("M4 M8 C24")
def mixed_models_by_trait(spark, d):
    c, _ = scale(r_join(cells(spark, d), weather(spark, d), "siteID"), ["tempLevel", "Year"], sd=False)
    values = ["cover", "maxTemp", "n"]
    long = gather(c.select("siteID", "blockID", "Treatment", "stempLevel", "sYear", *[F.col(v).cast("double").alias(v) for v in values]), values, "trait", "value")
    return lmm_groups(long, ["trait"], "value", ["Treatment", "stempLevel", "sYear", "Treatment:stempLevel"], ["siteID", "blockID"], TREATMENTS)


_TERMS = "'Treatment' || CASE l_returnflag WHEN 'A' THEN 'FB' WHEN 'N' THEN 'GB' ELSE 'GF' END || CASE WHEN l_linenumber < 3 THEN ':sTemp70' WHEN l_linenumber < 5 THEN ':sTemp70:sPrecip70' ELSE '' END"
_SHORT = "CASE l_returnflag WHEN 'A' THEN 'G' WHEN 'N' THEN 'F' ELSE 'B' END || CASE WHEN l_linenumber < 3 THEN ' x t' WHEN l_linenumber < 5 THEN ' x t x P' ELSE '' END"


@query("C24", f"""SELECT {_SHORT} AS term, CASE WHEN l_linenumber < 3 THEN 'PFG x t' WHEN l_linenumber < 5 THEN 'PFG x t x P' ELSE 'Main effects' END AS class,
CASE l_returnflag WHEN 'A' THEN 'Graminoids' WHEN 'N' THEN 'Forbs' ELSE 'Bryophytes' END AS "group", round(CAST(avg(l_quantity) AS DOUBLE) + 1e-9, 3) AS estimate FROM lineitem GROUP BY 1, 2, 3""")
def term_report(spark, d):
    li = table(spark, d, "lineitem").withColumn("term", F.expr(_TERMS))
    out = relabel_terms(li.groupBy("term").agg(r(F.avg("l_quantity"), 3).alias("estimate")))
    t = F.col("term")
    return report_table(out.select("term", term_class(t).alias("class"), term_group(t).alias("group"), "estimate"))


# ---- draws ------------------------------------------------------------------------------------

_QS = ", ".join(f"{rsql(f'quantile_cont(value, {p})')} AS {n}" for p, n in ((0.025, "q2_5"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.975, "q97_5")))


@query("M9", f"""WITH {DRAWS}, c AS (SELECT param, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM draws GROUP BY ALL),
rh AS (SELECT param, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM c GROUP BY param)
SELECT param, {rsql("avg(value)")} AS mean, {rsql("stddev_samp(value)")} AS sd, count(*) AS n, {_QS}, {rsql("min(rhat)")} AS rhat FROM draws JOIN rh USING (param) GROUP BY param""")
def posterior_summary(spark, d):
    out = DR.summarise_draws(draws(spark, d))
    return out.withColumns({c: r(c) for c in ("mean", "sd", "q2_5", "q25", "q50", "q75", "q97_5", "rhat")})


@query("M10", f"""WITH {DRAWS}, obs AS (SELECT user_id, avg(value) AS y FROM events GROUP BY user_id), sims AS (SELECT user_id, floor(value / 5) * 5 AS s FROM events)
SELECT user_id AS obs_id, {rsql("avg(CASE WHEN s < floor(y / 5) * 5 THEN 1.0 WHEN s = floor(y / 5) * 5 THEN 0.5 ELSE 0 END)")} AS rank_resid, {rsql("avg(CASE WHEN s = 0 THEN 1.0 ELSE 0 END)")} AS zero_share,
CAST(max((floor(y / 5) = 0)::INT) AS INTEGER) AS observed_zero FROM sims JOIN obs USING (user_id) GROUP BY user_id""")
def simulation_rank_residuals(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("user_id", "obs_id")
    obs = ev.groupBy("obs_id").agg((F.floor(F.avg("value") / 5) * 5).alias("y"))
    sims = ev.select("obs_id", (F.floor(F.col("value") / 5) * 5).alias("y_sim"))
    out = DR.rank_residuals(sims, obs)
    return out.select("obs_id", r("rank_resid").alias("rank_resid"), r("zero_share").alias("zero_share"), "observed_zero")


# ---- ordination -------------------------------------------------------------------------------


@query("D1")
def principal_components(spark, d):
    scores, _ = OR.pca(traits_long(spark, d), "vec_id", "axis", "value", list(range(64)), 4)
    return scores


def _plots_and_species(spark, d):
    c = community(spark, d).withColumn("ID", F.concat_ws("_", F.col("blockID").cast("string"), "Treatment", F.col("Year").cast("string")))
    plots = r_join(c.select("ID", "siteID", "Treatment", "Year").distinct(), weather(spark, d), "siteID")
    return c.select("ID", "species", "cover"), plots


@query("D2")
def redundancy_analysis(spark, d):
    y, x = _plots_and_species(spark, d)
    out = OR.rda(y, x, "ID", "species", "cover", ["Treatment", "tempLevel", "precipLevel"], TREATMENTS, root=True)
    return out["species"]


@query("D2")
def principal_response_curves(spark, d):
    y, x = _plots_and_species(spark, d)
    years = list(range(1995, 2002))
    return OR.prc(y, x, "ID", "species", "cover", "Treatment", "Year", ["N", "A", "R"], years)["curves"]


