"""Comparison joins, aggregates, distributions and order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import (
    CELLS, COMMUNITY, DAILY, DEPLOYMENT, LOGGER, WEATHER, cells, community, daily, deployment, logger, r, rsql, table, weather,
)
from ..functions import aggregates as A
from ..functions.dates import season
from ..operators import distributions as DI
from ..operators import grouping as G
from ..operators import ordered as O
from ..operators import sketches as SK
from ..operators.dissimilarity import dissimilarity
from ..operators.intervals import in_any_window
from ..operators.joins import (
    adjacent, anomaly_vs, baseline_delta, fill_from_alternative, paired_delta, r_join, within_deployment,
)
from ..operators.neighbours import nearest_samplings
from ..operators.quantiles import box_stats, quantiles
from ..session import cut_lineage
from ..sources.dictionaries import SITE_FALLBACK, dictionaries
from .registry import query

PLOT = ["siteID", "blockID", "Treatment", "Year"]

# ---- comparison joins -------------------------------------------------------------------------


@query("J8", f"""WITH {CELLS} SELECT c.siteID, c.blockID, c.Treatment, c.Year, c.cover, f.cover AS cover_ref, c.cover - f.cover AS cover_anom, c.maxTemp - f.maxTemp AS maxTemp_anom
FROM cells c LEFT JOIN (SELECT * FROM cells WHERE Treatment = 'R') f USING (siteID, blockID, Year)""")
def reference_anomaly(spark, d):
    out = anomaly_vs(cells(spark, d), F.col("Treatment") == "R", ["siteID", "blockID", "Year"], ["cover", "maxTemp"])
    return out.select(*PLOT, "cover", "cover_ref", "cover_anom", "maxTemp_anom")


@query("J9", f"""WITH {CELLS} SELECT t.siteID, t.blockID, t.Year, t.cover, t.cover - c.cover AS delta_cover, t.n - c.n AS delta_n
FROM (SELECT * FROM cells WHERE Treatment = 'A') t LEFT JOIN (SELECT * FROM cells WHERE Treatment = 'N') c USING (siteID, blockID, Year)""")
def treatment_control_delta(spark, d):
    out = paired_delta(cells(spark, d), "Treatment", "A", "N", ["siteID", "blockID", "Year"], ["cover", "n"])
    return out.select("siteID", "blockID", "Year", "cover", "delta_cover", "delta_n")


@query("J10 W2", f"""WITH {COMMUNITY}, idx AS (SELECT blockID, Treatment, Year, CAST(row_number() OVER (PARTITION BY blockID, Treatment ORDER BY Year) AS INTEGER) AS sampling
  FROM (SELECT DISTINCT blockID, Treatment, Year FROM community)), s AS (SELECT c.*, i.sampling FROM community c JOIN idx i USING (blockID, Treatment, Year))
SELECT a.blockID, a.Treatment, a.species, a.sampling, b.sampling AS sampling_near, a.cover, b.cover AS cover_near
FROM s a JOIN s b ON a.blockID = b.blockID AND a.Treatment = b.Treatment AND a.species = b.species AND abs(a.sampling - b.sampling) = 1""")
def adjacent_samplings(spark, d):
    c = community(spark, d).select("blockID", "Treatment", "Year", "species", "cover")
    idx = O.sampling_index(c, ["blockID", "Treatment"], "Year")
    s = r_join(c, idx, ["blockID", "Treatment", "Year"], "left")
    out = adjacent(s, s, ["blockID", "Treatment", "species"], "sampling", ["cover"])
    return out.select("blockID", "Treatment", "species", "sampling", "sampling_near", "cover", "cover_near")


@query("J11", f"""WITH {CELLS} SELECT c.siteID, c.blockID, c.Treatment, c.Year, c.cover - b.cover AS delta_cover, c.maxTemp - b.maxTemp AS delta_maxTemp
FROM cells c LEFT JOIN (SELECT * FROM cells WHERE Year = 1995) b USING (siteID, blockID, Treatment)""")
def change_since_baseline(spark, d):
    out = baseline_delta(cells(spark, d), ["siteID", "blockID", "Treatment"], "Year", 1995, ["cover", "maxTemp"])
    return out.select(*PLOT, "delta_cover", "delta_maxTemp")


@query("J12", f"""WITH {LOGGER}, {DAILY}, pref(siteID, alternative) AS (VALUES {", ".join(f"('{s}', '{a}')" for s, p, a in SITE_FALLBACK if p == 1)})
SELECT d.siteID, d.date, {rsql("coalesce(d.value, a.value)")} AS value FROM daily d LEFT JOIN pref p ON d.siteID = p.siteID
LEFT JOIN daily a ON a.siteID = p.alternative AND a.date = d.date""")
def fallback_site_fill(spark, d):
    pref = dictionaries(spark)["site_fallback"].filter("pref = 1").drop("pref")
    out = fill_from_alternative(daily(spark, d).select("siteID", "date", "value"), pref, "siteID", "date", "value")
    return out.select("siteID", "date", r("value").alias("value"))


@query("J14", f"""WITH {LOGGER}, {DEPLOYMENT} SELECT ID, logger, count(*) AS n, min(date) AS first, max(date) AS last FROM logger JOIN deployment USING (ID)
WHERE ID % 3 = 0 OR date BETWEEN placed AND removed GROUP BY ID, logger""")
def deployment_window(spark, d):
    out = within_deployment(logger(spark, d), deployment(spark, d), ["ID"], "date", "placed", "removed", guard=F.col("ID") % 3 != 0)
    return out.groupBy("ID", "logger").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


# ---- aggregates -------------------------------------------------------------------------------


@query("A1", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def row_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("A2", f"""WITH {LOGGER} SELECT ID, logger, {rsql("CASE WHEN count(*) = count(value) THEN avg(value) END")} AS mean_strict, {rsql("avg(value)")} AS mean,
{rsql("CASE WHEN count(*) = count(value) THEN coalesce(sum(value), 0) END")} AS sum_strict, {rsql("coalesce(sum(value), 0)")} AS total_,
CASE WHEN count(*) = count(value) THEN min(value) END AS min_strict, max(value) AS max_, {rsql("var_samp(value)")} AS var FROM logger GROUP BY ID, logger""")
def summaries_with_missing_policy(spark, d):
    return logger(spark, d).groupBy("ID", "logger").agg(
        r(A.r_mean("value")).alias("mean_strict"), r(A.r_mean("value", True)).alias("mean"),
        r(A.r_sum("value")).alias("sum_strict"), r(A.r_sum("value", True)).alias("total_"),
        A.r_min("value").alias("min_strict"), A.r_max("value", True).alias("max_"), r(A.r_var("value", True)).alias("var"),
    )


@query("A3", f"""WITH {COMMUNITY} SELECT siteID, Treatment, Year, count(DISTINCT species) AS richness,
count(DISTINCT CASE WHEN cover > 20 THEN species END) + max((cover <= 20)::INT) AS with_missing FROM community GROUP BY ALL""")
def species_richness(spark, d):
    c = community(spark, d).withColumn("common", F.when(F.col("cover") > 20, F.col("species")))
    return c.groupBy("siteID", "Treatment", "Year").agg(A.n_distinct("species", True).alias("richness"), A.n_distinct("common").alias("with_missing"))


@query("A4", f"""WITH {COMMUNITY} SELECT siteID, blockID, Treatment, Year, {rsql("sum(size * cover) / NULLIF(sum(CASE WHEN size IS NOT NULL THEN cover END), 0)")} AS cwm_size,
{rsql("sum(price * cover) / NULLIF(sum(cover), 0)", 4)} AS cwm_price FROM community GROUP BY ALL""")
def community_weighted_mean(spark, d):
    return community(spark, d).groupBy(*PLOT).agg(r(A.weighted_mean("size", "cover")).alias("cwm_size"), r(A.weighted_mean("price", "cover"), 4).alias("cwm_price"))


_WV = """SELECT c.*, size - sum(size * cover) OVER w / NULLIF(sum(CASE WHEN size IS NOT NULL THEN cover END) OVER w, 0) AS dev
FROM community c WHERE size IS NOT NULL WINDOW w AS (PARTITION BY siteID, blockID, Treatment, Year)"""


@query("A5", f"""WITH {COMMUNITY}, dev AS ({_WV}) SELECT siteID, blockID, Treatment, Year,
{rsql("CASE WHEN sum(cover) > 1 THEN sum(cover * dev * dev) / (sum(cover) - 1) END", 5)} AS freq,
{rsql("CASE WHEN count(*) > 1 THEN sum(cover * dev * dev) * sum(cover) / (sum(cover) * sum(cover) - sum(cover * cover)) END", 5)} AS reliability
FROM dev GROUP BY ALL""")
def weighted_variance(spark, d):
    c = community(spark, d).filter(F.col("size").isNotNull())
    return c.groupBy(*PLOT).agg(
        r(A.weighted_var("size", "cover", "freq", 25.0), 5).alias("freq"), r(A.weighted_var("size", "cover", "reliability", 25.0), 5).alias("reliability")
    )


_SHANNON = "-sum(CASE WHEN cover > 0 THEN cover / total * ln(cover / total) ELSE 0 END)"


@query("A6", f"""WITH {COMMUNITY}, t AS (SELECT *, sum(cover) OVER (PARTITION BY siteID, blockID, Treatment, Year) AS total FROM community)
SELECT siteID, blockID, Treatment, Year, {rsql(_SHANNON)} AS diversity FROM t GROUP BY ALL""")
def shannon_diversity(spark, d):
    return community(spark, d).groupBy(*PLOT).agg(r(A.shannon("cover")).alias("diversity"))


@query("A7", f"""WITH {COMMUNITY}, t AS (SELECT *, sum(cover) OVER (PARTITION BY siteID, blockID, Treatment, Year) AS total FROM community),
h AS (SELECT siteID, blockID, Treatment, Year, {_SHANNON} AS h, count(DISTINCT species) AS s FROM t GROUP BY ALL)
SELECT siteID, blockID, Treatment, Year, CASE WHEN s > 1 THEN {rsql("h / ln(s)")} END AS evenness FROM h""")
def evenness(spark, d):
    s = community(spark, d).groupBy(*PLOT).agg(A.shannon("cover").alias("h"), A.n_distinct("species").alias("s"))
    return s.select(*PLOT, r(A.evenness("h", "s")).alias("evenness"))


_SUMMARY_SQL = f"""WITH {COMMUNITY}, {WEATHER}, t AS (SELECT *, sum(cover) OVER w AS total,
  size - sum(size * cover) OVER w / NULLIF(sum(CASE WHEN size IS NOT NULL THEN cover END) OVER w, 0) AS dev
  FROM community WINDOW w AS (PARTITION BY siteID, blockID, Treatment, Year)),
g AS (SELECT siteID, blockID, Treatment, Year, count(DISTINCT species) AS richness, {_SHANNON} AS h, sum(cover) AS sumcover,
  sum(size * cover) / NULLIF(sum(CASE WHEN size IS NOT NULL THEN cover END), 0) AS wmean_size,
  CASE WHEN sum(CASE WHEN size IS NOT NULL THEN cover END) > 1 THEN sum(cover * dev * dev) / (sum(CASE WHEN size IS NOT NULL THEN cover END) - 1) END AS wvar_size
  FROM t GROUP BY ALL)
SELECT g.siteID, blockID, Treatment, Year, richness, {rsql("h")} AS diversity, sumcover, CASE WHEN richness > 1 THEN {rsql("h / ln(richness)")} END AS evenness,
  {rsql("wmean_size")} AS wmean_size, {rsql("wvar_size", 5)} AS wvar_size, tempLevel, precipLevel
FROM g LEFT JOIN weather w ON g.siteID = w.siteID"""


@query("A8 J1", _SUMMARY_SQL)
def community_summary(spark, d):
    s = G.community_summary(community(spark, d), PLOT, ["size"], shift={"size": 25.0})
    out = r_join(s, weather(spark, d), "siteID", "left")
    return out.select(
        *PLOT, "richness", r("diversity").alias("diversity"), "sumcover", r("evenness").alias("evenness"),
        r("wmean_size").alias("wmean_size"), r("wvar_size", 5).alias("wvar_size"), "tempLevel", "precipLevel",
    )


@query("A9", f"""WITH {COMMUNITY} SELECT siteID, blockID, Treatment, Year, species, cover, sum(cover) OVER (PARTITION BY blockID, Treatment, Year, functionalGroup) AS sumcover FROM community""")
def group_total_on_rows(spark, d):
    c = community(spark, d).select(*PLOT, "species", "functionalGroup", "cover")
    return G.sum_by(c, ["blockID", "Treatment", "Year", "functionalGroup"], "cover").drop("functionalGroup")


@query("A10", f"""SELECT l_returnflag, {rsql("avg(ys)", 4)} AS by_rows, {rsql("(SELECT avg(s) FROM (SELECT l_returnflag AS f, sum(l_quantity) AS s FROM lineitem GROUP BY l_returnflag, year(l_shipdate)) y WHERE f = l_returnflag)", 4)} AS by_years
FROM (SELECT l_returnflag, sum(l_quantity) OVER (PARTITION BY l_returnflag, year(l_shipdate)) AS ys FROM lineitem) t GROUP BY l_returnflag""")
def mean_of_yearly_sums(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("Year"), "l_quantity")
    rows = G.annual_then_mean(li, ["l_returnflag"], "Year", "l_quantity", "by_rows", "rows")
    years = G.annual_then_mean(li, ["l_returnflag"], "Year", "l_quantity", "by_years", "years")
    out = r_join(rows, years, "l_returnflag")
    return out.select("l_returnflag", r("by_rows", 4).alias("by_rows"), r("by_years", 4).alias("by_years"))


@query("A11", f"""WITH {LOGGER}, t AS (SELECT siteID, CAST(date AS DATE) AS day, CASE WHEN hour(date) BETWEEN 10 AND 18 THEN 'day' WHEN hour(date) >= 21 OR hour(date) <= 6 THEN 'night' ELSE 'spinup' END AS TOD, value FROM logger)
SELECT siteID, day, TOD, {rsql("CASE WHEN ok THEN m END")} AS meanTemp, CASE WHEN ok THEN hi END AS maxTemp, CASE WHEN ok THEN lo END AS minTemp, {rsql("CASE WHEN ok THEN hi - lo END")} AS magTemp
FROM (SELECT siteID, day, TOD, count(*) = count(value) AS ok, avg(value) AS m, max(value) AS hi, min(value) AS lo FROM t GROUP BY ALL) s""")
def daily_time_of_day_summary(spark, d):
    from ..functions.dates import time_of_day

    rows = logger(spark, d).select("siteID", F.to_date("date").alias("day"), time_of_day(F.hour("date")).alias("TOD"), "value")
    out = G.daily_summary(rows, ["siteID", "day", "TOD"])
    return out.withColumns({"meanTemp": r("meanTemp"), "magTemp": r("magTemp")})


@query("A12", f"""WITH {LOGGER} SELECT siteID, CAST(hour(date) AS INTEGER) AS hour, CAST(date AS DATE) AS day, {rsql("CASE WHEN count(*) = count(value) THEN avg(value) END")} AS value FROM logger GROUP BY ALL""")
def hourly_means(spark, d):
    return G.hourly_mean(logger(spark, d), ["siteID"]).withColumn("value", r("value"))


@query("A13", f"""SELECT o_orderpriority, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, {rsql("avg(o_totalprice)", 3)} AS lt_value,
DATE '2018-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS nominal_date FROM orders GROUP BY ALL""")
def day_of_year_climatology(spark, d):
    return G.climatology(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice").withColumn("lt_value", r("lt_value", 3))


_SEASON = "CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m BETWEEN 3 AND 5 THEN 'spring' WHEN m BETWEEN 6 AND 8 THEN 'summer' ELSE 'autumn' END"


@query("A14", f"""WITH lt AS (SELECT p, {_SEASON} AS season, avg(v) AS lt_mean FROM (
  SELECT o_orderpriority AS p, month(DATE '2018-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INTEGER)) AS m, avg(o_totalprice) AS v FROM orders GROUP BY o_orderpriority, dayofyear(o_orderdate), 2) a GROUP BY ALL),
y AS (SELECT p, {_SEASON} AS season, year, avg(v) AS season_mean FROM (SELECT o_orderpriority AS p, month(o_orderdate) AS m, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS v FROM orders) b GROUP BY ALL)
SELECT p AS o_orderpriority, year, season, {rsql("season_mean", 3)} AS season_mean, {rsql("lt_mean", 3)} AS lt_mean, {rsql("season_mean - lt_mean", 3)} AS anomaly FROM y JOIN lt USING (p, season)""")
def season_anomalies(spark, d):
    out = G.season_anomaly(table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice"), ["o_orderpriority"], "o_orderdate", "o_totalprice", season("month"))
    return out.withColumns({c: r(c, 3) for c in ("season_mean", "lt_mean", "anomaly")})


@query("A15", f"""SELECT o_custkey, {rsql("100.0 * sum((o_orderstatus = 'O')::INT) / NULLIF(sum((o_orderstatus <> 'P')::INT), 0)")} AS survival FROM orders GROUP BY o_custkey""")
def ratio_of_sums(spark, d):
    s = F.col("o_orderstatus")
    out = G.ratio_of_sums(table(spark, d, "orders"), ["o_custkey"], (s == "O").cast("int"), (s != "P").cast("int"), "survival")
    return out.withColumn("survival", r("survival"))


@query("A16", f"""WITH {COMMUNITY} SELECT blockID, species, dominance, count(*) AS n FROM (SELECT blockID, species,
CASE WHEN avg(cover) OVER w > 40 THEN 'dominant' WHEN avg(cover) OVER w < 40 THEN 'subordinate' END AS dominance FROM community WINDOW w AS (PARTITION BY blockID, species)) t GROUP BY ALL""")
def dominance_class(spark, d):
    out = G.dominance(community(spark, d), ["blockID", "species"], "cover", 40.0)
    return out.groupBy("blockID", "species", "dominance").agg(F.count(F.lit(1)).alias("n"))


@query("A17", f"""WITH {LOGGER} SELECT event_id, {rsql("value - min(value) OVER (PARTITION BY ID, siteID)")} AS value FROM logger""")
def subtract_group_minimum(spark, d):
    out = G.subtract_min(logger(spark, d), ["ID", "siteID"], "value")
    return out.select("event_id", r("value").alias("value"))


_Q = ", ".join(f"{rsql(f'quantile_cont(value, {p})')} AS {n}" for p, n in ((0.025, "q2"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.975, "q97")))
_PROBS, _NAMES = [0.025, 0.25, 0.5, 0.75, 0.975], ["q2", "q25", "q50", "q75", "q97"]


@query("A18", f"SELECT event_type, {_Q} FROM events GROUP BY event_type")
def exact_quantiles(spark, d):
    out = quantiles(table(spark, d, "events"), ["event_type"], "value", _PROBS, _NAMES)
    return out.withColumns({n: r(n) for n in _NAMES})


@query("A18", f"SELECT event_type, {_Q} FROM events GROUP BY event_type")
def exact_quantiles_of_large_groups(spark, d):
    out = quantiles(table(spark, d, "events"), ["event_type"], "value", _PROBS, _NAMES, limit=150)
    return out.withColumns({n: r(n) for n in _NAMES})


@query("A19", f"""WITH {COMMUNITY} SELECT siteID, Treatment, count(size) AS n, {rsql("avg(size)")} AS mean, {rsql("stddev_samp(size) / sqrt(count(size))")} AS se FROM community GROUP BY ALL""")
def mean_and_standard_error(spark, d):
    out = G.mean_se(community(spark, d), ["siteID", "Treatment"], "size")
    return out.withColumns({"mean": r("mean"), "se": r("se")})


@query("A20")
def bootstrap_mean_interval(spark, d):
    return DI.mean_cl_boot(table(spark, d, "events"), ["event_type"], "value", ["event_id"], replicates=200)


@query("A21", f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT e.event_type, value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
SELECT event_type, {rsql("min(q1)")} AS q1, {rsql("min(median)")} AS median, {rsql("min(q3)")} AS q3, min(CASE WHEN inside THEN value END) AS whisker_low,
max(CASE WHEN inside THEN value END) AS whisker_high, CAST(sum((NOT inside)::INT) AS BIGINT) AS n_outliers FROM j GROUP BY event_type""")
def box_plot_statistics(spark, d):
    out = box_stats(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({c: r(c) for c in ("q1", "median", "q3")})


_STEP = 500.0 / 63


@query("A22", f"""WITH p AS (SELECT event_type AS k, value / {_STEP!r} AS pos, least(CAST(floor(value / {_STEP!r}) AS INTEGER), 62) AS i FROM events WHERE value BETWEEN 0 AND 500),
b AS (SELECT k, i, 1 - (pos - i) AS w FROM p UNION ALL SELECT k, i + 1, pos - i FROM p), s AS (SELECT k, i, sum(w) AS w FROM b GROUP BY k, i),
t AS (SELECT *, sum(w) OVER (PARTITION BY k) AS total FROM s)
SELECT k AS event_type, CAST(g AS INTEGER) AS g, {rsql("sum(w * exp(-0.5 * ((g - i) * " + repr(_STEP) + " / 20) * ((g - i) * " + repr(_STEP) + " / 20)) / (total * 20 * sqrt(2 * pi())))", 8)} AS density
FROM t, range(64) AS r(g) GROUP BY ALL""")
def kernel_density(spark, d):
    out = DI.kde(table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0, 64, 20.0)
    return out.select("event_type", "g", r("density", 8).alias("density"))


@query("A22", """SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n, CAST(floor(value / 25) * 25 AS DOUBLE) AS bin_start FROM events GROUP BY ALL""")
def histogram_counts(spark, d):
    return DI.histogram(table(spark, d, "events"), ["event_type"], "value", 25.0)


@query("A23", """SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL""")
def collapse_repeated_keys(spark, d):
    return G.collapse_sum(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query("A24", """SELECT l_suppkey, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS A, coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS N,
coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS R FROM lineitem GROUP BY l_suppkey""")
def cross_table_of_sums(spark, d):
    return G.crosstab_sum(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_quantity")


# ---- windows and order ------------------------------------------------------------------------


@query("W1", f"""WITH {CELLS} SELECT siteID, blockID, Treatment, Year, cover, {rsql("avg(cover) OVER (PARTITION BY siteID, Year)")} AS mean_cover, max(n) OVER (PARTITION BY siteID, Year) AS top FROM cells""")
def group_value_on_rows(spark, d):
    out = G.attach(cells(spark, d), ["siteID", "Year"], mean_cover=F.avg("cover"), top=F.max("n"))
    return out.select(*PLOT, "cover", r("mean_cover").alias("mean_cover"), "top")


@query("W2", """SELECT o_custkey, year, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year) AS INTEGER) AS sampling FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) t""")
def sampling_number(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return O.sampling_index(o, ["o_custkey"], "year")


_SPIKE = f"""WITH {LOGGER}, l AS (SELECT *, value - lag(value) OVER (PARTITION BY ID ORDER BY date, event_id) AS jump FROM logger)
SELECT event_id, ID, value FROM l WHERE jump < 10"""


@query("W3", _SPIKE)
def spike_filter(spark, d):
    return O.spike_filter(logger(spark, d), ["ID"], "date", "event_id", "value", 10.0).select("event_id", "ID", "value")


@query("W3", _SPIKE.replace("PARTITION BY ID", "PARTITION BY logger"). replace("event_id, ID, value", "event_id, logger, value"))
def spike_filter_of_large_groups(spark, d):
    out = O.spike_filter(logger(spark, d), ["logger"], "date", "event_id", "value", 10.0, limit=300)
    return out.select("event_id", "logger", "value")


_FROST = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, min(value) - 10 AS tmin FROM events GROUP BY ALL)
SELECT user_id, date, CAST(sum((tmin < 0)::INT) OVER (PARTITION BY user_id ORDER BY date) AS BIGINT) AS frost_days FROM d"""


def _frost_table(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg((F.min("value") - 10).alias("tmin"))


@query("W4", _FROST)
def frost_day_count(spark, d):
    days = _frost_table(spark, d)
    return O.frost_days(days, ["user_id"], "date", "tmin", "tmin").select("user_id", "date", "frost_days")


@query("W4", """SELECT event_id, event_type, CAST(sum((value < 10)::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cold FROM events""")
def running_count_of_large_groups(spark, d):
    ev = table(spark, d, "events")
    out = O.running_sum(ev, ["event_type"], "ts", "event_id", (F.col("value") < 10).cast("long"), "cold", limit=300)
    return out.select("event_id", "event_type", "cold")


@query("W5", """SELECT l_suppkey, year, sum(q) AS l_quantity, sum(sum(q)) OVER (PARTITION BY l_suppkey ORDER BY year) AS cumulative FROM (
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS q FROM lineitem) t GROUP BY l_suppkey, year""")
def cumulative_yearly_totals(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_quantity")
    return O.cumsum_by(li, ["l_suppkey"], "year", "l_quantity")


@query("W6", f"""WITH {LOGGER}, {DAILY}, h AS (SELECT siteID, date, n FROM daily WHERE value <= 45)
SELECT siteID, date, n FROM h WHERE date = (SELECT min(date) FROM h g WHERE g.siteID = h.siteID)""")
def first_threshold_crossing(spark, d):
    return G.first_crossing(daily(spark, d), ["siteID"], "date", F.col("value") <= 45).select("siteID", "date", "n")


@query("W7", """SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 2)""")
def groups_of_two(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return G.having_n(li, ["l_orderkey"], 2)


@query("W8", f"""WITH {LOGGER} SELECT event_id, {rsql("value - (SELECT avg(value) FROM logger)")} AS cvalue, {rsql("(value - avg(value) OVER w) / NULLIF(stddev_samp(value) OVER w, 0)")} AS svalue
FROM logger WINDOW w AS (PARTITION BY siteID)""")
def standardise(spark, d):
    centred, _ = G.scale(logger(spark, d), ["value"], sd=False, prefix="c")
    out, _ = G.scale(centred, ["value"], by=["siteID"])
    return out.select("event_id", r("cvalue").alias("cvalue"), r("svalue").alias("svalue"))


@query("W9", """SELECT event_id, value, value BETWEEN m - 2.5 AND m + 2.5 AS in_band FROM events, (SELECT avg(value) AS m FROM events WHERE event_type = 'view') t""")
def band_around_mean(spark, d):
    ev = table(spark, d, "events")
    return G.band_flag(ev, F.col("event_type") == "view", "value", 2.5).select("event_id", "value", "in_band")


@query("W10", f"""WITH {CELLS} SELECT siteID, blockID, Treatment, Year, cover FROM cells c WHERE cover = (SELECT max(cover) FROM cells g WHERE g.blockID = c.blockID)""")
def rows_at_group_maximum(spark, d):
    return G.filter_group_max(cells(spark, d), ["blockID"], "cover").select(*PLOT, "cover")


@query("D3", f"""WITH {COMMUNITY}, t AS (SELECT blockID, Treatment, Year, sum(cover) AS total FROM community GROUP BY ALL),
m AS (SELECT a.blockID, a.Treatment, a.Year, sum(least(a.cover, b.cover)) AS shared FROM community a JOIN community b USING (blockID, Treatment, species) WHERE b.Year = 1996 GROUP BY ALL),
x AS (SELECT t.blockID, t.Treatment, t.Year, 1 - 2 * coalesce(shared, 0) / (t.total + z.total) AS bray FROM t JOIN t z ON t.blockID = z.blockID AND t.Treatment = z.Treatment AND z.Year = 1996
  LEFT JOIN m ON t.blockID = m.blockID AND t.Treatment = m.Treatment AND t.Year = m.Year)
SELECT blockID, Treatment, Year, {rsql("bray")} AS bray, {rsql("2 * bray / (1 + bray)")} AS jaccard FROM x""")
def community_dissimilarity(spark, d):
    out = dissimilarity(community(spark, d), ["blockID", "Treatment"], "Year", 1996)
    return out.withColumns({"bray": r("bray"), "jaccard": r("jaccard")})


SAMPLINGS = """samplings AS (
  SELECT l_suppkey AS blockID, CAST(year(l_shipdate) AS INTEGER) AS Year, l_partkey AS species, CAST(sum(l_quantity) AS DOUBLE) AS cover
  FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0)"""


@query("D3", f"""WITH {SAMPLINGS}, t AS (SELECT blockID, Year, sum(cover) AS total FROM samplings GROUP BY ALL),
m AS (SELECT a.blockID, a.Year, b.blockID AS near_blockID, b.Year AS near_Year, sum(least(a.cover, b.cover)) AS shared
  FROM samplings a JOIN samplings b ON a.species = b.species AND (a.blockID <> b.blockID OR a.Year <> b.Year) GROUP BY ALL),
x AS (SELECT m.*, 2 * shared / (t.total + z.total) AS sim FROM m JOIN t ON m.blockID = t.blockID AND m.Year = t.Year JOIN t z ON m.near_blockID = z.blockID AND m.near_Year = z.Year),
k AS (SELECT *, row_number() OVER (PARTITION BY blockID, Year ORDER BY sim DESC, near_blockID, near_Year) AS rank FROM x)
SELECT blockID, Year, CAST(rank AS INTEGER) AS rank, near_blockID, near_Year, {rsql("1 - sim")} AS bray, {rsql("2 * (1 - sim) / (2 - sim)")} AS jaccard FROM k WHERE rank <= 5""")
def nearest_communities(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("blockID"), F.year("l_shipdate").alias("Year"), F.col("l_partkey").alias("species"), F.col("l_quantity").alias("cover"))
    out = nearest_samplings(rows, ["blockID", "Year"], 5)
    return out.withColumns({"bray": r("bray"), "jaccard": r("jaccard")})


WINDOWS = """windows AS (
  SELECT user_id AS ID, CASE WHEN event_id % 97 <> 0 THEN ts END AS opened, CASE WHEN event_id % 89 <> 0 THEN ts + INTERVAL 12 HOUR END AS closed
  FROM events WHERE event_type = 'purchase')"""


@query("J14", f"""WITH {LOGGER}, {WINDOWS} SELECT ID, logger, count(*) AS n, min(date) AS first, max(date) AS last FROM logger l
WHERE EXISTS (SELECT 1 FROM windows w WHERE w.ID = l.ID AND (opened IS NULL OR date >= opened) AND (closed IS NULL OR date <= closed)) GROUP BY ID, logger""")
def readings_in_any_window(spark, d):
    ts = F.col("ts")
    windows = table(spark, d, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("ID"),
        F.when(F.col("event_id") % 97 != 0, ts).alias("opened"),
        F.when(F.col("event_id") % 89 != 0, ts + F.expr("INTERVAL 12 HOURS")).alias("closed"),
    )
    out = in_any_window(logger(spark, d), windows, ["ID"], "date", "opened", "closed")
    return out.groupBy("ID", "logger").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


# ---- stored sketches --------------------------------------------------------------------------

_SKETCH_PROBS = (0.05, 0.5, 0.95)


@query("A18 S12", f"""WITH {LOGGER} SELECT siteID, CAST(p.prob AS DOUBLE) AS prob, count(value) AS n, true AS within FROM logger, (VALUES {", ".join(f"({p})" for p in _SKETCH_PROBS)}) AS p(prob)
WHERE value IS NOT NULL GROUP BY ALL""")
def quantiles_of_merged_days(spark, d):
    """Daily sketches are stored; the sites' quantiles come from them, and their ranks among all readings are within the bound."""
    readings = logger(spark, d).select("siteID", F.to_date("date").alias("day"), "value")
    days = cut_lineage(SK.quantile_sketches(readings, ["siteID", "day"], "value"))
    found = SK.sketch_quantiles(SK.merged_sketches(days, ["siteID"]), _SKETCH_PROBS)
    ranked = r_join(readings.filter("value IS NOT NULL"), found, ["siteID"], "inner").groupBy("siteID", "prob", "n").agg(
        F.avg((F.col("value") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("upto")
    )
    error = SK.rank_error()
    return ranked.select("siteID", "prob", "n", ((F.col("below") <= F.col("prob") + error) & (F.col("upto") >= F.col("prob") - error)).alias("within"))


@query("A3 J5", f"""WITH {COMMUNITY}, f AS (SELECT DISTINCT blockID, species FROM community WHERE Year <= 1995), s AS (SELECT DISTINCT blockID, species FROM community WHERE Year > 1995)
SELECT blockID, count(f.species) AS n_first, count(s.species) AS n_second, count(*) FILTER (f.species IS NOT NULL AND s.species IS NOT NULL) AS n_both,
  count(*) FILTER (f.species IS NULL) AS n_gained, count(*) FILTER (s.species IS NULL) AS n_lost, count(*) AS n_either
FROM f FULL JOIN s USING (blockID, species) GROUP BY blockID""")
def species_sets_of_merged_years(spark, d):
    """Sets of species are stored by block and year; unions of years, and what two periods share, come from them."""
    years = cut_lineage(SK.set_sketches(community(spark, d), ["blockID", "Year"], "species"))
    return SK.compared_sets(years, ["blockID"], {"first": F.col("Year") <= 1995, "second": F.col("Year") > 1995})
