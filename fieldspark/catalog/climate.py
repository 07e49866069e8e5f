"""Logger quality control, micro-climate, moisture and climate work."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import CELLS, DAILY, LOGGER, SITE_NAMES, cells, daily, logger, r, rsql, table
from ..functions.aggregates import r_mean
from ..functions.missing import recode
from ..operators.joins import r_join
from ..plans import climate as C
from ..plans import loggers as L
from ..plans import microclimate as MC
from ..plans import moisture as MO
from ..session import ensure_checkpoint_dir
from ..sources.dictionaries import TURF_ALIASES, dictionaries
from ..streaming.hourly import hourly_state, latest_hours, read_arriving, write_changes
from .registry import query

# ---- logger quality control -------------------------------------------------------------------


def _logger_dictionary(spark, d):
    """Plot of each logger; broken ones carry a comment, some have no treatment."""
    per = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.max("value").alias("top"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    year = F.when(F.col("user_id") < 100, "_2016").otherwise("_2018")
    names = F.array(*[F.lit(s) for s in SITE_NAMES])
    out = per.select(
        F.concat(F.col("user_id").cast("string"), year).alias("ID"),
        F.element_at(names, (F.col("user_id") % 12 + 1).cast("int")).alias("siteID"),
        F.substring(F.col("user_id").cast("string"), -1, 1).alias("Block"),
        F.when(F.col("m") > 56, F.lit(None)).when(F.col("m") > 50, "FGB").when(F.col("m") > 45, "GF").otherwise("C").alias("Treatment"),
        F.when(F.col("top") > 350, "FAIL").when(F.col("top") > 250, "hot").alias("Comments"),
        (F.col("a") + F.expr("INTERVAL 2 DAYS")).alias("ReplacementDate"),
        (F.col("b") - F.expr("INTERVAL 2 DAYS")).alias("RemovalDate"),
    )
    return L.usable_dictionary(out)


_QC = f"""WITH {LOGGER}, p AS (SELECT user_id, avg(value) AS m, max(value) AS top, min(ts) + INTERVAL 2 DAY AS a, max(ts) - INTERVAL 2 DAY AS b FROM events GROUP BY user_id),
dic AS (SELECT user_id, a, b, right(CAST(user_id AS VARCHAR), 1) AS Block, CASE WHEN m > 56 THEN NULL WHEN m > 50 THEN 'FGB' WHEN m > 45 THEN 'GF' ELSE 'C' END AS Treatment FROM p WHERE top <= 350),
j AS (SELECT l.*, a, b, Block, Treatment FROM logger l JOIN dic ON l.ID = user_id WHERE Block NOT IN ('5', '7') AND l.ID NOT IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-30 20:00:00')),
k AS (SELECT *, value - lag(value) OVER (PARTITION BY ID ORDER BY date, event_id) AS jump FROM j WHERE Treatment IS NOT NULL AND NOT (ID < 100 AND (date < a OR date > b)))
SELECT event_id, left(siteID, 3) || Block || Treatment AS turfID, value FROM k
WHERE jump < 10 AND value > -20 AND value < 40 AND NOT (siteID = 'Gudmedalen' AND CAST(date AS DATE) < DATE '2024-01-10' AND value > 30)"""


@query("C10 J14 W3 P4 J7", _QC)
def logger_quality_control(spark, d):
    year = F.when(F.col("ID") < 100, "_2016").otherwise("_2018")
    readings = logger(spark, d).select("event_id", F.concat(F.col("ID").cast("string"), year).alias("ID"), "siteID", F.col("date").alias("Date"), F.col("value").alias("Value"))
    early = (F.col("siteID") == "Gudmedalen") & (F.to_date("Date") < F.lit("2024-01-10").cast("date")) & (F.col("Value") > 30)
    out = L.quality_control(L.clean_ids(readings), _logger_dictionary(spark, d), "2024-01-30 20:00:00", exclude=[early], skip_blocks=("5", "7"), tie="event_id")
    return out.select("event_id", "turfID", F.col("Value").alias("value"))


# ---- micro-climate ----------------------------------------------------------------------------


@query("C11 M6 A12 A17 R-3 J12 U3")
def sunniness_by_site_and_day(spark, d):
    rad = logger(spark, d).filter(F.col("value").isNotNull()).select("logger", F.col("siteID").alias("site"), "date", "value")
    rad = C.clean_radiation(rad, skip_loggers=["error"])
    pref = dictionaries(spark)["site_fallback"]
    return C.sunniness_index(rad, SITE_NAMES, pref)


@query("C12 P5", f"""SELECT event_id, CASE WHEN value / 100 > 0.66 THEN 'sunny' WHEN value / 100 > 0.33 THEN 'variable' WHEN value / 100 < 0.33 THEN 'cloudy' END AS weather,
CASE WHEN hour(ts) BETWEEN 10 AND 18 THEN 'day' WHEN hour(ts) IN (19, 20, 7, 8, 9) THEN 'spinup' ELSE 'night' END AS TOD FROM events""")
def weather_and_time_classes(spark, d):
    from ..functions.dates import time_of_day

    return table(spark, d, "events").select("event_id", C.weather_class(F.col("value") / 100).alias("weather"), time_of_day(F.hour("ts")).alias("TOD"))


_SITE_OF = "list_extract([" + ", ".join(f"'{s}'" for s in SITE_NAMES) + "], CAST(o_custkey % 12 + 1 AS INTEGER))"


@query("C13 A10 J3", f"""WITH o AS (SELECT {_SITE_OF} AS siteID, o_orderdate AS t, o_totalprice / 26000 AS v, floor(o_totalprice / 10000) AS p FROM orders WHERE year(o_orderdate) >= 1997),
tmp AS (SELECT siteID, avg(v) AS temp0916 FROM o WHERE month(t) BETWEEN 6 AND 9 GROUP BY 1), pr AS (SELECT siteID, avg(s) AS precip0916 FROM (SELECT siteID, sum(p) OVER (PARTITION BY siteID, year(t)) AS s FROM o) x GROUP BY 1)
SELECT siteID, {rsql("precip0916", 4)} AS precip0916, {rsql("temp0916")} AS temp0916, CAST(CASE WHEN temp0916 < 9 THEN 6.5 WHEN temp0916 > 10.5 THEN 10.5 ELSE 8.5 END AS DOUBLE) AS tempLevel
FROM pr FULL JOIN tmp USING (siteID)""")
def climate_zone_table(spark, d):
    names = F.array(*[F.lit(s) for s in SITE_NAMES])
    o = table(spark, d, "orders").select(
        F.element_at(names, (F.col("o_custkey") % 12 + 1).cast("int")).alias("siteID"), F.col("o_orderdate").alias("date"),
        (F.col("o_totalprice") / 26000).alias("value"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("Precipitation"),
    )
    out = C.climate_zones(o, o, first_year=1997)
    return out.select("siteID", r("precip0916", 4).alias("precip0916"), r("temp0916").alias("temp0916"), "tempLevel")


def _soil(spark, d):
    t = recode("logger", {"click": "C", "error": "FGB", "purchase": "GF", "signup": "FB"})
    return logger(spark, d).filter("logger <> 'view'").select(
        "event_id", "ID", "siteID", F.col("date").alias("Date"), F.col("value").alias("Value"), t.alias("Treatment"),
        F.concat(F.substring("siteID", 1, 3), t).alias("turfID"), F.lit("1").alias("blockID"),
    )


def _series(spark, d):
    readings = logger(spark, d).filter("logger = 'view'").withColumnsRenamed({"siteID": "site"}).withColumn("flag", F.lit(None).cast("string"))
    air = MC.air_temperature(readings, "view")
    days = daily(spark, d)
    sun = days.select("siteID", "date", (F.col("value") / 75).alias("sunniness"))
    precip = days.select("siteID", "date", F.col("n").alias("gridPrecipitation"))
    return MC.compile_series(_soil(spark, d), air, sun, precip)


_SERIES = f"""WITH {LOGGER}, {DAILY}, b AS (
  SELECT siteID, CAST(date AS DATE) AS date, CAST(hour(date) AS INTEGER) AS hour, CASE logger WHEN 'click' THEN 'C' WHEN 'error' THEN 'FGB' WHEN 'purchase' THEN 'GF' WHEN 'signup' THEN 'FB' END AS Treatment,
    CASE WHEN logger <> 'view' THEN value END AS Value, CASE WHEN logger = 'view' THEN value END AS airTemp, ID, logger FROM logger WHERE logger <> 'view' OR value IS NOT NULL),
s AS (SELECT d.siteID, d.date, d.n AS gridPrecipitation, b.hour, b.Treatment, b.Value, b.airTemp, b.ID, d.value / 75 AS sunniness,
  CASE WHEN hour BETWEEN 10 AND 18 THEN 'day' WHEN hour >= 21 OR hour <= 6 THEN 'night' WHEN hour IS NOT NULL THEN 'spinup' END AS TOD FROM daily d LEFT JOIN b USING (siteID, date))"""


@query("C14 U1 J2", f"""{_SERIES} SELECT siteID, date, TOD, gridPrecipitation, count(*) AS n, count(Value) AS soil, count(airTemp) AS air, {rsql("max(sunniness)")} AS sunniness FROM s GROUP BY ALL""")
def compile_microclimate(spark, d):
    return _series(spark, d).groupBy("siteID", "date", "TOD", "gridPrecipitation").agg(
        F.count(F.lit(1)).alias("n"), F.count("Value").alias("soil"), F.count("airTemp").alias("air"), r(F.max("sunniness")).alias("sunniness")
    )


@query("C14 C12 A11 W8 P12", f"""{_SERIES}, cov AS (SELECT l_returnflag, max(l_quantity) AS c FROM lineitem GROUP BY 1),
dp AS (SELECT siteID, Treatment, date, sunniness, TOD, ID, CASE WHEN count(*) = count(Value) THEN avg(Value) END AS meanTemp, CASE WHEN count(*) = count(Value) THEN max(Value) END AS maxTemp
  FROM s WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-28' AND TOD = 'day' AND Treatment IS NOT NULL GROUP BY ALL),
w AS (SELECT dp.*, CASE WHEN sunniness > 0.66 THEN 'sunny' WHEN sunniness > 0.33 THEN 'variable' WHEN sunniness < 0.33 THEN 'cloudy' END AS weather FROM dp)
SELECT siteID, Treatment, date, ID, weather, {rsql("meanTemp")} AS meanTemp, maxTemp, {rsql("sunniness - avg(sunniness) OVER ()")} AS ssunniness, {rsql("(meanTemp - avg(meanTemp) OVER ()) / stddev_samp(meanTemp) OVER ()")} AS smeanTemp FROM w""")
def daily_microclimate_plots(spark, d):
    series = _series(spark, d).filter(F.col("Treatment").isNotNull())
    days = MC.daily_plots(series, "2024-01-02", "2024-01-28")
    cover = _soil(spark, d).select("siteID", "turfID", "blockID", "Treatment", F.lit(10.0).alias("forbCov")).distinct()
    out = MC.standardised(MC.with_cover(days, cover), ["sunniness"], ["meanTemp"])
    return out.select("siteID", "Treatment", "date", "ID", "weather", r("meanTemp").alias("meanTemp"), "maxTemp", r("ssunniness").alias("ssunniness"), r("smeanTemp").alias("smeanTemp"))


@query("C15", f"""WITH {CELLS} SELECT c.siteID, c.blockID, c.Year, c.Treatment, c.maxTemp, c.maxTemp - f.maxTemp AS maxTemp_delta
FROM cells c LEFT JOIN (SELECT * FROM cells WHERE Treatment = 'R') f USING (siteID, blockID, Year) WHERE c.Treatment IN ('A', 'N')""")
def treatment_contrasts(spark, d):
    c = cells(spark, d).select("siteID", "blockID", "Year", "Treatment", "maxTemp")
    return MC.treatment_contrast(c, ["siteID", "blockID", "Year"], "R", ["A", "N"], "maxTemp").drop("maxTemp_ref")


# ---- soil moisture ----------------------------------------------------------------------------

_FIRST = """f AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) || ' TTC' AS turfID, l_orderkey, l_linenumber, l_returnflag AS treatment,
  CASE WHEN l_discount > 0.03 THEN l_quantity END AS m1, l_tax * 100 AS m2 FROM lineitem WHERE l_linestatus = 'O' AND l_discount <> 0.1),
fs AS (SELECT *, (sum(coalesce(m1, 0)) OVER w + sum(coalesce(m2, 0)) OVER w) / NULLIF(count(m1) OVER w + count(m2) OVER w, 0) AS SM FROM f WINDOW w AS (PARTITION BY date, turfID))"""


@query("C16 P16 U1", f"""WITH {_FIRST} SELECT 'first' AS campaign, turfID, count(*) AS n, {rsql("sum(SM)", 4)} AS SM FROM fs WHERE treatment <> 'R' GROUP BY turfID UNION ALL
SELECT 'second', l_suppkey || 'C', count(*), {rsql("sum((l_quantity + CASE WHEN l_tax > 0.05 THEN 0 ELSE l_linenumber END) / 2)", 4)} FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey""")
def soil_moisture_campaigns(spark, d):
    li = table(spark, d, "lineitem")
    first = li.filter("l_linestatus = 'O'").select(
        F.to_date("l_shipdate").alias("date"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(" TTC")).alias("turfID"),
        recode("l_returnflag", {"R": "XC"}).alias("treatment"),
        F.when(F.col("l_discount") == 0.1, "raining").when(F.col("l_discount") > 0.05, "fewer readings").alias("comments"),
        F.when(F.col("l_discount") > 0.03, F.col("l_quantity")).alias("M1"),
        F.col("l_tax") * 100,
    ).toDF("date", "turfID", "treatment", "comments", "M1", "M2")
    pooled = MO.pooled_moisture(first, ["M1", "M2"]).select(F.lit("first").alias("campaign"), "turfID", "SM")
    second = li.filter("l_linestatus = 'F'").select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit("C")).alias("turfID"),
        F.col("l_quantity").cast("string").alias("M1"),
        F.when(F.col("l_tax") > 0.05, "u").otherwise(F.col("l_linenumber").cast("string")).alias("M2"),
    )
    probes = MO.probe_moisture(second, ["M1", "M2"]).withColumn("campaign", F.lit("second"))
    both = MO.compile_moisture(pooled, probes)
    return both.groupBy("campaign", "turfID").agg(F.count(F.lit(1)).alias("n"), r(F.sum("SM"), 4).alias("SM"))


@query("C16 U3 J4", f"""WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) || CASE WHEN l_returnflag = 'N' THEN ' TTC' ELSE l_returnflag END AS turfID, sum(l_quantity) AS SM FROM lineitem GROUP BY 1),
alias(o, n) AS (VALUES {", ".join(str(a) for a in TURF_ALIASES)})
SELECT turfID, SM FROM m WHERE NOT contains(turfID, 'TTC') UNION ALL SELECT n, SM FROM m JOIN alias ON turfID = o""")
def shared_control_moisture(spark, d):
    turf = F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "N", " TTC").otherwise(F.col("l_returnflag")))
    sm = table(spark, d, "lineitem").groupBy(turf.alias("turfID")).agg(F.sum("l_quantity").alias("SM"))
    return MO.map_controls(sm, dictionaries(spark)["turf_aliases"])


# ---- weather ----------------------------------------------------------------------------------


@query("J2 A13", f"""WITH {LOGGER}, {DAILY}, site AS (SELECT siteID, avg(value) AS lt FROM daily GROUP BY 1)
SELECT d.siteID, d.date, {rsql("d.value - lt")} AS tAnom, CASE WHEN d.value - lt > 0 THEN 'red' WHEN d.value IS NOT NULL THEN 'blue' END AS sign FROM daily d JOIN site USING (siteID)""")
def daily_anomaly_sign(spark, d):
    from ..functions.missing import if_else

    days = daily(spark, d)
    lt = days.groupBy("siteID").agg(r_mean("value", True).alias("lt"))
    out = r_join(days, lt, None, "left").withColumn("tAnom", F.col("value") - F.col("lt"))
    return out.select("siteID", "date", r("tAnom").alias("tAnom"), if_else(F.col("tAnom") > 0, "red", "blue").alias("sign"))


# ---- streams ----------------------------------------------------------------------------------


@query("A12 C12", f"""WITH {LOGGER}, c AS (
  SELECT siteID, CASE WHEN hour(date) BETWEEN 10 AND 18 THEN 'day' WHEN hour(date) IN (19, 20, 7, 8, 9) THEN 'spinup' ELSE 'night' END AS TOD, date_trunc('hour', date) AS start, value FROM logger)
SELECT siteID, TOD, start, count(*) AS n, {rsql("CASE WHEN count(*) = count(value) THEN avg(value) END")} AS value FROM c GROUP BY ALL""")
def streamed_hourly_means(spark, d):
    """Readings arrive in four files; the stream is stopped after two and started again."""
    from ..functions.dates import time_of_day

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arriving-{uuid.uuid4().hex}"
    readings = logger(spark, d).select("siteID", F.col("date").cast("timestamp").alias("date"), "value")
    classes = {"TOD": time_of_day(F.hour("date"))}
    schema = None
    for part in (0, 1):
        readings.filter(F.pmod(F.xxhash64("date", "siteID"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(f"{root}/in")
        # Files come in any order of time here, so that no reading may count as late.
        hours = hourly_state(read_arriving(spark, f"{root}/in", readings.schema, 1), ["siteID"], delay="100 years", classes=classes)
        schema = hours.schema
        write_changes(hours, f"{root}/out", f"{root}/state").awaitTermination()
    out = latest_hours(spark, f"{root}/out", schema, ["siteID", "TOD", "start"])
    return out.withColumn("value", r("value"))
