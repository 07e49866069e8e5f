"""Projections, filters, plain joins, set operations, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import (
    CELLS, COMMUNITY, DAILY, LOGGER, SITE_NAMES, WEATHER, cells, community, daily, logger, r, rsql, table, weather,
)
from ..functions import dates as D
from ..functions.missing import (
    case_when, coalesce_blank, if_else, is_in, parse_number, paste, recode, row_mean, row_sum, update_where,
)
from ..functions.text import digits_only, species_code, strip_stray_bytes, turf_key
from ..operators import projection as P
from ..operators import reshape as R
from ..operators import sets as S
from ..operators.grouping import reorder_levels
from ..operators.joins import anti, build_community, complete_with, grid, overlay, r_join, semi
from ..operators.ordered import distinct_first
from .registry import query

# ---- projections and filters ------------------------------------------------------------------


@query("P1", "SELECT p_partkey, p_brand AS brand, p_type FROM part")
def select_column_range(spark, d):
    return P.select_range(table(spark, d, "part"), "p_partkey:p_type", drop=["p_name"], rename={"brand": "p_brand"})


@query("P2", f"""SELECT l_returnflag, {rsql("sum(l_extendedprice * (1 - l_discount))", 2)} AS revenue, sum(l_quantity * 10) AS mm
FROM lineitem GROUP BY l_returnflag""")
def computed_columns(spark, d):
    li = table(spark, d, "lineitem").withColumns({"rev": F.col("l_extendedprice") * (1 - F.col("l_discount")), "mm": F.col("l_quantity") * 10})
    return li.groupBy("l_returnflag").agg(r(F.sum("rev"), 2).alias("revenue"), F.sum("mm").alias("mm"))


@query("P3", f"""WITH {LOGGER} SELECT ID, count(*) AS n FROM logger
WHERE (value > 50 AND logger <> 'error') OR (siteID = 'Fauske' AND value < 5) GROUP BY ID""")
def row_filter(spark, d):
    lg = logger(spark, d)
    keep = ((F.col("value") > 50) & (F.col("logger") != "error")) | ((F.col("siteID") == "Fauske") & (F.col("value") < 5))
    return lg.filter(keep).groupBy("ID").agg(F.count(F.lit(1)).alias("n"))


@query("P4", f"""WITH {LOGGER}, c AS (SELECT *, CASE WHEN value >= 5 THEN logger END AS comment FROM logger)
SELECT siteID, count(*) AS n, count(comment) AS commented FROM c WHERE comment IS NULL OR comment NOT IN ('error', 'view') GROUP BY siteID""")
def membership_keeps_missing(spark, d):
    lg = logger(spark, d).withColumn("comment", F.when(F.col("value") >= 5, F.col("logger")))
    kept = lg.filter(~is_in("comment", ["error", "view"]))
    return kept.groupBy("siteID").agg(F.count(F.lit(1)).alias("n"), F.count("comment").alias("commented"))


@query("P5", f"""WITH {LOGGER} SELECT event_id, CASE WHEN value IS NULL THEN 'none' WHEN value > 40 THEN 'high' ELSE 'low' END AS two,
CASE WHEN value > 66 THEN 'sunny' WHEN value > 33 THEN 'variable' WHEN value < 33 THEN 'cloudy' END AS many,
CASE WHEN value IS NULL THEN NULL WHEN value > 40 THEN 1 ELSE 0 END AS flag FROM logger""")
def conditional_columns(spark, d):
    v = F.col("value")
    return logger(spark, d).select(
        "event_id",
        if_else(v > 40, "high", "low", "none").alias("two"),
        case_when((v > 66, "sunny"), (v > 33, "variable"), (v < 33, "cloudy")).alias("many"),
        if_else(v > 40, 1, 0).alias("flag"),
    )


@query("P6", """SELECT CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'O' THEN 'alive' ELSE o_orderstatus END AS kept,
CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 END::DOUBLE AS number, count(*) AS n FROM orders GROUP BY 1, 2""")
def recode_values(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(
        recode("o_orderstatus", {"F": "dead", "O": "alive"}).alias("kept"), recode("o_orderstatus", {"F": 0.0, "O": 1.0}, "null").alias("number")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P7", """WITH upd AS (SELECT l_suppkey AS s_suppkey, max(l_extendedprice) AS s_acctbal FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 GROUP BY 1)
SELECT s.s_suppkey, s_name, coalesce(u.s_acctbal, s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN upd u USING (s_suppkey)""")
def overlay_update(spark, d):
    li = table(spark, d, "lineitem").filter("l_discount > 0.09 AND l_tax > 0.07")
    upd = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("s_acctbal"))
    return overlay(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), upd, "s_suppkey", ["s_acctbal"])


@query("P8", """SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey""")
def drop_empty_columns(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_quantity", F.when(F.col("l_quantity") < 0, 1.0).alias("empty"), F.lit(None).cast("string").alias("note")
    )
    kept = P.drop_empty_cols(li)
    sums = [F.sum(c).alias("qty") for c in kept.columns if c != "l_orderkey"]
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *sums)


@query("P9", f"""WITH {COMMUNITY} SELECT siteID, count(*) AS n, sum(cover) AS cover FROM community WHERE size IS NOT NULL GROUP BY siteID""")
def drop_incomplete_rows(spark, d):
    kept = P.drop_incomplete(community(spark, d), ["size", "cover"])
    return kept.groupBy("siteID").agg(F.count(F.lit(1)).alias("n"), F.sum("cover").alias("cover"))


@query("P10", f"""WITH {LOGGER} SELECT event_id, coalesce(value, 0) AS filled, NULLIF(logger, 'error') AS logger FROM logger""")
def replace_missing(spark, d):
    lg = logger(spark, d).fillna({"value": 0.0})
    return lg.select("event_id", F.col("value").alias("filled"), F.nullif(F.col("logger"), F.lit("error")).alias("logger"))


@query("P11", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("P12", f"""WITH {LOGGER} SELECT ID, logger, date, value FROM (
  SELECT *, row_number() OVER (PARTITION BY ID, logger ORDER BY date, event_id) AS rn FROM logger) t WHERE rn = 1""")
def first_row_per_key(spark, d):
    first = distinct_first(logger(spark, d).select("ID", "logger", "date", "event_id", "value"), ["ID", "logger"], ["date", "event_id"])
    return first.select("ID", "logger", "date", "value")


@query("P13", """SELECT CASE l_returnflag WHEN 'N' THEN 'Intact' WHEN 'A' THEN 'Gap' END AS Treatment,
CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 END AS Treatment_ord, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def ordered_categories(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("Treatment"))
    return P.categorize(li, "Treatment", ["N", "A"], ["Intact", "Gap"]).groupBy("Treatment", "Treatment_ord").agg(F.count(F.lit(1)).alias("n"))


@query("P14", f"""WITH {LOGGER} SELECT siteID, sum(CASE WHEN value > 300 THEN 300 ELSE value END) AS total_, count(*) AS n FROM (
SELECT siteID, round(value) AS value FROM logger) t GROUP BY siteID""")
def conditional_update(spark, d):
    lg = logger(spark, d).withColumn("value", F.round("value"))
    out = lg.withColumn("value", update_where(F.col("value") > 300, 300.0, "value"))
    return out.groupBy("siteID").agg(F.sum("value").alias("total_"), F.count(F.lit(1)).alias("n"))


@query("P15", """SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type FROM part""")
def same_function_over_columns(spark, d):
    cols = ["p_name", "p_brand", "p_type"]
    return P.across(table(spark, d, "part").select("p_partkey", *cols), cols, F.upper)


_PROBES = "CASE WHEN l_discount > 0.02 THEN l_quantity END AS m1, CASE WHEN l_tax > 0.04 THEN l_quantity * 2 END AS m2, CASE WHEN l_discount > 0.05 THEN l_tax END AS m3"


@query("P16", f"""SELECT l_suppkey, count(m) AS n, {rsql("sum(m)", 4)} AS mean_total, {rsql("sum(s)", 4)} AS sum_total FROM (
SELECT l_suppkey, (coalesce(m1, 0) + coalesce(m2, 0) + coalesce(m3, 0)) / NULLIF((m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT, 0) AS m,
  coalesce(m1, 0) + coalesce(m2, 0) + coalesce(m3, 0) AS s
FROM (SELECT l_suppkey, {_PROBES} FROM lineitem) a) b GROUP BY l_suppkey""")
def row_wise_mean_and_sum(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("m1"),
        F.when(F.col("l_tax") > 0.04, F.col("l_quantity") * 2).alias("m2"),
        F.when(F.col("l_discount") > 0.05, F.col("l_tax")).alias("m3"),
    )
    out = li.select("l_suppkey", row_mean("m1", "m2", "m3").alias("m"), row_sum("m1", "m2", "m3").alias("s"))
    return out.groupBy("l_suppkey").agg(F.count("m").alias("n"), r(F.sum("m"), 4).alias("mean_total"), r(F.sum("s"), 4).alias("sum_total"))


@query("P17", """SELECT coalesce(NULLIF(trim(CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE ' ' END), ''), l_linestatus) AS Treatment, count(*) AS n
FROM lineitem GROUP BY 1""")
def merge_partial_columns(spark, d):
    a = F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(" ")
    return table(spark, d, "lineitem").groupBy(coalesce_blank(a, "l_linestatus").alias("Treatment")).agg(F.count(F.lit(1)).alias("n"))


@query("P18", """SELECT o_orderstatus, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-07-01' AND DATE '1998-08-30' GROUP BY 1""")
def interval_predicate(spark, d):
    o = table(spark, d, "orders")
    lo, hi = P.time_bound(o, "o_orderdate", "1997-07-01"), P.time_bound(o, "o_orderdate", "1998-08-31")
    # On the timestamp itself, so the bounds reach the scan; the last day is whole.
    return o.filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("P19", f"""WITH {LOGGER} SELECT siteID AS site, logger, count(*) AS n, max(value) AS top FROM logger
WHERE date > TIMESTAMP '2024-01-05 00:00:00' AND date < TIMESTAMP '2024-01-20 00:00:00' AND siteID IN ('Fauske', 'Veskre')
AND logger NOT IN ('error', 'click') AND value < 100 GROUP BY ALL""")
def series_selection(spark, d):
    lg = logger(spark, d).withColumnRenamed("siteID", "site")
    out = P.select_series(lg, ["Fauske", "Veskre"], "2024-01-05", "2024-01-20", ["error", "click"], include=False, cap=100.0)
    return out.groupBy("site", "logger").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


# ---- joins ------------------------------------------------------------------------------------


@query("J1", f"""WITH {COMMUNITY}, {WEATHER} SELECT c.siteID, w.tempLevel, w.precipLevel, count(*) AS n, sum(cover) AS cover
FROM community c LEFT JOIN weather w ON c.siteID = w.siteID GROUP BY ALL""")
def left_join_named_keys(spark, d):
    w = weather(spark, d).withColumnRenamed("siteID", "site")
    out = r_join(community(spark, d), w, {"siteID": "site"}, "left")
    return out.groupBy("siteID", "tempLevel", "precipLevel").agg(F.count(F.lit(1)).alias("n"), F.sum("cover").alias("cover"))


@query("J2", f"""WITH {LOGGER}, {DAILY} SELECT l.siteID, CAST(l.date AS DATE) AS day, count(*) AS n, count(d.value) AS known
FROM (SELECT siteID, date, event_id FROM logger) l LEFT JOIN (SELECT siteID, date AS day, value FROM daily) d ON l.siteID = d.siteID AND CAST(l.date AS DATE) = d.day
GROUP BY ALL""")
def natural_left_join(spark, d):
    left = logger(spark, d).select("siteID", F.to_date("date").alias("day"), "event_id")
    right = daily(spark, d).select("siteID", F.col("date").alias("day"), "value")
    out = r_join(left, right, None, "left")
    return out.groupBy("siteID", "day").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))


@query("J3", """WITH a AS (SELECT CASE WHEN l_discount > 0.01 THEN l_suppkey END AS k, sum(l_quantity) AS qa FROM lineitem WHERE l_tax < 0.03 GROUP BY 1),
b AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, count(*) AS nb FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, qa, nb FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def full_join_missing_keys(spark, d):
    li = table(spark, d, "lineitem").filter("l_tax < 0.03")
    a = li.groupBy(F.when(F.col("l_discount") > 0.01, F.col("l_suppkey")).alias("k")).agg(F.sum("l_quantity").alias("qa"))
    b = table(spark, d, "orders").groupBy(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k")).agg(F.count(F.lit(1)).alias("nb"))
    return r_join(a, b, "k", "full")


@query("J4", """WITH c AS (SELECT o_custkey AS c_custkey, count(*) AS seed FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT cu.c_custkey, c_mktsegment, coalesce(seed, 0) AS seed FROM customer cu LEFT JOIN c USING (c_custkey)""")
def complete_with_zero(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    counts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("seed"))
    return complete_with(counts, table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], {"seed": 0})


@query("J5", f"""WITH {COMMUNITY} SELECT a.blockID, a.Treatment, count(*) AS both, sum(a.cover) AS before, sum(b.cover) AS after
FROM community a JOIN community b USING (siteID, blockID, Treatment, species) WHERE a.Year = 1996 AND b.Year = 2000 GROUP BY ALL""")
def species_in_both_years(spark, d):
    c = community(spark, d).select("siteID", "blockID", "Treatment", "species", "Year", "cover")
    a, b = c.filter("Year = 1996").drop("Year"), c.filter("Year = 2000").drop("Year")
    out = r_join(a, b, ["siteID", "blockID", "Treatment", "species"], "inner")
    return out.groupBy("blockID", "Treatment").agg(F.count(F.lit(1)).alias("both"), F.sum("cover").alias("before"), F.sum("cover_new").alias("after"))


@query("J6", """SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS Year, count(*) AS n FROM lineitem
WHERE (l_suppkey, year(l_shipdate)) IN (SELECT l_suppkey, year(l_shipdate) FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1) GROUP BY ALL""")
def semi_join_composite(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("Year"), "l_quantity", "l_discount")
    keys = li.filter("l_quantity = 50 AND l_discount = 0.1").select("l_suppkey", "Year").distinct()
    return semi(li, keys, ["l_suppkey", "Year"]).groupBy("l_suppkey", "Year").agg(F.count(F.lit(1)).alias("n"))


@query("J7", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998 AND o_orderstatus = 'F')""")
def anti_join_missing(spark, d):
    o = table(spark, d, "orders").filter((F.year("o_orderdate") == 1998) & (F.col("o_orderstatus") == "F"))
    return anti(table(spark, d, "customer").select("c_custkey", "c_name"), o, {"c_custkey": "o_custkey"})


@query("J13", f"""WITH {COMMUNITY}, turf AS (SELECT blockID || '_' || Treatment AS turfID, Treatment, blockID, siteID, Year AS year, species, cover FROM community)
SELECT siteID, temperature_level, recorder, count(*) AS n, CAST(sum(n_subturfs) AS BIGINT) AS subturfs, sum(cover) AS cover FROM (
  SELECT t.siteID, n_regionkey AS temperature_level, CASE WHEN t.year < 1998 THEN 'PM' ELSE 'Siri' END AS recorder, t.cover, s.n AS n_subturfs
  FROM turf t JOIN nation ON n_name = t.siteID LEFT JOIN (
    SELECT l_suppkey || '_' || l_returnflag AS turfID, CAST(year(l_shipdate) AS INTEGER) AS year, p_brand AS species, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) s USING (turfID, year, species)) x GROUP BY ALL""")
def community_star_join(spark, d):
    c = community(spark, d).withColumn("turfID", F.concat_ws("_", F.col("blockID").cast("string"), "Treatment"))
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sub = li.join(part, li.l_partkey == part.p_partkey).select(
        F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag").alias("turfID"), F.year("l_shipdate").alias("year"), F.col("p_brand").alias("species")
    )
    turfs = li.select("l_suppkey", "l_returnflag").distinct().select(
        F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag").alias("turfID"),
        F.col("l_returnflag").alias("TTtreat"),
        F.col("l_suppkey").alias("destinationPlotID"),
    )
    sup, nat = table(spark, d, "supplier"), table(spark, d, "nation")
    years = li.select("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year")).distinct()
    tables = {
        "subTurfCommunity": sub,
        "turfCommunity": c.select("turfID", F.col("Year").alias("year"), "species", "cover"),
        "taxon": part.groupBy(F.col("p_brand").alias("species")).agg(F.min("p_type").alias("family")),
        "turfs": turfs,
        "plots": sup.select(F.col("s_suppkey").alias("plotID"), F.col("s_suppkey").alias("blockID")),
        "blocks": sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(F.col("s_suppkey").alias("blockID"), F.col("n_name").alias("siteID")),
        "sites": nat.select(F.col("n_name").alias("siteID"), F.col("n_regionkey").alias("temperature_level")),
        "turfEnvironment": years.select(
            F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag").alias("turfID"), "year",
            F.when(F.col("year") < 1998, "PM").otherwise("Siri").alias("recorder"),
        ),
    }
    out = build_community(tables)
    return out.groupBy("siteID", "temperature_level", "recorder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_subturfs").alias("subturfs"), F.sum("cover").alias("cover")
    )


@query("J15", f"""WITH a AS (SELECT event_type, quantile_cont(value, 0.4) AS q40, quantile_cont(value, 0.5) AS q50, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_type, level, {rsql("q", 6)} AS q, {rsql("lo + (hi - lo) * i / 49", 6)} AS x
FROM a, unnest(['Alpine', 'Boreal']) AS t(level), unnest([q40, q50]) AS u(q), range(50) AS v(i)""")
def prediction_grid(spark, d):
    axes = table(spark, d, "events").groupBy("event_type").agg(
        F.percentile("value", F.array(F.lit(0.4), F.lit(0.5))).alias("qs"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    steps = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 49)
    g = grid(axes, {"level": F.array(F.lit("Alpine"), F.lit("Boreal")), "q": F.col("qs"), "x": steps})
    return g.select("event_type", "level", r("q").alias("q"), r("x").alias("x"))


# ---- sort, limit, sets ------------------------------------------------------------------------


@query("T1", f"""SELECT l_suppkey, l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL ORDER BY qty DESC, l_suppkey, l_returnflag""")
def sorted_summary(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("qty"))
    return s.orderBy(F.desc("qty"), "l_suppkey", "l_returnflag")


@query("T2", """SELECT p_brand, stat, CAST(row_number() OVER (ORDER BY stat, p_brand) AS INTEGER) AS p_brand_ord FROM (
SELECT p_brand, round(avg(p_size) + 1e-9, 6) AS stat FROM part GROUP BY p_brand) t""")
def reorder_by_statistic(spark, d):
    return reorder_levels(table(spark, d, "part"), "p_brand", r(F.avg("p_size")))


@query("T3", "SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 6")
def head_preview(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "value").orderBy(F.desc("value"), "event_id").limit(6)


@query("U1", """SELECT key, kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM (
SELECT l_suppkey AS key, l_returnflag AS kind, NULL AS amount FROM lineitem UNION ALL SELECT o_custkey, NULL, CAST(o_orderkey AS BIGINT) FROM orders) t GROUP BY key, kind""")
def union_by_name(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("kind"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("amount"))
    return S.union_all(a, b).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("U2", """SELECT source, key, count(*) AS n FROM (SELECT 'soil' AS source, event_type AS key FROM events
UNION ALL SELECT 'seed', o_orderpriority FROM orders) t GROUP BY ALL""")
def tagged_union(spark, d):
    a = table(spark, d, "events").select(F.col("event_type").alias("key"))
    b = table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"))
    return S.union_tagged({"soil": a, "seed": b}).groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))


@query("U3", f"""WITH {LOGGER}, {DAILY}, kept AS (SELECT * FROM daily WHERE NOT (siteID = 'Gudmedalen' AND date < DATE '2024-01-10'))
SELECT siteID, date, n FROM kept UNION ALL SELECT 'Gudmedalen', date, n FROM daily WHERE siteID = 'Lavisdalen' AND date < DATE '2024-01-10'""")
def substitute_site_rows(spark, d):
    early = F.col("date") < F.lit("2024-01-10").cast("date")
    out = S.substitute_rows(
        daily(spark, d), (F.col("siteID") == "Lavisdalen") & early, {"siteID": F.lit("Gudmedalen")}, (F.col("siteID") == "Gudmedalen") & early
    )
    return out.select("siteID", "date", "n")


@query("U4", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity < 30 AND l_discount > 0.08 AND l_tax > 0.07), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000)
SELECT k, 'a' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'b' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_coverage(spark, d):
    a = table(spark, d, "lineitem").filter("l_quantity < 30 AND l_discount > 0.08 AND l_tax > 0.07").select(F.col("l_suppkey").alias("k"))
    b = table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("k"))
    return S.key_diff(a, b, ["k"])


@query("U5", "SELECT DISTINCT user_id FROM events")
def unique_values(spark, d):
    return S.unique(table(spark, d, "events"), "user_id")


# ---- reshape ----------------------------------------------------------------------------------


@query("R-1", f"""WITH {CELLS}, long AS (SELECT siteID, blockID, Treatment, Year, unnest(['maxTemp', 'minTemp']) AS measure,
unnest([CASE WHEN maxTemp < 50 THEN maxTemp END, CASE WHEN minTemp > 1 THEN minTemp END]) AS value FROM cells)
SELECT * FROM long WHERE value IS NOT NULL""")
def wide_to_long(spark, d):
    c = cells(spark, d).select(
        "siteID", "blockID", "Treatment", "Year",
        F.when(F.col("maxTemp") < 50, F.col("maxTemp")).alias("maxTemp"), F.when(F.col("minTemp") > 1, F.col("minTemp")).alias("minTemp"),
    )
    return R.gather(c, "maxTemp:minTemp", "measure", "value", na_rm=True)


@query("R-2", f"""WITH {CELLS} SELECT siteID, blockID, Year, coalesce(max(CASE WHEN Treatment = 'A' THEN cover END), 0) AS A,
coalesce(max(CASE WHEN Treatment = 'N' THEN cover END), 0) AS N, coalesce(max(CASE WHEN Treatment = 'R' THEN cover END), 0) AS R
FROM cells GROUP BY siteID, blockID, Year""")
def long_to_wide(spark, d):
    return R.spread(cells(spark, d), ["siteID", "blockID", "Year"], "Treatment", "cover", ["A", "N", "R"], fill=0.0)


@query("R-3", f"""WITH {LOGGER}, {DAILY}, frame AS (SELECT * FROM (SELECT DISTINCT date FROM daily WHERE n > 1), unnest([{", ".join(f"'{s}'" for s in SITE_NAMES)}]) AS t(siteID))
SELECT f.siteID, f.date, d.n FROM frame f LEFT JOIN (SELECT * FROM daily WHERE n > 1) d USING (siteID, date)""")
def complete_key_grid(spark, d):
    days = daily(spark, d).filter("n > 1").select("siteID", "date", "n")
    return R.complete(days, "siteID", SITE_NAMES, ["date"])


@query("R-4", """SELECT split_part(k, '_', 1) AS siteID, split_part(k, '_', 2) AS block, k AS label, i, count(*) AS n FROM (
SELECT l_suppkey || '_' || l_returnflag AS k, l_returnflag || '.' || l_linestatus AS i FROM lineitem) t GROUP BY ALL""")
def split_and_glue_columns(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", R.interaction("l_returnflag", "l_linestatus").alias("i"))
    glued = R.unite(li, "label", ["l_suppkey", "l_returnflag"])
    return R.separate(glued, "label", ["siteID", "block"], remove=False).groupBy("siteID", "block", "label", "i").agg(F.count(F.lit(1)).alias("n"))


@query("R-5", """SELECT event_type, user_id, count(*) AS n, min(event_id) AS first_id, sum(round(value)) AS total_ FROM events GROUP BY event_type, user_id""")
def nest_and_unnest(spark, d):
    ev = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    nested = R.nest(ev, ["event_type"], ["event_id"], max_rows=500)
    flat = R.unnest(nested)
    return flat.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum(F.round("value")).alias("total_"))


# ---- scalar functions -------------------------------------------------------------------------


@query("F1", """SELECT p_partkey, substr(p_name, 1, 3) AS head, substr(p_name, 4) AS tail, CAST(length(p_name) AS INTEGER) AS len,
CAST(instr(p_name, ' ') AS INTEGER) AS blank FROM part""")
def substrings(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.substring(n, 1, 3).alias("head"), F.substr(n, F.lit(4)).alias("tail"), F.length(n).alias("len"), F.instr(n, " ").alias("blank")
    )


@query("F2", """SELECT s_suppkey, regexp_matches(s_name, '[5-9]$') AS ends_high, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits,
replace(replace(s_name, '#', '.'), '_', '.') AS dotted FROM supplier""")
def regular_expressions(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", n.rlike("[5-9]$").alias("ends_high"), digits_only(n).alias("digits"), species_code(F.translate(n, "#", "_")).alias("dotted")
    )


@query("F3", f"""WITH {LOGGER} SELECT event_id, left(siteID, 3) || coalesce(CAST(CASE WHEN value > 10 THEN ID END AS VARCHAR), 'NA') || logger AS turfID,
lower(siteID) AS lower_site, split_part(logger, 'i', 1) AS part FROM logger""")
def paste_and_split(spark, d):
    lg = logger(spark, d)
    return lg.select(
        "event_id",
        turf_key("siteID", F.when(F.col("value") > 10, F.col("ID")), "logger").alias("turfID"),
        F.lower("siteID").alias("lower_site"),
        F.split("logger", "i")[0].alias("part"),
    )


@query("F4", """SELECT event_id, date_trunc('second', ts) AS a, date_trunc('minute', ts) AS b, date_trunc('second', ts) AS c, CAST(ts AS DATE) AS d FROM events""")
def date_parsing(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id",
        D.ymd_hms(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("a"),
        D.dmy_hms(F.date_format(ts, "dd.MM.yyyy HH:mm")).alias("b"),
        D.mdy_hms(F.date_format(ts, "MM/dd/yy hh:mm:ss a")).alias("c"),
        D.dmy(F.date_format(ts, "dd-MM-yyyy")).alias("d"),
    )


@query("F5", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
CAST(hour(o_orderdate) AS INTEGER) AS h, DATE '2018-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS nominal, strftime(o_orderdate, '%Y-%m-%d') AS txt FROM orders""")
def date_parts(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofyear(t).alias("doy"), F.hour(t).alias("h"),
        D.nominal_date(F.dayofyear(t), 2018).alias("nominal"), F.date_format(t, "yyyy-MM-dd").alias("txt"),
    )


@query("F6", """SELECT CASE WHEN month(o_orderdate) <= 6 THEN 'spr' ELSE 'aut' END || '_' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS code,
CAST(2000 + year(o_orderdate) % 100 AS INTEGER) AS y, make_date(2000 + year(o_orderdate) % 100, CASE WHEN month(o_orderdate) <= 6 THEN 4 ELSE 9 END, 1) AS day,
count(*) AS n FROM orders GROUP BY ALL""")
def census_codes(spark, d):
    code = F.concat(F.when(F.month("o_orderdate") <= 6, "spr").otherwise("aut"), F.lit("_"), F.date_format("o_orderdate", "yy"))
    rows = table(spark, d, "orders").select(code.alias("code"))
    return rows.groupBy("code", D.census_year("code").alias("y"), D.census_date("code").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("F7", f"""SELECT event_id, {rsql("ln(value)")} AS l, {rsql("exp(value / 1000)")} AS e, {rsql("sqrt(value)")} AS s, {rsql("abs(value - 50)")} AS a,
{rsql("value / NULLIF(user_id, 0)")} AS q FROM events""")
def arithmetic(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", r(F.ln(v)).alias("l"), r(F.exp(v / 1000)).alias("e"), r(F.sqrt(v)).alias("s"), r(F.abs(v - 50)).alias("a"),
        r(F.try_divide(v, F.col("user_id"))).alias("q"),
    )


@query("F8", """SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN 0 WHEN event_type <> 'click' THEN round(value) END) AS total_ FROM events GROUP BY 1""")
def text_number_cleaning(spark, d):
    text = F.when(F.col("event_type") == "view", "u").when(F.col("event_type") == "click", "n/a").otherwise(F.concat(F.round("value").cast("int").cast("string"), F.lit(",0")))
    number = parse_number(F.regexp_replace(text, "u", "0"), ",")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total_"))


@query("F9 F3", """SELECT n_nationkey, replace(n_name, 'O', 'o') AS name, n_name || '_NA' AS pasted FROM nation""")
def encoding_clean_up(spark, d):
    stray = F.translate("n_name", "O", "ø")
    return table(spark, d, "nation").select("n_nationkey", strip_stray_bytes(stray).alias("name"), paste("n_name", F.lit(None).cast("string"), sep="_").alias("pasted"))
