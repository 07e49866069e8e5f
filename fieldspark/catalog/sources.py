"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import CELLS, LOGGER, SITE_NAMES, cells, logger, r, rsql, table
from ..functions.text import site_from_name
from ..operators.joins import baseline_delta, r_join
from ..operators.projection import time_bound
from ..session import ensure_checkpoint_dir
from ..sources import loggers as L
from ..sources.delimited import decimal_comma, read_delim, read_parts
from ..sources.dictionaries import SITES, dictionaries
from ..sources.grid import grid_subset
from ..sources.log_files import channel_readings, scan_log_lines, two_column_readings
from ..sources.tables import load, load_tables, replace_parts, save, save_bucketed, write_result_csv
from .registry import query


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("S2 F8", f"""SELECT l_returnflag, count(*) AS n, {rsql("sum(l_extendedprice)", 2)} AS total FROM lineitem GROUP BY l_returnflag""")
def read_decimal_comma_text(spark, d):
    text = table(spark, d, "lineitem").select(
        "l_returnflag", F.replace(F.format_string("%.2f", F.col("l_extendedprice")), F.lit("."), F.lit(",")).alias("price")
    )
    return decimal_comma(text, ["price"]).groupBy("l_returnflag").agg(F.count("price").alias("n"), r(F.sum("price"), 2).alias("total"))


@query("S4 F3", f"""WITH {LOGGER}
SELECT siteID, CAST(year(date) AS VARCHAR) AS Year, CAST(ID AS VARCHAR) AS loggerID, CAST(ID AS VARCHAR) || '_' || CAST(year(date) AS VARCHAR) AS ID,
       count(*) AS n FROM logger GROUP BY ALL""")
def path_keys(spark, d):
    paths = logger(spark, d).select(
        F.concat_ws("/", F.lit("/data/loggers"), F.year("date").cast("string"), "siteID", F.concat(F.col("ID").cast("string"), F.lit(".txt"))).alias("path")
    )
    keyed = L.with_path_keys(paths, {"siteID": -2, "Year": -3})
    return keyed.groupBy("siteID", "Year", "loggerID", "ID").agg(F.count(F.lit(1)).alias("n"))


@query("S5 F4", f"""SELECT event_id, date_trunc('second', ts) AS date, 'C' AS unit, {rsql("value", 2)} AS value FROM events""")
def button_log_lines(spark, d):
    text = F.split(F.format_string("%.2f", F.col("value")), r"\.")
    line = F.concat_ws(",", F.date_format("ts", "dd.MM.yy HH:mm:ss"), F.lit("C"), text[0], text[1])
    lines = table(spark, d, "events").select("event_id", F.lit("a/2024/Fauske/1.txt").alias("path"), F.lit(0).alias("line_no"), line.alias("line"))
    out = L.parse_button_lines(lines)
    return out.select("event_id", "date", "unit", r("value", 2).alias("value"))


@query("S6 P10 F9", f"""SELECT event_id, date_trunc('minute', ts) AS date, x.logger AS logger, x.value AS value
FROM (SELECT event_id, ts, unnest([{{'logger': 'temp30cm', 'value': {rsql("value", 2)}}},
  {{'logger': 'uvb', 'value': CASE WHEN event_type <> 'error' THEN {rsql("value * 2", 2)} END}}]) AS x FROM events)""")
def channel_log_lines(spark, d):
    second = F.when(F.col("event_type") == "error", "#-INF").otherwise(F.replace(F.format_string("%.2f", F.col("value") * 2), F.lit("."), F.lit(",")))
    first = F.replace(F.format_string("%.2f", F.col("value")), F.lit("."), F.lit(","))
    lines = table(spark, d, "events").select(
        "event_id",
        F.lit("Label\tTemp-30cm\tUVB").alias("first_line"),
        F.lit(2).alias("line_no"),
        F.concat_ws("\t", F.date_format("ts", "dd.MM.yyyy HH:mm"), first, second).alias("line"),
    )
    out = L.parse_channel_lines(lines)
    return out.select("event_id", "date", "logger", r("value", 2).alias("value"))


@query("S7", f"""WITH {LOGGER}
SELECT event_id, date_trunc('second', l.date) AS date, {rsql("e.value", 2)} AS value,
       CASE WHEN l.ID % 2 = 0 THEN 'temp200cm' ELSE 'temp30cm' END AS logger, lower(left(siteID, 3)) AS site
FROM logger l JOIN events e USING (event_id)""")
def two_channel_log_lines(spark, d):
    names = F.array(*[F.lit(s) for s in SITE_NAMES])
    ev = table(spark, d, "events").withColumn("site", F.element_at(names, (F.col("user_id") % 12 + 1).cast("int")))
    value = F.replace(F.format_string("%.2f", F.col("value")), F.lit("."), F.lit(","))
    lines = ev.select(
        "event_id",
        F.concat_ws("/", F.lit("/data"), "site", F.lit("UTL"), F.lit("1.txt")).alias("path"),
        F.when(F.col("event_type") == "view", " ").otherwise(F.col("site")).alias("site_header"),
        F.when(F.col("user_id") % 2 == 0, "200 cm").otherwise("30 cm").alias("depth_header"),
        F.lit(0).alias("line_no"),
        F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), value).alias("line"),
    )
    out = L.parse_two_column_lines(lines)
    return out.select("event_id", "date", r("value", 2).alias("value"), "logger", "site")


@query("S8", f"""WITH {LOGGER} SELECT lower(left(siteID, 3)) AS site, count(*) AS n FROM logger GROUP BY 1""")
def site_code_from_name(spark, d):
    names = logger(spark, d).select(F.concat(F.lit("#00"), F.col("ID").cast("string"), F.lit("_"), F.col("siteID"), F.lit(".txt")).alias("file"))
    return names.groupBy(site_from_name("file").alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query("S9", """SELECT o_orderstatus, count(*) AS n, max(o_orderdate) AS last FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_orderstatus""")
def load_source_tables(spark, d):
    orders = load_tables(spark, d, ["orders", "customer"])["orders"]
    recent = orders.filter(F.col("o_orderdate") >= time_bound(orders, "o_orderdate", "1998-01-01"))
    return recent.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))


_NESTED = """SELECT r_name, n_name, c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS Year, count(*) AS n
FROM ((region INNER JOIN nation ON r_regionkey = n_regionkey) INNER JOIN customer ON n_nationkey = c_nationkey)
INNER JOIN orders ON c_custkey = o_custkey
GROUP BY r_name, n_name, c_mktsegment, CAST(year(o_orderdate) AS INTEGER)
HAVING CAST(year(o_orderdate) AS INTEGER) > 1997"""


@query("S10", _NESTED)
def sql_nested_join(spark, d):
    frames = load_tables(spark, d, ["region", "nation", "customer", "orders"])
    return spark.sql(
        """SELECT r_name, n_name, c_mktsegment, year(o_orderdate) AS Year, count(*) AS n
        FROM (({region} INNER JOIN {nation} ON r_regionkey = n_regionkey) INNER JOIN {customer} ON n_nationkey = c_nationkey)
        INNER JOIN {orders} ON c_custkey = o_custkey
        GROUP BY r_name, n_name, c_mktsegment, year(o_orderdate)
        HAVING year(o_orderdate) > 1997""",
        **frames,
    )


@query("S10 T1", """SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey
GROUP BY n_name ORDER BY n_name""")
def sql_left_join_ordered(spark, d):
    frames = load_tables(spark, d, ["nation", "customer"])
    return spark.sql(
        """SELECT n_name, count(c_custkey) AS customers FROM {nation} LEFT JOIN {customer} ON n_nationkey = c_nationkey
        GROUP BY n_name ORDER BY n_name""",
        **frames,
    )


@query("S11 U1", """SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, o_orderstatus, count(*) AS n,
round(sum(o_totalprice) + 1e-9, 2) AS biomass FROM orders GROUP BY ALL""")
def read_multi_part(spark, d):
    orders = table(spark, d, "orders").select(F.year("o_orderdate").alias("Year"), "o_orderstatus", F.col("o_totalprice").alias("Biomass"), "o_orderpriority")
    text = orders.filter("o_orderstatus = 'O'").withColumn("Biomass", F.format_string("%.2f", F.col("Biomass")))
    rest = orders.filter("o_orderstatus <> 'O'").drop("o_orderpriority")
    parts = read_parts([text, rest], {"Biomass": "double"}, drop=["o_orderpriority"])
    return parts.groupBy("Year", "o_orderstatus").agg(F.count("Biomass").alias("n"), r(F.sum("Biomass"), 2).alias("biomass"))


@query("S12", """SELECT CAST(year(l_shipdate) AS INTEGER) AS Year, l_returnflag, sum(l_quantity) AS cover FROM lineitem
WHERE year(l_shipdate) >= 1999 GROUP BY ALL""")
def save_and_load(spark, d):
    yearly = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("Year"), "l_returnflag").agg(F.sum("l_quantity").alias("cover"))
    path = _scratch(spark, "saved")
    save(yearly, path, ["Year"])
    back = load(spark, path, "l_returnflag string, cover double, Year int").filter("Year >= 1999")
    return back.select("Year", "l_returnflag", "cover")


@query("S1 S13", """SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY ALL""")
def csv_round_trip(spark, d):
    counts = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    path = _scratch(spark, "result-csv")
    write_result_csv(counts, path, sep=";")
    return read_delim(spark, path, ";", ["event_type", "user_id", "n"]).withColumn("n", F.col("n").try_cast("bigint"))


@query("S14", f"""WITH {LOGGER}, sites(old, v2, v3, "new") AS (VALUES {", ".join(str(s) for s in SITES)})
SELECT v2, v3, old, count(*) AS n FROM logger JOIN sites ON siteID = "new" GROUP BY ALL""")
def site_dictionary(spark, d):
    sites = dictionaries(spark)["sites"]
    return r_join(logger(spark, d), sites, {"siteID": "new"}, "inner").groupBy("v2", "v3", "old").agg(F.count(F.lit(1)).alias("n"))


@query("S15", """SELECT lon, lat, DATE '1900-01-01' + CAST(time AS INTEGER) AS date, count(*) AS n, sum(value) AS total FROM (
  SELECT l_discount * 100 AS lon, l_tax * 100 AS lat, date_diff('day', DATE '1900-01-01', CAST(l_shipdate AS DATE)) AS time,
         NULLIF(l_quantity, 50) AS value FROM lineitem) c
WHERE lon BETWEEN 1.5 AND 6.5 AND lat BETWEEN 0.5 AND 4.5 GROUP BY ALL""")
def grid_cube_subset(spark, d):
    cube = table(spark, d, "lineitem").select(
        (F.col("l_discount") * 100).alias("lon"),
        (F.col("l_tax") * 100).alias("lat"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1900-01-01").cast("date")).alias("time"),
        F.col("l_quantity").alias("value"),
    )
    cut = grid_subset(cube, (1.5, 6.5, 0.5, 4.5), 50.0, "1900-01-01")
    return cut.groupBy("lon", "lat", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _event_files(spark, d):
    """Events as logger files: one folder per user, of the multi-channel kind for even users, else of the two-channel kind."""
    number = lambda c: F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))
    ev = table(spark, d, "events").withColumn("even", F.col("user_id") % 2 == 0)
    second = F.when(F.col("event_type") == "error", "#-INF").otherwise(number(F.col("value") * 2))
    multi = F.concat_ws("\t", F.date_format("ts", "dd.MM.yyyy HH:mm"), number(F.col("value")), second)
    two = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), number(F.col("value")))
    body = ev.select("user_id", F.col("event_id").alias("n"), F.when(F.col("even"), multi).otherwise(two).alias("line"))
    depth = F.when(F.col("user_id") % 4 == 1, "30 cm").otherwise("200 cm")
    header = F.when(
        F.col("even"), F.array(F.lit("Label\tTemp-30cm\tUVB"), F.lit("Unit\tC\tmV"))
    ).otherwise(F.array(F.lit("Version 1"), F.lit("Serial\t1239"), F.lit("Site\tVeskre"), F.concat(F.lit("Depth\t"), depth), F.lit(""), F.lit("Sample")))
    heads = ev.select("user_id", "even").distinct().select("user_id", F.posexplode(header).alias("n", "line")).withColumn("n", F.col("n") - 100)
    rows = body.unionByName(heads).withColumn("folder", F.concat(F.lit("Ves "), "user_id")).drop("user_id")
    root = _scratch(spark, "loggers")
    rows.repartition("folder").sortWithinPartitions("folder", "n").select("folder", "line").write.partitionBy("folder").option("lineSep", "\n").text(root)
    return root


@query("S3 S6 S7", f"""WITH x AS (
  SELECT user_id AS ID, 'ITAS' AS type, date_trunc('minute', ts) AS date, c.logger AS logger, c.value AS value
  FROM (SELECT *, unnest([{{'logger': 'temp30cm', 'value': {rsql("value", 2)}}}, {{'logger': 'uvb', 'value': CASE WHEN event_type <> 'error' THEN {rsql("value * 2", 2)} END}}]) AS c FROM events WHERE user_id % 2 = 0)
  UNION ALL
  SELECT user_id, 'UTL', date_trunc('second', ts), CASE WHEN user_id % 4 = 1 THEN 'temp30cm' ELSE 'temp200cm' END, {rsql("value", 2)} FROM events WHERE user_id % 2 = 1)
SELECT ID, type, logger, count(*) AS n, count(value) AS n_value, {rsql("sum(value)", 2)} AS total, min(date) AS first, max(date) AS last FROM x GROUP BY ALL""")
def scan_logger_files(spark, d):
    lines = scan_log_lines(spark, _event_files(spark, d), include=("txt",), encoding="ISO-8859-1")
    multi, two = channel_readings(lines).withColumn("type", F.lit("ITAS")), two_column_readings(lines).withColumn("type", F.lit("UTL")).drop("site")
    readings = multi.unionByName(two).withColumn("ID", F.regexp_extract("path", r"folder=Ves (\d+)/", 1).cast("long"))
    return readings.groupBy("ID", "type", "logger").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), r(F.sum("value"), 2).alias("total"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query("S12 J11", f"""WITH {CELLS}, t AS (SELECT siteID || '-' || blockID || '-' || Treatment AS turfID, Year, CASE WHEN Year = 1996 THEN 2 * cover ELSE cover END AS cover FROM cells)
SELECT t.turfID, t.Year, {rsql("t.cover", 2)} AS cover, {rsql("t.cover - b.cover", 2)} AS delta_cover FROM t LEFT JOIN (SELECT * FROM t WHERE Year = 1995) b USING (turfID)""")
def change_in_saved_turfs(spark, d):
    """Turfs are saved by their key and by year, one year is written anew, and the change since a baseline is read off without a shuffle."""
    turf = F.concat_ws("-", "siteID", F.col("blockID").cast("string"), "Treatment")
    rows = cells(spark, d).select(turf.alias("turfID"), F.col("cover").cast("double").alias("cover"), "Year")
    name = f"turfs_{uuid.uuid4().hex}"
    save_bucketed(rows, name, ["turfID"], 8, _scratch(spark, "turfs"), ["Year"])
    replace_parts(rows.filter("Year = 1996").withColumn("cover", 2 * F.col("cover")), name, ["turfID"], 8)
    out = baseline_delta(spark.table(name), ["turfID"], "Year", 1995, ["cover"], na_matches=False)
    return out.select("turfID", "Year", r("cover", 2).alias("cover"), r("delta_cover", 2).alias("delta_cover"))
