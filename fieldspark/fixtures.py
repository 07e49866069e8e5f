"""Field-data look-alikes derived from a star schema of orders and an event table.

Every view is a plan over the whole given tables, so work on it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.dictionaries import SITES
from .sources.tables import load_tables

SITE_NAMES = [s[3] for s in SITES]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_tables(spark, sf_dir, [name])[name]


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the offset keeps exact decimal ties from depending on the engine."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double") + F.lit(1e-9), digits)


def community(spark: SparkSession, d: str) -> DataFrame:
    """Covers per site, block, treatment, year and species. Promotional parts have no size."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sup, nat = table(spark, d, "supplier"), table(spark, d, "nation")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(sup, li.l_suppkey == sup.s_suppkey)
        .join(nat, sup.s_nationkey == nat.n_nationkey)
        .groupBy(
            F.col("n_name").alias("siteID"),
            F.col("s_suppkey").alias("blockID"),
            F.col("l_returnflag").alias("Treatment"),
            F.year("l_shipdate").alias("Year"),
            F.col("p_brand").alias("species"),
        )
        .agg(
            F.min("p_type").alias("functionalGroup"),
            F.sum("l_quantity").alias("cover"),
            F.avg(F.when(F.col("p_type") != "PROMO", F.col("p_size"))).alias("size"),
            F.avg("p_retailprice").alias("price"),
        )
    )


COMMUNITY = """community AS (
  SELECT n_name AS siteID, s_suppkey AS blockID, l_returnflag AS Treatment, CAST(year(l_shipdate) AS INTEGER) AS Year,
         p_brand AS species, min(p_type) AS functionalGroup, sum(l_quantity) AS cover,
         avg(CASE WHEN p_type <> 'PROMO' THEN p_size END) AS size, avg(p_retailprice) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Plot values per site, block, treatment and year."""
    li, sup, nat = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    per_block = li.groupBy("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("Year")).agg(
        F.sum("l_quantity").alias("cover"), F.max("l_quantity").alias("maxTemp"), F.min("l_quantity").alias("minTemp"), F.count(F.lit(1)).alias("n")
    )
    return (
        per_block.join(sup, per_block.l_suppkey == sup.s_suppkey)
        .join(nat, sup.s_nationkey == nat.n_nationkey)
        .select(F.col("n_name").alias("siteID"), F.col("s_suppkey").alias("blockID"), F.col("l_returnflag").alias("Treatment"), "Year", "cover", "maxTemp", "minTemp", "n")
    )


CELLS = """cells AS (
  SELECT n_name AS siteID, s_suppkey AS blockID, l_returnflag AS Treatment, CAST(year(l_shipdate) AS INTEGER) AS Year,
         sum(l_quantity) AS cover, max(l_quantity) AS maxTemp, min(l_quantity) AS minTemp, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


def weather(spark: SparkSession, d: str) -> DataFrame:
    """Climate levels per site."""
    return table(spark, d, "nation").select(
        F.col("n_name").alias("siteID"),
        (F.lit(6.5) + F.col("n_regionkey") * 1.0).alias("tempLevel"),
        F.element_at(F.array(*[F.lit(v) for v in (600.0, 1200.0, 2000.0, 2700.0)]), F.col("n_nationkey") % 4 + 1).alias("precipLevel"),
    )


WEATHER = """weather AS (
  SELECT n_name AS siteID, CAST(6.5 AS DOUBLE) + n_regionkey * CAST(1.0 AS DOUBLE) AS tempLevel,
         CAST(CASE n_nationkey % 4 WHEN 0 THEN 600 WHEN 1 THEN 1200 WHEN 2 THEN 2000 ELSE 2700 END AS DOUBLE) AS precipLevel
  FROM nation)"""


def logger(spark: SparkSession, d: str) -> DataFrame:
    """Readings per logger and channel; values below the detection limit of 1 are missing."""
    names = F.array(*[F.lit(s) for s in SITE_NAMES])
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("ID"),
        F.element_at(names, (F.col("user_id") % 12 + 1).cast("int")).alias("siteID"),
        F.col("event_type").alias("logger"),
        F.col("ts").alias("date"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
    )


LOGGER = (
    "logger AS (SELECT event_id, user_id AS ID, list_extract(["
    + ", ".join(f"'{s}'" for s in SITE_NAMES)
    + "], CAST(user_id % 12 + 1 AS INTEGER)) AS siteID, event_type AS logger, ts AS date, "
    "CASE WHEN value >= 1 THEN value END AS value FROM events)"
)


def deployment(spark: SparkSession, d: str) -> DataFrame:
    """Placement and removal of each logger: three days inside its first and last reading."""
    return (
        table(spark, d, "events")
        .groupBy(F.col("user_id").alias("ID"))
        .agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("placed"), (F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("removed"))
    )


DEPLOYMENT = """deployment AS (
  SELECT user_id AS ID, min(ts) + INTERVAL 3 DAY AS placed, max(ts) - INTERVAL 3 DAY AS removed FROM events GROUP BY user_id)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Mean per site and day, missing when a reading of the day is missing."""
    from .functions.aggregates import r_mean

    return logger(spark, d).groupBy("siteID", F.to_date("date").alias("date")).agg(r_mean("value").alias("value"), F.count(F.lit(1)).alias("n"))


DAILY = """daily AS (
  SELECT siteID, CAST(date AS DATE) AS date, CASE WHEN count(*) = count(value) THEN avg(value) END AS value, count(*) AS n
  FROM logger GROUP BY ALL)"""


def census(spark: SparkSession, d: str) -> DataFrame:
    """Seedling status per turf, six half-year censuses from 1996 on."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    season = F.concat(F.when(F.month("o_orderdate") <= 6, "spr").otherwise("aut"), F.lit("_"), F.date_format("o_orderdate", "yy"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            F.col("c_custkey").alias("turfID"),
            F.col("c_mktsegment").alias("Treatment"),
            F.col("o_orderkey").alias("ID"),
            F.col("o_orderpriority").alias("species"),
            season.alias("season"),
            F.to_date("o_orderdate").alias("Date"),
            F.col("o_orderstatus").alias("status"),
        )
    )


CENSUS = """census AS (
  SELECT c_custkey AS turfID, c_mktsegment AS Treatment, o_orderkey AS ID, o_orderpriority AS species,
         CASE WHEN month(o_orderdate) <= 6 THEN 'spr' ELSE 'aut' END || '_' || strftime(o_orderdate, '%y') AS season,
         CAST(o_orderdate AS DATE) AS Date, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def draws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("param"), (F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("draw"), "value")


DRAWS = "draws AS (SELECT event_type AS param, user_id % 4 AS chain, event_id AS draw, value FROM events)"


def traits_long(spark: SparkSession, d: str) -> DataFrame:
    """One row per vector and axis."""
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("label"), F.posexplode("embedding").alias("axis", "value")
    ).withColumn("value", F.col("value").cast("double"))


def rsql(expr: str, digits: int = 6) -> str:
    """The SQL form of :func:`r`."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, {digits})"
