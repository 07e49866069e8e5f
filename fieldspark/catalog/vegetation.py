"""Vegetation, biomass, seedling and trait work on the look-alike tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CELLS, COMMUNITY, SITE_NAMES, cells, community, r, rsql, table
from ..functions.missing import recode
from ..operators.joins import r_join
from ..plans import biomass as B
from ..plans import seedlings as SE
from ..plans import traits as T
from ..plans import vegetation as V
from ..sources.dictionaries import TURF_ALIASES, dictionaries
from .registry import query

# ---- composition ------------------------------------------------------------------------------


def _surveyed(spark, d):
    """Covers with recorder and total vascular cover per plot and year."""
    c = community(spark, d).select("siteID", "blockID", "Treatment", "Year", "species", "cover")
    plot = c.groupBy("blockID", "Treatment", "Year").agg((F.count(F.lit(1)) * 25.0).alias("totalVascular"))
    out = r_join(c, plot, ["blockID", "Treatment", "Year"])
    recorder = F.when(F.col("Year") < 1997, "PM").when(F.col("Year") < 1999, "Siri").when(F.col("Year") < 2001, "Owen")
    return out.withColumns({"recorder": F.coalesce(recorder, F.lit("unknown botanist")), "turfID": F.concat_ws("_", F.col("blockID").cast("string"), "Treatment")})


@query("C1", f"""WITH {COMMUNITY}, p AS (SELECT *, sum(cover) OVER w AS s, count(*) OVER w * 25.0 AS tv FROM community WINDOW w AS (PARTITION BY blockID, Treatment, Year))
SELECT blockID, Treatment, Year, species, {rsql("CASE WHEN Year < 1997 THEN cover * 1.2 WHEN Year < 1999 AND s / tv < 1.35 THEN cover * 1.3 WHEN Year BETWEEN 1999 AND 2000 AND s / tv > 1.5 THEN cover / 1.5 ELSE cover END")} AS cover FROM p""")
def observer_bias_correction(spark, d):
    out = V.correct_observer_bias(_surveyed(spark, d))
    return out.select("blockID", "Treatment", "Year", "species", r("cover").alias("cover"))


@query("C2", f"""WITH {CELLS} SELECT blockID, Treatment, Year, CASE WHEN Year IN (1995, 1997) THEN maxTemp * 10 ELSE maxTemp END AS height,
{rsql("cover / 0.0625", 4)} AS biomass FROM cells""")
def unit_harmonisation(spark, d):
    c = cells(spark, d).withColumnRenamed("maxTemp", "height")
    out = V.harmonise_units(c, ["height"], "Year", [1995, 1997], 10.0)
    return out.select("blockID", "Treatment", "Year", "height", r(B.per_area("cover"), 4).alias("biomass"))


_SURVEY = f"""{COMMUNITY}, survey AS (SELECT siteID, blockID, Treatment, blockID || '_' || Treatment AS turfID, Year, species, CASE WHEN cover >= 12 THEN cover END AS cover FROM community),
idx AS (SELECT turfID, Year, row_number() OVER (PARTITION BY turfID ORDER BY Year) AS i FROM (SELECT DISTINCT turfID, Year FROM survey)),
s AS (SELECT survey.*, i FROM survey JOIN idx USING (turfID, Year))"""


def _gappy(spark, d):
    c = community(spark, d)
    return c.select(
        "siteID", "blockID", "Treatment", F.concat_ws("_", F.col("blockID").cast("string"), "Treatment").alias("turfID"), "Year", "species",
        F.when(F.col("cover") >= 12, F.col("cover")).alias("cover"), F.lit(1).alias("presence"),
    )


@query("C3 W2 W7 P7", f"""WITH {_SURVEY}, a AS (SELECT g.turfID, g.species, g.Year, avg(k.cover) AS cover FROM s g JOIN s k ON g.turfID = k.turfID AND g.species = k.species AND abs(g.i - k.i) = 1
  WHERE g.cover IS NULL AND k.cover IS NOT NULL GROUP BY ALL HAVING count(*) = 2),
b AS (SELECT siteID, species, Year, avg(cover) AS cover FROM s GROUP BY ALL)
SELECT s.turfID, s.species, s.Year, {rsql("CASE WHEN s.cover IS NULL THEN coalesce(b.cover, a.cover) ELSE s.cover END")} AS cover FROM s
LEFT JOIN a USING (turfID, species, Year) LEFT JOIN b ON s.siteID = b.siteID AND s.species = b.species AND s.Year = b.Year
WHERE coalesce(s.cover, b.cover, a.cover) IS NOT NULL""")
def missing_cover_imputation(spark, d):
    out = V.impute_missing_cover(_gappy(spark, d))
    return out.select("turfID", "species", "Year", r("cover").alias("cover"))


@query("C3 J10 W7", f"""WITH {CELLS}, p AS (SELECT siteID, blockID, Treatment, Year, CASE WHEN cover >= 700 THEN cover END AS tot, row_number() OVER (PARTITION BY blockID, Treatment ORDER BY Year) AS i FROM cells)
SELECT g.blockID, g.Treatment, g.Year, {rsql("avg(k.tot)")} AS total_cover FROM p g JOIN p k ON g.blockID = k.blockID AND g.Treatment = k.Treatment AND abs(g.i - k.i) = 1
WHERE g.tot IS NULL AND g.Treatment IN ('A', 'N') AND k.tot IS NOT NULL GROUP BY ALL HAVING count(*) = 2""")
def group_cover_imputation(spark, d):
    c = cells(spark, d).select(
        "siteID", "blockID", "Treatment", F.concat_ws("_", F.col("blockID").cast("string"), "Treatment").alias("turfID"), "Year",
        F.when(F.col("cover") >= 700, F.col("cover")).alias("total_cover"),
    )
    out = V.impute_group_cover(c, "total_cover", ["A", "N"])
    return out.select("blockID", "Treatment", "Year", r("total_cover").alias("total_cover"))


_GROUPS = "CASE WHEN {0} IN ('Phl.sp', 'Brand#1') THEN 'graminoid' WHEN {0} = 'Brand#2' THEN 'forb' WHEN {1} IN ('PROMO', 'STANDARD') THEN 'forb' ELSE lower({1}) END"


@query("C4", f"""WITH g AS (SELECT p_brand, max(p_type) AS t FROM part WHERE p_size < 40 GROUP BY 1)
SELECT p_brand AS species, {_GROUPS.format("p_brand", "t")} AS functionalGroup, count(*) AS n, sum(l_quantity) AS cover
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN g USING (p_brand) GROUP BY 1, 2""")
def functional_groups(spark, d):
    part = table(spark, d, "part")
    kind = recode(F.max("p_type"), {"PROMO": "pteridophyte", "STANDARD": "woody plant"})
    groups = part.filter("p_size < 40").groupBy(F.col("p_brand").alias("species")).agg(F.lower(kind).alias("functionalGroup"))
    li = table(spark, d, "lineitem")
    rows = li.join(part, li.l_partkey == part.p_partkey).select(F.col("p_brand").alias("species"), "l_quantity")
    out = V.classify_groups(rows, groups, graminoids=[*V.GRAMINOID_NAMES, "Brand#1"], forbs=[*V.FORB_NAMES, "Brand#2"])
    return out.groupBy("species", "functionalGroup").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("cover"))


def _with_totals(spark, d):
    c = community(spark, d).withColumn("functionalGroup", recode("functionalGroup", {"ECONOMY": "graminoid", "LARGE": "forb"}))
    late = F.col("Year") >= 1999
    return c.select(
        "blockID", "Treatment", F.concat_ws("_", F.col("blockID").cast("string"), "Treatment").alias("turfID"), "Year", "species", "functionalGroup", "cover",
        F.when(late, 60.0).alias("totalGraminoids"), F.when(~late, 40.0).alias("totalForbs"),
    )


@query("C5", f"""WITH {COMMUNITY}, t AS (SELECT blockID, Treatment, Year, species, sum(CASE WHEN functionalGroup = 'ECONOMY' THEN cover END) OVER w AS g, sum(CASE WHEN functionalGroup = 'LARGE' THEN cover END) OVER w AS f
FROM community WINDOW w AS (PARTITION BY blockID, Treatment, Year))
SELECT blockID, Treatment, Year, species, CASE WHEN Year >= 1999 THEN 60.0 ELSE g END::DOUBLE AS totalGraminoids, CASE WHEN Year < 1999 THEN 40.0 ELSE f END::DOUBLE AS totalForbs FROM t""")
def group_cover_backfill(spark, d):
    out = V.backfill_group_cover(_with_totals(spark, d), {"graminoid": "totalGraminoids", "forb": "totalForbs"})
    return out.select("blockID", "Treatment", "Year", "species", "totalGraminoids", "totalForbs")


def _removals(c):
    return c.withColumn("Treatment", recode("Treatment", {"A": "FB", "N": "C", "R": "G"}))


_TR = "CASE Treatment WHEN 'A' THEN 'FB' WHEN 'N' THEN 'C' ELSE 'G' END"


@query("C6", f"""WITH {CELLS} SELECT blockID, {_TR} AS Treatment, Year, CASE WHEN Treatment = 'A' THEN 0 ELSE cover END AS forbCov,
CASE WHEN Treatment <> 'R' THEN maxTemp END AS graminoidCov, CASE WHEN Treatment = 'A' THEN 0 ELSE minTemp END AS mossCov FROM cells""")
def removal_masking(spark, d):
    c = _removals(cells(spark, d)).withColumnsRenamed({"cover": "forbCov", "maxTemp": "graminoidCov", "minTemp": "mossCov"})
    zero = V.mask_removed(c, {"F": "forbCov", "B": "mossCov"}, to=0.0)
    out = V.mask_removed(zero, {"G": "graminoidCov"}, to=None)
    return out.select("blockID", "Treatment", "Year", "forbCov", "graminoidCov", "mossCov")


@query("C6", f"""WITH {COMMUNITY} SELECT {_TR} AS Treatment, functionalGroup, count(*) AS n FROM (
SELECT Treatment, CASE functionalGroup WHEN 'ECONOMY' THEN 'graminoid' WHEN 'LARGE' THEN 'forb' WHEN 'SMALL' THEN NULL ELSE functionalGroup END AS functionalGroup FROM community) t
WHERE (Treatment = 'N') OR (Treatment = 'A' AND functionalGroup NOT IN ('forb', 'bryophyte')) OR (Treatment = 'R' AND functionalGroup <> 'graminoid') GROUP BY ALL""")
def removed_species_rows(spark, d):
    c = _removals(community(spark, d)).withColumn("functionalGroup", recode("functionalGroup", {"ECONOMY": "graminoid", "LARGE": "forb"}))
    c = c.withColumn("functionalGroup", F.when(F.col("functionalGroup") != "SMALL", F.col("functionalGroup")))
    return V.drop_removed_rows(c).groupBy("Treatment", "functionalGroup").agg(F.count(F.lit(1)).alias("n"))


@query("C7", f"""WITH {CELLS} SELECT CASE Treatment WHEN 'A' THEN 'G' WHEN 'N' THEN 'Intact' ELSE 'FB' END AS Treatment, count(*) AS n, sum(cover) AS cover FROM cells GROUP BY 1""")
def remaining_group_treatments(spark, d):
    c = _removals(cells(spark, d))
    return c.groupBy(V.remaining_groups("Treatment").alias("Treatment")).agg(F.count(F.lit(1)).alias("n"), F.sum("cover").alias("cover"))


@query("C8", f"""WITH {COMMUNITY}, t AS (SELECT *, blockID || '_' || Treatment AS turfID FROM community),
fix AS (SELECT turfID, Year, species AS old, 'Brand#26' AS "new", CASE WHEN cover > 60 THEN cover / 2 END AS c FROM t WHERE price > 1000 AND cover > 55)
SELECT CASE coalesce("new", species) WHEN 'Brand#3' THEN 'Brand#26' WHEN 'Brand#26' THEN 'Brand#27' ELSE coalesce("new", species) END AS species, count(*) AS n, sum(coalesce(c, cover)) AS cover
FROM t LEFT JOIN fix ON t.turfID = fix.turfID AND t.Year = fix.Year AND species = old GROUP BY 1""")
def species_name_correction(spark, d):
    c = community(spark, d).withColumn("turfID", F.concat_ws("_", F.col("blockID").cast("string"), "Treatment"))
    by_plot = c.filter("price > 1000 AND cover > 55").select(
        "Year", "turfID", "siteID", F.col("species").alias("old"), F.lit("Brand#26").alias("new"), F.when(F.col("cover") > 60, F.col("cover") / 2).alias("cover")
    )
    by_name = spark.createDataFrame([("Brand#3", "Brand#26"), ("Brand#26", "Brand#27")], "old string, new string")
    out = V.correct_species(c.select("Year", "turfID", "siteID", "species", "cover"), by_plot, by_name)
    return out.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.sum("cover").alias("cover"))


@query("C9 F2", f"""WITH alias(o, n) AS (VALUES {", ".join(str(a) for a in TURF_ALIASES)}), t AS (SELECT CAST(c_custkey AS VARCHAR) || ' TTC' AS turfID, c_nationkey, c_mktsegment FROM customer)
SELECT CASE WHEN coalesce(n, turfID) = 'Fau1C' THEN 'Fau9C' ELSE coalesce(n, turfID) END AS turfID,
  CASE WHEN c_nationkey = 16 THEN '5' ELSE CAST(c_nationkey AS VARCHAR) END AS blockID, c_mktsegment FROM t LEFT JOIN alias ON turfID = o""")
def turf_key_repair(spark, d):
    cu = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(" TTC")).alias("turfID"), F.col("c_nationkey").cast("string").alias("blockID"), "c_mktsegment")
    out = V.apply_aliases(cu, dictionaries(spark)["turf_aliases"])
    return V.repair_keys(out, [
        (F.col("turfID") == "Fau1C", {"turfID": F.lit("Fau9C")}),
        (F.col("blockID") == "16", {"blockID": F.regexp_replace(F.col("blockID"), "16", "5")}),
    ])


@query("C22", f"""WITH {CELLS}, t AS (SELECT blockID, {_TR} AS Treatment, Year, unnest(['forbCov', 'graminoidCov', 'mossCov']) AS functionalGroup, unnest([cover, maxTemp, minTemp]) AS cover FROM cells)
SELECT blockID, Treatment, Year, functionalGroup, cover * CASE WHEN (contains(Treatment, 'F') AND functionalGroup = 'forbCov') OR (contains(Treatment, 'G') AND functionalGroup = 'graminoidCov') OR (contains(Treatment, 'B') AND functionalGroup = 'mossCov') THEN 1 ELSE -1 END AS deltaCov FROM t""")
def signed_cover_change(spark, d):
    from ..operators.reshape import gather

    c = _removals(cells(spark, d)).select("blockID", "Treatment", "Year", F.col("cover").alias("forbCov"), F.col("maxTemp").alias("graminoidCov"), F.col("minTemp").alias("mossCov"))
    long = gather(c, "forbCov:mossCov", "functionalGroup", "cover")
    return long.select("blockID", "Treatment", "Year", "functionalGroup", V.signed_cover().alias("deltaCov"))


# ---- biomass ----------------------------------------------------------------------------------

_PLOTS = f"""{CELLS}, plots AS (SELECT blockID, Year, max(CASE WHEN Treatment = 'A' THEN cover END) AS forbCov, max(CASE WHEN Treatment = 'R' THEN cover END) AS graminoidCov, max(maxTemp) AS height,
  max(CASE WHEN Treatment = 'A' THEN n END) AS nf, max(CASE WHEN Treatment = 'R' THEN n END) AS ng FROM cells GROUP BY ALL),
v AS (SELECT blockID, Year, unnest(['forb', 'graminoid']) AS functionalGroup, unnest([forbCov * height, graminoidCov * height]) AS volume, unnest([nf, ng]) / 0.0625 AS y FROM plots),
slopes AS (SELECT functionalGroup, sum(volume * y) / sum(volume * volume) AS slope FROM v WHERE volume IS NOT NULL AND y IS NOT NULL GROUP BY 1)"""


@query("C18 M1", f"""WITH {_PLOTS} SELECT blockID, Year, functionalGroup, {rsql("volume * slope", 5)} AS biomass FROM v JOIN slopes USING (functionalGroup)""")
def biomass_from_cover(spark, d):
    c = cells(spark, d)
    pick = lambda t, col: F.max(F.when(F.col("Treatment") == t, F.col(col)))
    plots = c.groupBy("blockID", "Year").agg(pick("A", "cover").alias("forbCov"), pick("R", "cover").alias("graminoidCov"), F.max("maxTemp").alias("height"))
    harvest = c.filter("Treatment <> 'N'").select("blockID", "Year", recode("Treatment", {"A": "forb", "R": "graminoid"}).alias("functionalGroup"), F.col("n").alias("Biomass"))
    _, predicted = B.biomass_model(harvest, plots, {"forb": ("forbCov", "height"), "graminoid": ("graminoidCov", "height")}, ["blockID", "Year"])
    return predicted.withColumn("biomass", r("biomass", 5))


# ---- seedlings --------------------------------------------------------------------------------

_CENSUSES = [f"{s}_{y:02d}" for y in (95, 96, 97, 98, 99, 0, 1) for s in ("spr", "aut")]
_SITES = "list_extract([" + ", ".join(f"'{s}'" for s in SITE_NAMES) + "], CAST(o_custkey % 12 + 1 AS INTEGER))"
_HISTORY = f"""WITH k AS (SELECT o_custkey AS c, o_orderpriority AS sp, (year(o_orderdate) - 1995) * 2 + (month(o_orderdate) > 6)::INT AS s,
  CASE max(o_orderstatus) WHEN 'O' THEN 1 ELSE 0 END AS alive FROM orders GROUP BY ALL),
keys AS (SELECT DISTINCT c, sp FROM k), g AS (SELECT keys.c, keys.sp, r.s, k.alive FROM keys CROSS JOIN range(14) r(s) LEFT JOIN k ON k.c = keys.c AND k.sp = keys.sp AND k.s = r.s),
e AS (SELECT *, coalesce(sum(alive) OVER (PARTITION BY c, sp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS seen FROM g)"""


@query("C17 F6", f"""{_HISTORY} SELECT left({_SITES.replace("o_custkey", "c")}, 3) || c || 'RTC' AS turfID, CAST(2000 + CASE WHEN s < 10 THEN s // 2 + 95 ELSE s // 2 - 5 END AS INTEGER) AS year,
CASE WHEN s % 2 = 0 THEN 'spr' ELSE 'aut' END AS monthN, CAST(sum(CASE WHEN seen THEN 0 ELSE alive END) AS DOUBLE) AS seed FROM e WHERE alive IS NOT NULL OR seen GROUP BY ALL""")
def seedling_census_history(spark, d):
    o = table(spark, d, "orders")
    code = F.concat(F.when(F.month("o_orderdate") <= 6, "spr").otherwise("aut"), F.lit("_"), F.date_format("o_orderdate", "yy"))
    names = F.array(*[F.lit(s) for s in SITE_NAMES])
    rows = o.groupBy("o_custkey", "o_orderpriority", code.alias("season")).agg(F.max("o_orderstatus").alias("status"))
    rows = rows.select(
        F.element_at(names, (F.col("o_custkey") % 12 + 1).cast("int")).alias("siteID"), F.col("o_custkey").alias("blockID"), F.lit("RTC").alias("Treatment"),
        F.col("o_custkey").alias("ID"), F.col("o_orderpriority").alias("species"), "season", recode("status", {"O": "Seedling", "F": "Dead", "P": "? gone"}).alias("seed"),
    )
    return SE.census_history(rows, _CENSUSES).select("turfID", "year", "monthN", "seed")


@query("C17 J4 A1", """WITH c AS (SELECT o_custkey, count(*) AS seed FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey AS turfID, c_mktsegment AS Treatment, coalesce(seed, 0) AS seed FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def seedling_abundance(spark, d):
    seeds = table(spark, d, "orders").filter("o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'").select(F.col("o_custkey").alias("turfID"))
    frame = table(spark, d, "customer").select(F.col("c_custkey").alias("turfID"), F.col("c_mktsegment").alias("Treatment"))
    return SE.abundance(seeds, frame, ["turfID"]).select("turfID", "Treatment", "seed")


@query("C17 A15", f"""WITH c AS (SELECT o_custkey, count(*) AS tot, CAST(sum(CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END) AS DOUBLE) AS totS FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1)
SELECT c_custkey AS turfID, coalesce(tot, 0) AS tot, coalesce(totS, 0) AS totS, {rsql("coalesce(100 * totS / tot, 0)")} AS survival FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def seedling_survival(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
    seeds = o.select(F.col("o_custkey").alias("turfID"), recode("o_orderstatus", {"F": "dead", "O": "alive"}, "null").alias("survival"))
    frame = table(spark, d, "customer").select(F.col("c_custkey").alias("turfID"))
    return SE.survival(seeds, frame, ["turfID"]).withColumn("survival", r("survival"))


# ---- traits -----------------------------------------------------------------------------------

_FLAGS = """z AS (SELECT l_partkey AS species, list_extract(['Nem', 'BNem', 'SBor', 'MBor', 'LAlp', 'MAlp', 'HAlp'], l_linenumber) AS zone, CAST((max(l_quantity) > 25)::INT AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
w AS (SELECT species, sum(v) AS abundance, max(CASE WHEN zone = 'Nem' THEN v END) AS nem, max(CASE WHEN zone = 'BNem' THEN v END) AS bnem, max(CASE WHEN zone = 'SBor' THEN v END) AS sbor,
  max(CASE WHEN zone = 'LAlp' THEN v END) AS lalp, max(CASE WHEN zone = 'MAlp' THEN v END) AS malp, max(CASE WHEN zone = 'HAlp' THEN v END) AS halp FROM z GROUP BY species)"""


@query("C19", f"""WITH {_FLAGS} SELECT species, abundance, CASE WHEN nem = 0 AND bnem = 0 AND sbor = 0 AND lalp = 1 THEN 'alpine'
WHEN halp = 0 AND malp = 0 AND lalp = 0 AND nem = 1 THEN 'lowland' WHEN abundance >= 5.5 THEN 'generalist' WHEN abundance < 5.5 THEN 'other' END AS specialism FROM w""")
def species_specialism(spark, d):
    zones = F.array(*[F.lit(z) for z in ("Nem", "BNem", "SBor", "MBor", "LAlp", "MAlp", "HAlp")])
    flags = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("species"), F.element_at(zones, F.col("l_linenumber")).alias("trait")).agg(
        (F.max("l_quantity") > 25).cast("double").alias("value")
    )
    return T.specialism(flags)


def _trait(part_sql: str, name: str) -> str:
    return f"(SELECT n_name AS siteID, replace(p_name, ' ', '.') AS species, {part_sql} AS {name} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"


@query("C20 J3", f"""WITH a AS {_trait("avg(l_discount)", "SLA")} WHERE l_linestatus = 'O' AND l_tax < 0.02 GROUP BY ALL), b AS {_trait("avg(l_tax)", "LDMC")} WHERE l_linestatus = 'F' AND l_discount < 0.03 GROUP BY ALL),
c AS {_trait("avg(l_quantity / 20)", "logLA")} GROUP BY ALL)
SELECT coalesce(a.siteID, b.siteID, c.siteID) AS siteID, coalesce(a.species, b.species, c.species) AS species, {rsql("SLA")} AS SLA, {rsql("LDMC")} AS LDMC, {rsql("sqrt(exp(logLA))")} AS sqrtLA,
coalesce(a.siteID, b.siteID, c.siteID) || '_' || coalesce(a.species, b.species, c.species) AS speciesID FROM a FULL JOIN b USING (siteID, species) FULL JOIN c ON c.siteID = coalesce(a.siteID, b.siteID) AND c.species = coalesce(a.species, b.species)""")
def trait_table(spark, d):
    li, sup, nat, part = (table(spark, d, n) for n in ("lineitem", "supplier", "nation", "part"))
    base = li.join(sup, li.l_suppkey == sup.s_suppkey).join(nat, sup.s_nationkey == nat.n_nationkey).join(part, li.l_partkey == part.p_partkey)
    one = lambda rows, e: rows.groupBy(F.col("n_name").alias("Site"), F.col("p_name").alias("Species")).agg(F.avg(e).alias("predictValue"))
    parts = {
        "SLA": one(base.filter("l_linestatus = 'O' AND l_tax < 0.02"), F.col("l_discount")),
        "LDMC": one(base.filter("l_linestatus = 'F' AND l_discount < 0.03"), F.col("l_tax")),
        "logLA": one(base, F.col("l_quantity") / 20),
    }
    out = T.trait_table(parts)
    return out.select("siteID", "species", r("SLA").alias("SLA"), r("LDMC").alias("LDMC"), r("sqrtLA").alias("sqrtLA"), "speciesID")


@query("C21 J5 J11", f"""WITH {COMMUNITY}, k AS (SELECT * FROM community c WHERE Year IN (1996, 2000) AND (SELECT count(DISTINCT Year) FROM community e WHERE e.blockID = c.blockID AND e.Treatment = c.Treatment AND e.species = c.species AND e.Year IN (1996, 2000)) = 2),
g AS (SELECT blockID, Treatment, Year, count(DISTINCT species) AS richness, ln(sum(cover)) - sum(cover * ln(cover)) / sum(cover) AS h, sum(cover) AS sumcover, sum(size * cover) / NULLIF(sum(CASE WHEN size IS NOT NULL THEN cover END), 0) AS m FROM k GROUP BY ALL)
SELECT a.blockID, a.Treatment, a.Year, a.richness, {rsql("a.h - b.h")} AS delta_diversity, a.sumcover - b.sumcover AS delta_sumcover, {rsql("a.m - b.m")} AS delta_wmean_size
FROM g a LEFT JOIN g b ON a.blockID = b.blockID AND a.Treatment = b.Treatment AND b.Year = 1996""")
def species_turnover(spark, d):
    c = community(spark, d).select("blockID", "Treatment", "Year", "species", "cover", "size")
    out = T.turnover(c, ["blockID", "Treatment"], "Year", 1996, 2000, ["size"])
    return out.select(
        "blockID", "Treatment", "Year", "richness", r("delta_diversity").alias("delta_diversity"), "delta_sumcover", r("delta_wmean_size").alias("delta_wmean_size")
    )
