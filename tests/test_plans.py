"""Field pipelines on small tables with planted errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldspark.plans import biomass as B
from fieldspark.plans import climate as C
from fieldspark.plans import loggers as L
from fieldspark.plans import microclimate as MC
from fieldspark.plans import moisture as MO
from fieldspark.plans import seedlings as SE
from fieldspark.plans import traits as T
from fieldspark.plans import vegetation as V
from fieldspark.sources.dictionaries import dictionaries

from .conftest import rows


def test_observer_rules(spark):
    data = [
        ("a", 1, "PM", 10.0, 10.0), ("b", 1, "Siri", 12.0, 10.0), ("c", 1, "Siri", 14.0, 10.0), ("d", 1, "Owen", 14.0, 10.0), ("e", 1, "Owen", 16.0, 10.0),
        ("f", 1, "Siri", 12.0, 10.0), ("f", 1, None, 5.0, 10.0), ("g", 1, "Siri", None, 10.0), ("g", 1, "Siri", 1.0, 10.0), ("h", 1, "Siri", 12.0, None),
        # both recorders at one turf: the first factor counts in the second comparison
        ("i", 1, "Siri", 10.0, 10.0), ("i", 1, "Owen", 13.0, 10.0),
    ]
    df = spark.createDataFrame(data, "turfID string, Year int, recorder string, cover double, totalVascular double")
    got = [(r[0], r[1], None if r[2] is None else round(r[2], 6)) for r in rows(V.correct_observer_bias(df), "turfID", "recorder", "cover")]
    assert got == [
        ("a", "PM", 12.0), ("b", "Siri", 15.6), ("c", "Siri", 14.0), ("d", "Owen", 14.0), ("e", "Owen", round(16 / 1.5, 6)), ("f", "Siri", 15.6), ("f", None, 6.5),
        ("g", "Siri", 1.0), ("g", "Siri", None), ("h", "Siri", 12.0), ("i", "Owen", round(13 * 1.3 / 1.5, 6)), ("i", "Siri", round(13 / 1.5, 6))]


SURVEY = "siteID string, blockID string, Treatment string, turfID string, Year int, species string, cover double, presence int"


def survey(spark, data):
    return spark.createDataFrame([("s", "1", tr, t, y, sp, c, p) for tr, t, y, sp, c, p in data], SURVEY)


def test_imputation_precedence(spark):
    df = survey(spark, [
        # both neighbours and a site mean: the site mean wins
        ("C", "t1", 2015, "a", 2.0, 1), ("C", "t1", 2016, "a", None, 1), ("C", "t1", 2017, "a", 4.0, 1), ("C", "t2", 2016, "a", 9.0, 1),
        # neighbours only; the middle year was sampled, so the neighbours are 2015 and 2017
        ("C", "t1", 2015, "b", 2.0, 1), ("C", "t1", 2016, "b", None, 1), ("C", "t1", 2017, "b", 4.0, 1),
        # one neighbour only: dropped
        ("C", "t1", 2015, "c", 2.0, 1), ("C", "t1", 2016, "c", None, 1),
        # not recorded as present: dropped
        ("C", "t2", 2016, "d", None, None),
        # excluded treatment takes no site mean
        ("XC", "t3", 2016, "a", None, 1),
    ])
    got = rows(V.impute_missing_cover(df), "turfID", "species", "Year", "cover")
    assert ("t1", "a", 2016, 9.0) in got and ("t1", "b", 2016, 3.0) in got
    assert len(got) == 8 and all(c is not None for *_, c in got)
    assert not [g for g in got if g[0] == "t3" or g[1] == "d"]


def test_group_cover_needs_both_neighbours(spark):
    data = [("s", "1", "C", "t", 2015, 10.0), ("s", "1", "C", "t", 2016, None), ("s", "1", "C", "t", 2018, 20.0), ("s", "1", "G", "u", 2015, 10.0), ("s", "1", "G", "u", 2016, None)]
    df = spark.createDataFrame(data, "siteID string, blockID string, Treatment string, turfID string, Year int, tot double")
    assert rows(V.impute_group_cover(df, "tot", ["C", "G"]), "turfID", "Year", "tot") == [("t", 2016, 15.0)]


def test_groups_and_removals(spark):
    df = spark.createDataFrame([("x",), ("y",), ("Luz.tri",), ("Porub",), ("z",)], "species string")
    groups = spark.createDataFrame([("x", "woody"), ("y", "pteridophyte"), ("Luz.tri", "forb")], "species string, functionalGroup string")
    assert rows(V.classify_groups(df, groups), "species", "functionalGroup") == [("Luz.tri", "graminoid"), ("Porub", "forb"), ("x", "forb"), ("y", "forb"), ("z", None)]
    cov = spark.createDataFrame([("FGB", 1.0, 2.0, 3.0), ("C", 1.0, 2.0, 3.0), ("GF", 1.0, 2.0, 3.0)], "Treatment string, forbCov double, graminoidCov double, mossCov double")
    assert rows(V.mask_removed(cov)) == [("C", 1.0, 2.0, 3.0), ("FGB", 0.0, 0.0, 0.0), ("GF", 0.0, 0.0, 3.0)]
    assert rows(V.mask_removed(cov, to=None))[1] == ("FGB", None, None, None)
    sp = spark.createDataFrame([("F", "forb"), ("F", "graminoid"), ("C", None), ("F", None)], "Treatment string, functionalGroup string")
    assert rows(V.drop_removed_rows(sp)) == [("C", None), ("F", "graminoid")]


def test_backfill(spark):
    data = [("t", 1, "graminoid", 3.0, None, 8.0), ("t", 1, "graminoid", 4.0, None, 8.0), ("t", 1, "forb", 5.0, None, None)]
    df = spark.createDataFrame(data, "turfID string, Year int, functionalGroup string, cover double, totalGraminoids double, totalForbs double")
    totals = {"graminoid": "totalGraminoids", "forb": "totalForbs"}
    assert {tuple(r) for r in V.backfill_group_cover(df, totals).select("totalGraminoids", "totalForbs").collect()} == {(7.0, 8.0), (7.0, 5.0)}
    own = V.backfill_group_cover(df, totals, match_group=False)
    assert own.filter("functionalGroup = 'forb'").select("totalGraminoids", "totalForbs").first() == (5.0, 5.0)


def test_species_and_key_repair(spark):
    df = spark.createDataFrame([(2015, "t", "s", "old", 1.0), (2016, "t", "s", "old", 2.0), (2015, "t", "s", "odd", 3.0)], "Year int, turfID string, siteID string, species string, cover double")
    plot = spark.createDataFrame([(2015, "t", "s", "old", "odd", 9.0)], "Year int, turfID string, siteID string, old string, new string, cover double")
    name = spark.createDataFrame([("odd", "new")], "old string, new string")
    assert rows(V.correct_species(df, plot, name), "Year", "species", "cover") == [(2015, "new", 3.0), (2015, "new", 9.0), (2016, "old", 2.0)]
    turfs = spark.createDataFrame([("51 TTC", "Fauske", "2"), ("Lav1G ", "Lavisdalen", "16x"), ("abcd", "Gudmedalen", "3")], "turfID string, siteID string, blockID string")
    got = V.repair_keys(V.apply_aliases(turfs, dictionaries(spark)["turf_aliases"]), [(F.col("turfID") == "Lav1G ", {"turfID": "Lav1G"})])
    assert rows(got.select("turfID", V.block_number("blockID"))) == [("Fau1C", "2"), ("Lav1G", "16"), ("abcd", "3")]
    names = spark.createDataFrame([("Xyz1C", "Lavisdalen"), ("511 TTC", "Gudmedalen")], "turfID string, siteID string")
    assert rows(names.select(V.prefix_turf())) == [("Gud511 TTC",), ("Lav1C",)]


def test_units_and_signs(spark):
    df = spark.createDataFrame([(2015, 1.0), (2016, 1.0), (None, 1.0)], "Year int, h double")
    assert rows(V.harmonise_units(df, ["h"], "Year", [2015], 10.0)) == [(2015, 10.0), (2016, 1.0), (None, 1.0)]
    c = spark.createDataFrame([("FB", "forbCov", 2.0), ("FB", "graminoidCov", 2.0), ("C", "forbCov", 2.0), ("C", "other", 2.0), ("G", "other", 2.0)], "Treatment string, functionalGroup string, cover double")
    assert [r[0] for r in c.select(V.signed_cover()).collect()] == [2.0, -2.0, -2.0, 2.0, None]


def day(n, h=0):
    return dt.datetime(2016, 1, 1) + dt.timedelta(days=n, hours=h)


def test_logger_quality_control(spark):
    dic = spark.createDataFrame(
        [("a_2016", "s", "1", "C", None, day(1), day(20)), ("b_2016", "s", "2", "C", "FAIL", None, None), ("c_2016", "s", "3", "C", "fine", None, None),
         ("d_2016", "s", "E5", "C", None, None, None), ("e_2016", "s", None, "GB", None, None, None), ("f_2018", "s", "4", "C", None, day(5), day(6))],
        "ID string, siteID string, Block string, Treatment string, Comments string, ReplacementDate timestamp, RemovalDate timestamp")
    vals = [("a_2016", 0, 5.0), ("a_2016", 1, 5.0), ("a_2016", 2, 15.0), ("a_2016", 3, 16.0), ("a_2016", 4, 27.0), ("a_2016", 5, 12.0), ("a_2016", 20, 12.0), ("a_2016", 21, 12.0),
            ("b_2016", 1, 5.0), ("b_2016", 2, 5.0), ("c_2016", 1, 5.0), ("c_2016", 99, 5.0), ("d_2016", 1, 5.0), ("d_2016", 2, 5.0),
            ("e_2016", 1, 5.0), ("e_2016", 2, 40.0), ("e_2016", 3, 30.0), ("e_2016", 4, -20.0), ("e_2016", 5, None), ("e_2016", 6, 1.0), ("e_2016", 7, 2.0), ("f_2018", 1, 1.0), ("f_2018", 2, 1.0)]
    readings = spark.createDataFrame([(i, "s", day(d), v) for i, d, v in vals], "ID string, siteID string, Date timestamp, Value double")
    got = L.quality_control(L.clean_ids(readings), L.usable_dictionary(dic), "2016-03-01 00:00:00", exclude=[(F.col("Value") == 12.0) & (F.col("Date") > F.lit(day(10)))])
    kept = rows(got.select("ID", F.datediff("Date", F.lit("2016-01-01").cast("date")).alias("d"), "turfID"))
    # a: first reading dropped, jump of exactly 10 dropped, jump of 11 dropped, fall kept, last excluded by rule
    assert kept == [("a_2016", 3, "s1C"), ("a_2016", 5, "s1C"), ("e_2016", 3, "sNAGB"), ("e_2016", 7, "sNAGB"), ("f_2018", 2, "s4C")]


def test_weather_boundaries(spark):
    df = spark.createDataFrame([(0.67,), (0.66,), (0.33,), (0.1,), (None,)], "s double")
    assert [r[0] for r in df.select(C.weather_class("s")).collect()] == ["sunny", "variable", None, "cloudy", None]
    t = spark.createDataFrame([(8.9,), (9.0,), (10.5,), (10.6,), (None,)], "t double")
    assert [r[0] for r in t.select(C.temperature_level("t")).collect()] == [6.5, 8.5, 8.5, 10.5, None]


def test_climate_zones_with_normals(spark):
    m = spark.createDataFrame([("Fauske", dt.date(2010, 7, 1), 11.0), ("Fauske", dt.date(2010, 1, 1), -9.0), ("Fauske", dt.date(2001, 7, 1), 99.0)], "siteID string, date date, value double")
    p = spark.createDataFrame([("Fauske", dt.date(2010, 1, d), 2.0) for d in (1, 2, 3)] + [("Fauske", dt.date(2011, 1, 1), 10.0), ("Lavisdalen", dt.date(2011, 1, 1), 1.0)], "siteID string, date date, Precipitation double")
    got = {r["siteID"]: r for r in C.climate_zones(m, p, dictionaries(spark)["site_normals"]).collect()}
    assert (got["Fauske"]["temp0916"], got["Fauske"]["tempLevel"], got["Fauske"]["precipLevel"]) == (11.0, 10.5, 600.0)
    assert got["Fauske"]["precip0916"] == (3 * 6 + 10) / 4
    assert got["Lavisdalen"]["tempLevel"] is None


def test_contrast_and_microclimate(spark):
    df = spark.createDataFrame([("b", 1, "FGB", 20.0), ("b", 1, "GF", 17.0), ("b", 2, "GF", 9.0)], "blockID string, date int, Treatment string, maxTemp double")
    assert rows(MC.treatment_contrast(df, ["blockID", "date"], "FGB", ["GF"], "maxTemp"), "date", "maxTemp_delta") == [(1, -3.0), (2, None)]
    days = spark.createDataFrame([(dt.date(2015, 8, 1),), (dt.date(2016, 6, 30),), (dt.date(2016, 7, 1),)], "date date")
    assert MC.frost_window(days, "2015-08-01", "2016-06-30").count() == 2


def test_moisture(spark):
    first = spark.createDataFrame([("d", "t1", "C", None, "10", "20"), ("d", "t1", "C", "fewer readings", "30", None), ("d", "t1", "C", "raining", "99", "99"), ("d", "t2 RTC", "C", None, "1", "1"), ("d", "t3", None, None, "1", "1"), ("d", "t4", "XC", None, "1", "1")],
        "date string, turfID string, treatment string, comments string, M1 string, M2 string")
    assert rows(MO.pooled_moisture(first, ["M1", "M2"]), "turfID", "SM") == [("t1", 20.0), ("t1", 20.0)]
    second = spark.createDataFrame([("a", "u", "4"), ("b", None, None)], "turfID string, p1 string, p2 string")
    assert rows(MO.probe_moisture(second, ["p1", "p2"])) == [("a", 2.0), ("b", None)]
    sm = spark.createDataFrame([("51 TTC", 1.0), ("999 TTC", 2.0), ("Lav1G", 3.0)], "turfID string, SM double")
    assert rows(MO.map_controls(sm, dictionaries(spark)["turf_aliases"])) == [("Fau1C", 1.0), ("Lav1G", 3.0)]


def test_biomass_slope(spark):
    plots = spark.createDataFrame([("p1", 2.0, 10.0, 1.0), ("p2", 4.0, 10.0, None), ("p3", 1.0, 5.0, 1.0)], "plot string, forbCov double, h double, gramCov double")
    harvest = spark.createDataFrame([("p1", "forb", 1.0), ("p2", "forb", 2.0)], "plot string, functionalGroup string, Biomass double")
    slopes, pred = B.biomass_model(harvest, plots, {"forb": ("forbCov", "h"), "graminoid": ("gramCov", "h")}, ["plot"])
    assert slopes.filter("functionalGroup = 'forb'").first()["slope"] == pytest.approx(1 / 0.0625 / 20)
    assert [r[2] if r[2] is None else round(r[2], 6) for r in rows(pred)][:2] == [16.0, None] and rows(pred)[4][2] == pytest.approx(4.0)
    raw = spark.createDataFrame([(2015, "s", 1, "C", "B", 1, 2.0), (2015, "s", 1, "C", "B", 1, None), (2015, "s", 1, "C", "B", 2, 9.0), (2015, "s", 1, "RTC", "B", 1, 9.0)],
        "Year int, siteID string, Block int, Treatment string, Removed_FG string, Round int, Biomass double")
    assert [r["Biomass"] for r in B.clean_biomass(raw).collect()] == [2.0]


CENSUS = "siteID string, blockID int, Treatment string, ID string, species string, season string, seed string"


def census(spark, entries):
    return spark.createDataFrame([("Lavisdalen", 1, "RTC", i, "Leo.aut", s, v) for i, s, v in entries], CENSUS)


def test_census_counts_each_seedling_once(spark):
    df = census(spark, [("1", "aut_09", "S"), ("1", "spr_10", "s"), ("1", "aut_10", "H"), ("2", "spr_10", "Seen"), ("3", "spr_11", "?"), ("3", "spr_12", "E"), ("4", "spr_12", "Q"), (None, "aut_09", "S")])
    got = {(r["year"], r["monthN"]): r["seed"] for r in SE.census_history(df).collect()}
    assert got == {(2009, "aut"): 1.0, (2010, "spr"): 1.0, (2010, "aut"): 0.0, (2011, "spr"): 0.0, (2011, "aut"): 0.0, (2012, "spr"): 1.0}
    literal = {(r["year"], r["monthN"]): r["seed"] for r in SE.census_history(df, literal=True).collect()}
    assert literal[(2010, "spr")] == 0.0 and literal[(2012, "spr")] == 1.0


def test_graminoid_names(spark):
    df = spark.createDataFrame([("G",), ("Ave fle",), ("Agr cap",), ("Leo aut.cf",), (None,)], "species string")
    assert rows(SE.without_graminoids(df)) == [("Leo.aut",), (None,)]


def test_abundance_and_survival(spark):
    seed = spark.createDataFrame([("a", "dezd"), ("a", None), ("a", "not found"), ("b", "alive"), ("d", "what")], "turfID string, survival string")
    frame = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "turfID string")
    assert rows(SE.abundance(seed, frame, ["turfID"])) == [("a", 3), ("b", 1), ("c", 0), ("d", 1)]
    got = rows(SE.survival(seed, frame, ["turfID"]), "turfID", "tot", "totS", "survival")
    assert got[0][:3] == ("a", 3, 1.0) and got[0][3] == pytest.approx(100 / 3)
    assert got[1:] == [("b", 1, 1.0, 100.0), ("c", 0, 0.0, 0.0), ("d", 1, 0.0, 0.0)]


def test_specialism(spark):
    z = {"alp": {"LAlp": 1, "MAlp": 1}, "low": {"Nem": 1, "BNem": 1}, "gen": {k: 1 for k in T.ZONES}, "oth": {"MBor": 1}}
    data = [(s, k, float(v.get(k, 0))) for s, v in z.items() for k in T.ZONES]
    got = dict(rows(T.specialism(spark.createDataFrame(data, "species string, trait string, value double")), "species", "specialism"))
    assert got == {"alp": "alpine", "low": "lowland", "gen": "generalist", "oth": "other"}


def test_traits_join_on_key_not_position(spark):
    a = spark.createDataFrame([("Lav", "Ach_mil", 1.0), ("Lav", "Ver_alp", 2.0)], "Site string, Species string, predictValue double")
    b = spark.createDataFrame([("Lav", "Ver_alp", 4.0), ("Lav", "Ach_mil", 3.0), ("Gud", "Ach_mil", 0.0)], "Site string, Species string, predictValue double")
    got = T.trait_table({"SLA": a, "logLA": b})
    assert rows(got, "siteID", "species", "SLA", "sqrtLA") == [("Gud", "Ach.mil", None, 1.0), ("Lav", "Ach.mil", 1.0, pytest.approx(4.4816890, 1e-6))]
    assert "speciesID" in got.columns


def test_turnover_uses_shared_species(spark):
    df = spark.createDataFrame([("t", 1, "a", 1.0), ("t", 1, "gone", 9.0), ("t", 2, "a", 3.0), ("t", 2, "new", 9.0), ("t", 3, "a", 7.0)], "turf string, y int, species string, cover double")
    assert rows(T.turnover(df, ["turf"], "y", 1, 2), "y", "sumcover", "delta_sumcover") == [(1, 1.0, 0.0), (2, 3.0, 2.0)]
