"""Missing-value and ordering rules, each with a row on which the plain Spark call is wrong."""

import math

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import aggregates as A
from fieldspark.functions import missing as M
from fieldspark.functions.dates import census_date, days_since, dmy, dmy_hms, mdy_hms, season, time_of_day, ymd_hms
from fieldspark.functions.text import clean_logger_id, digits_only, site_from_name, species_code, turf_key

from .conftest import rows


def test_negated_membership_keeps_missing(spark):
    df = spark.createDataFrame([("FAIL",), (None,), ("ok",)], "c string")
    assert rows(df.filter(~M.is_in("c", ["FAIL"]))) == [("ok",), (None,)]
    assert df.filter(~F.col("c").isin("FAIL")).count() == 1


def test_if_else_and_case_when(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    got = df.select(M.if_else(F.col("x") > 2, "hi", "lo").alias("a"), M.if_else(F.col("x") > 2, "hi", "lo", "none").alias("b"), M.case_when((F.col("x") > 2, 1), default=0).alias("c"))
    assert [tuple(r) for r in got.collect()] == [("lo", "lo", 0), ("hi", "hi", 1), (None, "none", 0)]


def test_paste_writes_missing_as_text(spark):
    df = spark.createDataFrame([("Gudmedalen", None, "GB")], "s string, b string, t string")
    assert df.select(turf_key("s", "b", "t")).first()[0] == "GudNAGB"


def test_recode_keeps_or_drops_unmatched(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = df.select(M.recode("c", {"a": "b"}), M.recode("c", {"a": 1.0}, "null")).collect()
    assert [tuple(r) for r in got] == [("b", 1.0), ("z", None), (None, None)]
    with pytest.raises(ValueError):
        M.recode("c", {"a": "b"}, "other")


def test_division_and_finite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(M.ratio("a", "b")).collect()] == [None, None, 0.5]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "a double")
    assert [r[0] for r in odd.select(M.finite("a")).collect()] == [None, None, 2.0, None]


def test_parse_number(spark):
    df = spark.createDataFrame([("3,5",), ("u",), (" 7 ",), (None,)], "c string")
    assert [r[0] for r in df.select(M.parse_number("c", ",")).collect()] == [3.5, None, 7.0, None]


def test_row_mean_and_blank_merge(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, "", "x"), (None, None, None, "y", "x"), (None, None, None, None, "x")], "a double, b double, c double, t string, g string")
    got = df.select(M.row_mean("a", "b", "c"), M.row_sum("a", "b", "c"), M.coalesce_blank("t", "g")).collect()
    assert [tuple(r) for r in got] == [(2.0, 4.0, "x"), (None, 0.0, "y"), (None, 0.0, "x")]


def test_update_where_ignores_missing_condition(spark):
    df = spark.createDataFrame([(None, 1.0), (3, 1.0)], "k int, v double")
    assert [r[0] for r in df.select(M.update_where(F.col("k") > 2, 9.0, "v")).collect()] == [1.0, 9.0]


def test_aggregates_propagate_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, x double")
    got = df.groupBy("k").agg(A.r_mean("x").alias("m"), A.r_mean("x", True).alias("mr"), A.r_sum("x", True).alias("s"), A.r_max("x").alias("mx"), A.n_distinct("x").alias("n"), A.n_distinct("x", True).alias("nr"), A.r_var("x", True).alias("v"))
    assert rows(got) == [("a", None, 1.0, 1.0, None, 2, 1, None), ("b", 2.0, 2.0, 2.0, 2.0, 1, 1, None), ("c", None, None, 0.0, None, 1, 0, None)]


def test_weighted_mean_rule(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", None, 5.0), ("a", 4.0, 3.0), ("b", 1.0, None), ("b", 2.0, 1.0), ("c", 1.0, 0.0)], "k string, x double, w double")
    got = dict(rows(df.groupBy("k").agg(A.weighted_mean("x", "w"))))
    assert got == {"a": 3.5, "b": None, "c": None}


def test_weighted_variances(spark):
    x, w = [1.0, 2.0, 4.0], [2.0, 1.0, 3.0]
    m = sum(a * b for a, b in zip(x, w)) / sum(w)
    ss = sum(b * (a - m) ** 2 for a, b in zip(x, w))
    df = spark.createDataFrame(list(zip(x, w)), "x double, w double")
    f, r, fs = df.agg(A.weighted_var("x", "w"), A.weighted_var("x", "w", "reliability"), A.weighted_var("x", "w", shift=2.0)).first()
    assert math.isclose(f, ss / (sum(w) - 1)) and math.isclose(fs, f)
    assert math.isclose(r, ss * sum(w) / (sum(w) ** 2 - sum(v * v for v in w)))
    with pytest.raises(ValueError):
        A.weighted_var("x", "w", "other")


def test_shannon_and_evenness(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 5.0), ("c", None)], "k string, c double")
    got = dict(rows(df.groupBy("k").agg(A.shannon("c"))))
    assert math.isclose(got["a"], math.log(2)) and got["b"] == 0.0 and got["c"] is None
    one = spark.createDataFrame([(0.0, 1), (0.5, 2)], "h double, s int")
    assert [r[0] for r in one.select(A.evenness("h", "s")).collect()] == [None, 0.5 / math.log(2)]


def test_diversity_ignores_scale_of_cover(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (6.0,)], "c double")
    a = df.agg(A.shannon("c")).first()[0]
    b = df.agg(A.shannon(F.col("c") * 1000)).first()[0]
    assert math.isclose(a, b)


def test_dates(spark):
    df = spark.createDataFrame([("23.06.2009", "01.07.15 10:11:12", "7/1/15 10:11:12 PM", "2015-07-01 10:11:12", "aut_09", 366)], "a string, b string, c string, d string, e string, f int")
    got = df.select(dmy("a"), dmy_hms("b"), mdy_hms("c"), ymd_hms("d"), census_date("e"), days_since("f", "2016-01-01")).first()
    assert [str(v) for v in got] == ["2009-06-23", "2015-07-01 10:11:12", "2015-07-01 22:11:12", "2015-07-01 10:11:12", "2009-09-01", "2017-01-01"]
    assert spark.createDataFrame([("01.07.2015 10:11",)], "b string").select(dmy_hms("b")).first()[0].minute == 11
    bad = spark.createDataFrame([("garbage",)], "a string").select(dmy("a"), ymd_hms("a")).first()
    assert tuple(bad) == (None, None)


def test_time_classes(spark):
    df = spark.createDataFrame([(h,) for h in (0, 6, 7, 9, 10, 18, 19, 20, 21, None)], "h int")
    got = [r[0] for r in df.select(time_of_day("h")).collect()]
    assert got == ["night", "night", "spinup", "spinup", "day", "day", "spinup", "spinup", "night", None]
    months = spark.createDataFrame([(m,) for m in (1, 4, 7, 10)], "m int")
    assert [r[0] for r in months.select(season("m")).collect()] == ["winter", "spring", "summer", "autumn"]


def test_text(spark):
    df = spark.createDataFrame([("Gud12", "Ach mil ", "3E47D941 DS1922L.txt_2016")], "a string, b string, c string")
    assert tuple(df.select(digits_only("a"), species_code("b"), clean_logger_id("c")).first()) == ("12", "Ach.mil", "3E47D941_2016")


def test_site_ladder(spark):
    names = ["Skjeldingahaugen_ITAS.txt", "1239_Øvstedal.txt", "Høgsete.txt", "låvi.txt", "Ålrust.txt", "arnhelleren.txt", "ulelogger.txt"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r[0] for r in df.select(site_from_name("f")).collect()] == ["skj", "ovs", "hog", "lav", "alr", "arh", "ulv"]
    odd = spark.createDataFrame([("nowhere.txt",)], "f string")
    assert odd.select(site_from_name("f", strict=False)).first()[0] is None
    with pytest.raises(Exception, match="no site"):
        odd.select(site_from_name("f")).collect()
