import pytest
from pyspark.sql import functions as F

from fieldspark.operators import joins as J

from .conftest import rows


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "n"), (2, "m")], "k int, w string")
    assert rows(J.r_join(a, b, "k")) == [(1, "x", None), (None, "y", "n")]
    assert rows(J.r_join(a, b, "k", na_matches=False)) == [(1, "x", None), (None, "y", None)]
    full = [(1, "x", None), (2, None, "m"), (None, "y", "n")]
    assert rows(J.r_join(a, b, "k", "full")) == full
    assert rows(J.r_join(a, b, "k", "full", hot_keys=True)) == full
    assert rows(J.semi(a, b, "k")) == [(None, "y")]
    assert rows(J.anti(a, b, "k")) == [(1, "x")]


def test_suffix_names_and_natural_keys(spark):
    a = spark.createDataFrame([(1, 10, 5)], "k int, g int, v int")
    b = spark.createDataFrame([(1, 10, 7)], "k int, g int, v int")
    assert J.r_join(a, b, ["k", "g"]).columns == ["k", "g", "v", "v_new"]
    assert J.r_join(a, b.drop("v"), None).columns == ["k", "g", "v"]
    assert J.r_join(a, b.withColumnRenamed("k", "kk"), {"k": "kk", "g": "g"}, "full", hot_keys=True).columns == ["k", "g", "v", "v_new"]
    with pytest.raises(ValueError):
        J.r_join(a, b.select(F.lit(1).alias("z")), None)


def test_right_join_takes_right_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(J.r_join(a, b, "k", "right")) == [(1, "x"), (2, None)]


def test_null_safe_join_stays_equi(spark):
    a, b = spark.range(10).toDF("k"), spark.range(10).toDF("k")
    plan = J.r_join(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlay_and_complete(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    upd = spark.createDataFrame([(1, 9.0), (2, None)], "k int, v double")
    assert rows(J.overlay(df, upd, "k", ["v"])) == [(1, 9.0), (2, 2.0)]
    frame = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(J.complete_with(df, frame, ["k"], {"v": 0.0})) == [(1, 1.0), (3, 0.0)]


PLOTS = [("b1", "FGB", 1.0), ("b1", "C", 3.0), ("b2", "C", 4.0), ("b3", "FGB", None), ("b3", "C", 1.0)]


def test_reference_anomaly(spark):
    df = spark.createDataFrame(PLOTS, "b string, t string, v double")
    got = J.anomaly_vs(df, F.col("t") == "FGB", ["b"], ["v"])
    assert rows(got, "b", "t", "v_anom") == [("b1", "C", 2.0), ("b1", "FGB", 0.0), ("b2", "C", None), ("b3", "C", None), ("b3", "FGB", None)]


def test_repeated_reference_is_an_error_unless_exact_copies(spark):
    df = spark.createDataFrame([*PLOTS, ("b1", "FGB", 1.0)], "b string, t string, v double")
    with pytest.raises(Exception, match="reference rows repeat"):
        J.anomaly_vs(df, F.col("t") == "FGB", ["b"], ["v"]).collect()
    assert J.anomaly_vs(df, F.col("t") == "FGB", ["b"], ["v"], dedupe=True).count() == 6


def test_paired_delta(spark):
    df = spark.createDataFrame(PLOTS, "b string, t string, v double")
    got = J.paired_delta(df, "t", "C", "FGB", ["b"], ["v"])
    assert rows(got, "b", "delta_v") == [("b1", 2.0), ("b2", None), ("b3", None)]
    twice = spark.createDataFrame([*PLOTS, ("b1", "C", 8.0)], "b string, t string, v double")
    with pytest.raises(Exception, match="repeat"):
        J.paired_delta(twice, "t", "C", "FGB", ["b"], ["v"]).collect()


def test_paired_delta_of_equal_data_is_zero(spark):
    df = spark.createDataFrame([(i, t, float(i)) for i in range(5) for t in "AB"], "b int, t string, v double")
    assert {r[0] for r in J.paired_delta(df, "t", "A", "B", ["b"], ["v"]).select("delta_v").collect()} == {0.0}


def test_baseline_delta(spark):
    df = spark.createDataFrame([("t1", 2011, 1.0), ("t1", 2012, 4.0), ("t2", 2012, 5.0)], "turf string, y int, v double")
    assert rows(J.baseline_delta(df, ["turf"], "y", 2011, ["v"]), "turf", "y", "delta_v") == [("t1", 2011, 0.0), ("t1", 2012, 3.0), ("t2", 2012, None)]


def test_adjacent_needs_difference_of_one(spark):
    df = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 2.0), ("t", 4, 4.0)], "k string, i int, v double")
    got = J.adjacent(df, df, ["k"], "i", ["v"])
    assert rows(got, "i", "i_near", "v_near") == [(1, 2, 2.0), (2, 1, 1.0)]


def test_fallback_fill(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 5.0), ("a", 2, 1.0), ("b", 2, None)], "s string, d int, v double")
    pref = spark.createDataFrame([("a", "b")], "s string, alternative string")
    assert rows(J.fill_from_alternative(df, pref, "s", "d", "v"), "s", "d", "v") == [("a", 1, 5.0), ("a", 2, 1.0), ("b", 1, 5.0), ("b", 2, None)]


def test_deployment_window(spark):
    r = spark.createDataFrame([("x", 1), ("x", 2), ("x", 5), ("x", 6), ("y", 0), ("z", 9)], "id string, t int")
    dep = spark.createDataFrame([("x", 2, 5), ("y", None, 3), ("z", 1, 2)], "id string, a int, b int")
    got = J.within_deployment(r, dep, ["id"], "t", "a", "b", guard=F.col("id") != "z")
    assert rows(got, "id", "t") == [("x", 2), ("x", 5), ("y", 0), ("z", 9)]


def test_grid(spark):
    one = spark.createDataFrame([(1, 3)], "lo int, hi int")
    g = J.grid(one, {"x": F.sequence("lo", "hi"), "t": F.array(F.lit("a"), F.lit("b"))})
    assert g.count() == 6


def test_build_community(spark):
    mk = spark.createDataFrame
    tables = {
        "subTurfCommunity": mk([("t1", 1, 2015, "s1"), ("t1", 2, 2015, "s1"), ("t1", 1, 2015, "s2")], "turfID string, subTurf int, year int, species string"),
        "turfCommunity": mk([("t1", 2015, "s1", 4.0), ("t1", 2016, "s1", 5.0)], "turfID string, year int, species string, cover double"),
        "taxon": mk([("s1", "Rosaceae")], "species string, family string"),
        "turfs": mk([("t1", "TTC", "p1")], "turfID string, TTtreat string, destinationPlotID string"),
        "plots": mk([("p1", "b1")], "plotID string, blockID string"),
        "blocks": mk([("b1", "site")], "blockID string, siteID string"),
        "sites": mk([("site", 1.0)], "siteID string, latitude double"),
        "turfEnvironment": mk([("t1", 2015, "PM")], "turfID string, year int, recorder string"),
    }
    got = J.build_community(tables)
    assert rows(got, "species", "year", "n_subturfs", "cover", "siteID", "recorder") == [
        ("s1", 2015, 2, 4.0, "site", "PM"), ("s1", 2016, None, 5.0, "site", None), ("s2", 2015, 1, None, "site", "PM")]
