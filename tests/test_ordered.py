"""Order-dependent operators and quantiles, with groups cut into pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.operators import ordered as O
from fieldspark.operators.distributions import histogram, kde, mean_cl_boot
from fieldspark.operators.quantiles import box_stats, quantiles

from .conftest import rows


@pytest.fixture(scope="module")
def readings(spark):
    """A hot logger with two thirds of the rows, half of them at one time, and missing values."""
    rnd = random.Random(3)
    data = []
    for i in range(1500):
        key = "hot" if i % 3 else f"k{i % 5}"
        t = 500 if i % 2 else rnd.randrange(1000)
        data.append((i, key, t, None if i % 41 == 0 else round(rnd.gauss(10, 5), 3)))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "id int, k string, t int, v double").cache()


def test_pieces_follow_the_order(readings):
    cut = O.with_pieces(readings, "t", "id", 16)
    ends = cut.groupBy("__piece").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b"), F.count(F.lit(1)).alias("n")).orderBy("__piece").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(ends, ends[1:]))
    assert sum(e["n"] for e in ends) == 1500
    assert max(e["n"] for e in ends) < 300  # the value that holds half of the rows is cut along the id


@pytest.mark.parametrize("limit", [10_000, 50])
def test_lag_equals_window(readings, limit):
    got = O.lag_in_group(readings, ["k"], "t", "id", "v", "p", limit)
    want = readings.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t", "id")))
    assert rows(got, "id", "p") == rows(want, "id", "p")


@pytest.mark.parametrize("limit", [10_000, 50])
def test_running_sum_equals_window_and_missing_sticks(readings, limit):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    whole = readings.fillna({"v": 0.0})
    got = O.running_sum(whole, ["k"], "t", "id", (F.col("v") < 8).cast("long"), "s", limit)
    want = whole.withColumn("s", F.sum((F.col("v") < 8).cast("long")).over(w))
    assert rows(got, "id", "s") == rows(want, "id", "s")
    sticky = O.running_sum(readings, ["k"], "t", "id", (F.col("v") < 8).cast("long"), "s", limit)
    seen = readings.withColumn("na", F.max(F.col("v").isNull().cast("int")).over(w)).select("id", "na")
    joined = sticky.join(seen, "id")
    assert joined.filter((F.col("na") == 1) & F.col("s").isNotNull()).count() == 0
    assert joined.filter((F.col("na") == 0) & F.col("s").isNull()).count() == 0


def test_spike_filter_is_signed(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, 21.0), ("a", 4, 6.0), ("a", 5, None), ("a", 6, 6.0), ("a", 7, 6.5), ("b", 1, 3.0)], "k string, t int, v double")
    assert rows(O.spike_filter(df, ["k"], "t", "t", "v", 10.0), "k", "t") == [("a", 4), ("a", 7)]


def test_frost_days(spark):
    df = spark.createDataFrame([("a", 1, -1.0), ("a", 2, 2.0), ("a", 3, -2.0), ("a", 4, None), ("a", 5, -1.0)], "k string, d int, m double")
    assert rows(O.frost_days(df, ["k"], "d", "d", "m"), "d", "frost_days") == [(1, 1), (2, 1), (3, 2), (4, None), (5, None)]


def test_distinct_first_takes_the_first_and_puts_missing_last(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 2, "y"), ("a", 1, "z"), ("b", None, "w"), (None, 1, "n")], "k string, o int, v string")
    assert rows(O.distinct_first(df, ["k"], ["o"])) == [("a", 1, "z"), ("b", None, "w"), (None, 1, "n")]


def test_sampling_index_is_dense_over_the_turf(spark):
    df = spark.createDataFrame([("t", 2015, "a"), ("t", 2015, "b"), ("t", 2017, "a"), ("u", 2016, "a")], "turf string, y int, s string")
    assert rows(O.sampling_index(df, ["turf"], "y")) == [("t", 2015, 1), ("t", 2017, 2), ("u", 2016, 1)]


@pytest.mark.parametrize("limit", [10_000, 40])
@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_numpy(readings, limit, keys):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(readings, keys, "v", probs, limit=limit)
    pdf = readings.toPandas()
    for row in got.collect():
        part = pdf if not keys else pdf[pdf.k == row["k"]]
        np.testing.assert_allclose([row[c] for c in got.columns if c.startswith("q")], np.nanquantile(part.v, probs), rtol=1e-9)


def test_quantiles_with_many_equal_values(spark):
    data = [("a", 1.0)] * 300 + [("a", 2.0)] * 100 + [("b", float(i)) for i in range(20)]
    df = spark.createDataFrame(data, "k string, v double")
    got = rows(quantiles(df, ["k"], "v", [0.5, 0.75, 0.8], limit=10))
    assert got[0] == ("a", 1.0, 1.25, 2.0) and got[1][1:] == pytest.approx((9.5, 14.25, 15.2))


def test_approximate_quantiles_are_close(readings):
    a = quantiles(readings, [], "v", [0.5], method="approx").first()[0]
    b = quantiles(readings, [], "v", [0.5]).first()[0]
    assert abs(a - b) < 0.2
    with pytest.raises(ValueError):
        quantiles(readings, [], "v", [0.5], method="guess")


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)], "v double").withColumn("k", F.lit("a"))
    r = box_stats(df, ["k"], "v").first()
    assert (r["median"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (3.5, 1.0, 5.0, 1)


def test_bootstrap_interval_is_close_to_normal_and_repeatable(readings):
    a = mean_cl_boot(readings.filter("k = 'hot'"), ["k"], "v", ["id"], 400, seed=5)
    b = mean_cl_boot(readings.repartition(7).filter("k = 'hot'"), ["k"], "v", ["id"], 400, seed=5)
    x, y = a.first(), b.first()
    assert abs(x["lower"] - y["lower"]) < 1e-9
    s = readings.filter("k = 'hot'").agg(F.stddev("v") / F.sqrt(F.count("v"))).first()[0]
    assert abs((x["upper"] - x["lower"]) / (2 * 1.96 * s) - 1) < 0.2
    assert x["lower"] < x["mean"] < x["upper"]


def test_bootstrap_without_keys(readings):
    assert mean_cl_boot(readings, [], "v", ["id"], 50).count() == 1


def test_density_integrates_to_one_and_matches_direct_sum(readings):
    d = kde(readings.filter("k = 'hot'"), ["k"], "v", -20.0, 40.0, 241, 1.5).orderBy("x").toPandas()
    assert abs(np.trapezoid(d.density, d.x) - 1) < 0.01
    v = readings.filter("k = 'hot'").select("v").toPandas().v.dropna().to_numpy()
    direct = np.array([np.exp(-0.5 * ((g - v) / 1.5) ** 2).mean() / (1.5 * np.sqrt(2 * np.pi)) for g in d.x])
    assert np.max(np.abs(direct - d.density)) < 2e-3
    assert kde(readings, ["k"], "v", -20.0, 40.0, 33).filter("density is null").count() == 0
    assert kde(readings, [], "v", -20.0, 40.0, 33).count() == 33


def test_histogram(spark):
    df = spark.createDataFrame([("a", -0.5), ("a", 0.0), ("a", 0.9), ("a", 1.0), ("a", None)], "k string, v double")
    assert rows(histogram(df, ["k"], "v", 1.0), "bin", "n") == [(-1, 1), (0, 2), (1, 1)]


def test_cumsum_by(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, 4.0)], "k string, y int, v double")
    assert rows(O.cumsum_by(df, ["k"], "y", "v")) == [("a", 1, 5.0, 5.0), ("a", 2, 4.0, 9.0)]


@pytest.mark.parametrize("limit", [1, 10_000])
def test_text_has_no_order_at_any_size(spark, limit):
    df = spark.createDataFrame([("a", "1", 1, 2.0), ("a", "2", 2, 3.0)], "k string, t string, id int, v double")
    for order, tie in (("t", "id"), ("id", "t")):
        with pytest.raises(TypeError):
            O.lag_in_group(df, ["k"], order, tie, "v", "p", limit)
        with pytest.raises(TypeError):
            O.running_sum(df, ["k"], order, tie, F.col("v"), "s", limit)
