import pytest
from pyspark.sql import functions as F

from fieldspark.operators import grouping as G
from fieldspark.operators import projection as P
from fieldspark.operators import reshape as R
from fieldspark.operators import sets as S
from fieldspark.operators.dissimilarity import dissimilarity

from .conftest import rows


def test_gather_spread_round_trip(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "k int, a double, b double")
    long = R.gather(df, "a:b", "n", "v", na_rm=True)
    assert rows(long) == [(1, "a", 2.0), (2, "a", 3.0), (2, "b", 4.0)]
    assert rows(R.spread(long, ["k"], "n", "v", ["a", "b"])) == rows(df)
    assert rows(R.spread(long, ["k"], "n", "v", ["a", "b"], fill=0.0))[0] == (1, 2.0, 0.0)


def test_spread_rejects_repeated_cells(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0)], "k int, n string, v double")
    with pytest.raises(Exception, match="cells repeat"):
        R.spread(df, ["k"], "n", "v", ["a"]).collect()


def test_complete_adds_missing_rows(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("y", 2, 6.0)], "s string, d int, v double")
    assert rows(R.complete(df, "s", ["x", "y"], ["d"])) == [("x", 1, 5.0), ("x", 2, None), ("y", 1, None), ("y", 2, 6.0)]


def test_levels_of(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "c string")
    assert R.levels_of(df, "c") == ["a", "b"]
    with pytest.raises(ValueError):
        R.levels_of(df, "c", limit=1)


def test_split_glue(spark):
    df = spark.createDataFrame([("a_b", None)], "k string, z string")
    assert R.separate(df, "k", ["p", "q", "r"]).select("p", "q", "r").first() == ("a", "b", None)
    assert R.unite(df, "u", ["k", "z"]).first()[0] == "a_b_NA"
    assert df.select(R.interaction("k", "z")).first()[0] is None


@pytest.mark.parametrize("max_rows", [1000, 7])
def test_nest_keeps_all_rows(spark, max_rows):
    df = spark.range(100).select(F.when(F.col("id") < 70, "hot").otherwise("cold").alias("k"), "id", (F.col("id") % 3).alias("v"))
    nested = R.nest(df, ["k"], ["id"], max_rows=max_rows)
    assert (nested.count() == 2) == (max_rows == 1000)
    assert rows(R.unnest(nested), "k", "id", "v") == rows(df)


def test_union_and_substitution(spark):
    a = spark.createDataFrame([("x", 1)], "s string, d int")
    b = spark.createDataFrame([("y", 2.0)], "s string, w double")
    assert rows(S.union_tagged({"p": a, "q": b})) == [("x", 1, "p", None), ("y", None, "q", 2.0)]
    got = S.substitute_rows(S.union_all(a, a.withColumn("s", F.lit("z"))), F.col("s") == "x", {"s": F.lit("z")}, F.col("s") == "z")
    assert rows(got) == [("x", 1), ("z", 1)]
    assert rows(S.key_diff(a, b, ["s"])) == [("x", "a"), ("y", "b")]
    assert rows(S.unique(S.union_all(a, a), "s")) == [("x",)]


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, None, 0.0, "q")], "a int, b double, c double, d string")
    assert P.select_range(df, "a:c", "d", drop=["b"], rename={"z": "c"}).columns == ["a", "z", "d"]
    assert P.drop_empty_cols(df).columns == ["a", "c", "d"]
    assert P.drop_empty_cols(df, "positive", ["b", "c"]).columns == ["a", "d"]
    assert P.drop_incomplete(df).count() == 0 and P.drop_incomplete(df, ["a"]).count() == 1
    with pytest.raises(ValueError):
        P.column_range(df, "c", "a")


def test_categories_by_name_not_position(spark):
    df = spark.createDataFrame([("RTG",), ("RTC",), ("other",)], "t string")
    assert rows(P.categorize(df, "t", ["RTC", "RTG"], ["Intact", "Gap"]), "t", "t_ord") == [("Gap", 1), ("Intact", 0), (None, None)]


def test_series_bounds_are_exclusive(spark):
    df = spark.sql("SELECT 'a' AS site, 'x' AS logger, timestamp'2020-01-01' AS date, 1.0D AS value UNION ALL SELECT 'a', 'y', timestamp'2020-01-02', 50.0D")
    assert P.select_series(df, "a", "2020-01-01", "2020-01-03", include=False).count() == 1
    assert P.select_series(df, loggers=["x"]).count() == 1
    assert P.select_series(df, include=False, cap=40.0).count() == 1


def test_scale_uses_training_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "k string, v double")
    out, fitted = G.scale(df, ["v"])
    assert abs(out.agg(F.avg("sv")).first()[0]) < 1e-12 and abs(out.agg(F.stddev("sv")).first()[0] - 1) < 1e-12
    new = spark.createDataFrame([("c", 3.0)], "k string, v double")
    assert G.apply_scale(new, fitted, ["v"]).first()["sv"] == 0.0
    grouped, _ = G.scale(df, ["v"], by=["k"])
    assert grouped.filter("k = 'b'").first()["sv"] is None


def test_row_weighted_yearly_mean(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 1.0), ("s", 1, 1.0), ("s", 2, 9.0)], "k string, y int, v double")
    assert G.annual_then_mean(df, ["k"], "y", "v", "m").first()["m"] == (3 * 3 + 9) / 4
    assert G.annual_then_mean(df, ["k"], "y", "v", "m", "years").first()["m"] == 6.0


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 20.0), ("b", 21.0), ("c", 19.0)], "k string, v double")
    assert rows(G.dominance(df, ["k"], "v", 20.0), "k", "dominance") == [("a", None), ("b", "dominant"), ("c", "subordinate")]
    flagged = G.band_flag(df, F.col("k") == "a", "v", 1.0)
    assert flagged.filter("in_band").count() == 3


def test_first_crossing_and_maximum(spark):
    df = spark.createDataFrame([("a", 1, 6.0), ("a", 2, 5.0), ("a", 3, 4.0)], "k string, d int, v double")
    assert rows(G.first_crossing(df, ["k"], "d", F.col("v") <= 5)) == [("a", 2, 5.0)]
    assert rows(G.filter_group_max(df, ["k"], "v")) == [("a", 1, 6.0)]
    assert G.having_n(df, ["k"], 3).count() == 3 and G.having_n(df, ["k"], 2).count() == 0


def test_community_summary_edge_rows(spark):
    df = spark.createDataFrame(
        [("one", "a", 5.0, 1.0), ("zero", "a", 0.0, 1.0), ("zero", "b", 4.0, None), ("na", "a", None, 2.0)], "p string, species string, cover double, t double"
    )
    got = {r["p"]: r for r in G.community_summary(df, ["p"], ["t"], na_rm=False).collect()}
    assert got["one"]["evenness"] is None and got["one"]["diversity"] == 0.0
    assert got["zero"]["richness"] == 2 and got["zero"]["diversity"] == 0.0 and got["zero"]["wmean_t"] is None
    assert got["na"]["sumcover"] is None and got["na"]["diversity"] is None


def test_evenness_is_at_most_one(spark, sf):
    from fieldspark.fixtures import community

    s = G.community_summary(community(spark, sf), ["siteID", "blockID", "Treatment", "Year"])
    assert s.filter("evenness > 1.0000001 OR evenness < 0").count() == 0


def test_dissimilarity_bounds(spark):
    df = spark.createDataFrame(
        [("t", 1, "a", 2.0), ("t", 1, "b", 2.0), ("t", 2, "a", 2.0), ("t", 2, "b", 2.0), ("t", 3, "c", 9.0), ("u", 2, "a", 1.0)], "t string, y int, species string, cover double"
    )
    assert rows(dissimilarity(df, ["t"], "y", 1)) == [("t", 1, 0.0, 0.0), ("t", 2, 0.0, 0.0), ("t", 3, 1.0, 1.0)]


def test_dissimilarity_is_symmetric(spark):
    df = spark.createDataFrame([("t", 1, "a", 2.0), ("t", 1, "b", 5.0), ("t", 2, "a", 3.0), ("t", 2, "c", 1.0)], "t string, y int, species string, cover double")
    a = dissimilarity(df, ["t"], "y", 1).filter("y = 2").first()["bray"]
    b = dissimilarity(df, ["t"], "y", 2).filter("y = 1").first()["bray"]
    assert abs(a - b) < 1e-12 and abs(a - (1 - 4 / 11)) < 1e-12


def test_reorder_levels(spark):
    df = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 3.0)], "c string, v double")
    assert rows(G.reorder_levels(df, "c", F.avg("v")), "c", "c_ord") == [("x", 2), ("y", 1), ("z", 3)]
