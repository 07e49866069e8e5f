import uuid

import pytest
from pyspark.sql import functions as F

from fieldspark.operators.joins import baseline_delta, paired_delta
from fieldspark.sources.tables import replace_parts, save_bucketed


@pytest.fixture()
def turfs(spark, scratch):
    rows = [(f"t{i % 40}", 2000 + i // 40, "AB"[i % 2], i // 2 % 20, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "turfID string, Year int, Treatment string, blockID int, cover double")
    # Small tables would be sent round; large ones are not.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield df, f"turfs_{uuid.uuid4().hex}", f"{scratch}/turfs"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_change_since_baseline_moves_nothing(spark, turfs):
    df, name, path = turfs
    saved = save_bucketed(df, name, ["turfID"], 4, path, ["Year"])
    out = baseline_delta(saved, ["turfID"], "Year", 2000, ["cover"], na_matches=False)
    assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
    plain = baseline_delta(df, ["turfID"], "Year", 2000, ["cover"])
    assert "Exchange" in plan(plain)
    columns = ["turfID", "Year", "cover", "delta_cover"]
    assert key(out.select(columns)) == key(plain.select(columns))


def test_treatment_and_control_move_nothing(spark, turfs):
    df, name, path = turfs
    saved = save_bucketed(df, name, ["blockID"], 4, path, ["Year"])
    out = paired_delta(saved, "Treatment", "A", "B", ["blockID", "Year"], ["cover"])
    assert "Exchange" not in plan(out)
    assert key(out) == key(paired_delta(df, "Treatment", "A", "B", ["blockID", "Year"], ["cover"]))


def test_a_year_is_written_anew_and_the_others_stay(spark, turfs):
    df, name, path = turfs
    save_bucketed(df, name, ["turfID"], 4, path, ["Year"])
    files = {r["f"] for r in spark.table(name).filter("Year <> 2001").select(F.input_file_name().alias("f")).distinct().collect()}
    replace_parts(df.filter("Year = 2001 AND cover < 60").withColumn("cover", -F.col("cover")), name, ["turfID"], 4)
    now = spark.table(name)
    assert key(now.select(df.columns)) == key(df.filter("Year <> 2001").unionAll(df.filter("Year = 2001 AND cover < 60").withColumn("cover", -F.col("cover"))))
    assert {r["f"] for r in now.filter("Year <> 2001").select(F.input_file_name().alias("f")).distinct().collect()} == files
    out = baseline_delta(now, ["turfID"], "Year", 2000, ["cover"], na_matches=False)
    assert "Exchange" not in plan(out) and out.count() == now.count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
