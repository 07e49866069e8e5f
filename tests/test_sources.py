"""File readers on small files written here."""

import os

import pytest
from pyspark.sql import functions as F

from fieldspark.functions.missing import parse_number
from fieldspark.schemas import CORE
from fieldspark.sources import loggers as L
from fieldspark.sources.delimited import read_decimal_comma, read_delim, read_parts
from fieldspark.sources.dictionaries import dictionaries
from fieldspark.sources.grid import grid_subset
from fieldspark.sources.tables import conform, load, load_tables, save, write_result_csv

from .conftest import rows


def put(root, path, text, encoding="utf-8"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding=encoding) as f:
        f.write(text)
    return full


def test_text_and_decimal_comma(spark, scratch):
    p = put(scratch, "a.csv", "site;v;w\nLav;1,5;x\nGud;u;y\n")
    assert dict(read_delim(spark, p).dtypes) == {"site": "string", "v": "string", "w": "string"}
    assert read_delim(spark, p, columns=["site", "v", "w"]).count() == 2
    assert rows(read_decimal_comma(spark, p, ["v"])) == [("Gud", None, "y"), ("Lav", 1.5, "x")]


def test_parts(spark):
    a = spark.createDataFrame([(2015, "1.5", "d")], "Year int, Biomass string, Date string")
    b = spark.createDataFrame([(2016, 2.5, "n")], "Year int, Biomass double, note string")
    assert rows(read_parts([a, b], {"Biomass": "double"}, ["Date"])) == [(2015, 1.5, None), (2016, 2.5, "n")]


def test_scan_excludes_by_name_and_extension(spark, scratch):
    for name in ("2016/Lavisdalen/A1.txt", "2016/Lavisdalen/A2.CSV", "2016/Lavisdalen/mylog.txt", "2016/Gudmedalen/Empty.txt", "2016/Gudmedalen/unknown7.csv", "2016/x.xlsx"):
        put(scratch, name, "x")
    got = L.scan_logs(spark, scratch)
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["A1.txt", "A2.CSV"]
    with pytest.raises(Exception, match="too large"):
        L.scan_logs(spark, scratch, max_bytes=0).collect()


def test_button_logs(spark, scratch):
    put(scratch, "2016/Lavisdalen/3E47.txt", "01.07.15 00:07:01,C,12,375\n\n02.07.15 00:07:01,C,-1,5\n")
    header = "\n".join(f"h{i}" for i in range(19))
    put(scratch, "2017/Gudmedalen/000000AB.csv", f"{header}\nDate/Time,Unit,Value\n7/1/16 1:00:01 PM,C,8.5\n")
    put(scratch, "2017/Gudmedalen/nothing.txt", "")
    got = L.with_path_keys(L.parse_button_logs(L.scan_logs(spark, scratch)), {"siteID": -2, "Year": -3}).filter("date is not null")
    assert rows(got.select("ID", "siteID", "Year", F.col("date").cast("string"), "value")) == [
        ("3E47_2016", "Lavisdalen", "2016", "2015-07-01 00:07:01", 12.375), ("3E47_2016", "Lavisdalen", "2016", "2015-07-02 00:07:01", -1.5), ("AB_2017", "Gudmedalen", "2017", "2016-07-01 13:00:01", 8.5)]


def test_multi_channel_logs(spark, scratch):
    put(scratch, "Skj/ITAS/Skjeld_ITAS.txt", "Label\tTemp-1\tUVB\n\t°C\tmV\n01.07.2015 10:00\t3,5\t#-INF\n01.07.2015 11:00\tx\t#+INF\n", "latin-1")
    put(scratch, "Ram/ITAS/Rambera.txt", "Label\t\tJordf1\n\t\t%\n01.07.2015 00:00\t10:30:00\t0,5\n", "latin-1")
    put(scratch, "other.txt", "Nothing\n1\t2\n")
    files = L.scan_logs(spark, scratch, include=("txt",), encoding="ISO-8859-1")
    got = rows(L.parse_itas(files).select("site", "logger", F.col("date").cast("string"), "value", "type"))
    assert got == [
        ("ram", "jordf1", "2015-07-01 10:30:00", 0.5, "ITAS"), ("skj", "temp1", "2015-07-01 10:00:00", 3.5, "ITAS"), ("skj", "temp1", "2015-07-01 11:00:00", None, "ITAS"),
        ("skj", "uvb", "2015-07-01 10:00:00", None, "ITAS"), ("skj", "uvb", "2015-07-01 11:00:00", None, "ITAS")]
    assert L.unrecognised_files(files).count() == 1


UTL = "Version\t1\nx\ty\nSite\t{site}\nDepth\t{depth}\nmore\nSample\n{body}"


def test_two_channel_logs(spark, scratch):
    put(scratch, "Ves/UTL/1.txt", UTL.format(site=" ", depth="200 cm", body="2008-10-30 00:00:00\t5,25\n"))
    put(scratch, "Lav/2.txt", UTL.format(site="Lavisdalen", depth="30cm", body="2009-06-23 12:00:00 -1,5\n2009-06-23 13:00:00\tx\n"))
    put(scratch, "Gud/3.txt", UTL.format(site="Gud", depth="9 m", body="2009-06-23 12:00:00\t1,0\n"))
    got = rows(L.parse_utl(L.scan_logs(spark, scratch)).select("site", "logger", F.col("date").cast("string"), "value"))
    assert got == [
        ("gud", "9m", "2009-06-23 12:00:00", 1.0), ("lav", "temp30cm", "2009-06-23 12:00:00", -1.5), ("lav", "temp30cm", "2009-06-23 13:00:00", None), ("ves", "temp200cm", "2008-10-30 00:00:00", 5.25)]
    put(scratch, "bad/Ramnofind.txt", "Version\t1\nno body\n")
    with pytest.raises(Exception, match="no Sample line"):
        L.parse_utl(L.scan_logs(spark, scratch)).collect()


def test_both_kinds_together(spark, scratch):
    put(scratch, "Skj/Skjeld_a.txt", "Label\tT\n\tC\n01.07.2015 10:00\t3,5\n")
    put(scratch, "Lav/b.txt", UTL.format(site="Lav", depth="30cm", body="2009-06-23 12:00:00\t1,5\n"))
    assert rows(L.read_loggers(spark, scratch), "type", "site", "value") == [("ITAS", "skj", 3.5), ("UTL", "lav", 1.5)]


def test_saved_data_is_partitioned(spark, scratch):
    df = spark.createDataFrame([(2015, "a", 1.0), (2016, "b", None)], "Year int, k string, v double")
    save(df, f"{scratch}/d", ["Year"])
    assert os.path.isdir(f"{scratch}/d/Year=2015")
    back = load(spark, f"{scratch}/d").filter("Year = 2016")
    assert "PartitionFilters: [isnotnull(Year" in back._jdf.queryExecution().executedPlan().toString()
    assert rows(back, "k", "v") == [("b", None)]
    write_result_csv(df, f"{scratch}/c", ";")
    assert rows(read_delim(spark, f"{scratch}/c", ";")) == [("2015", "a", "1.0"), ("2016", "b", "NA")]


def test_projection_and_filter_reach_the_scan(spark, sf):
    t = load_tables(spark, sf, ["orders"])["orders"]
    plan = t.filter("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_conform(spark):
    raw = spark.createDataFrame([("t", "2015", "a", "u", "x")], "turfID string, year string, species string, cover string, extra string")
    got = conform(raw, "turfCommunity")
    assert got.schema == CORE["turfCommunity"] and got.first()["cover"] is None
    with pytest.raises(ValueError):
        conform(raw, "sites")


def test_dictionaries(spark):
    d = dictionaries(spark)
    assert {k: v.count() for k, v in d.items()} == {"sites": 12, "site_fallback": 19, "turf_aliases": 31, "site_normals": 12}


def test_grid(spark):
    cube = spark.createDataFrame([(5.0, 60.0, 1, 1.0), (5.0, 60.0, 2, -999.0), (9.0, 60.0, 1, 3.0), (5.0, 70.0, 1, 4.0)], "lon double, lat double, time int, value double")
    got = grid_subset(cube, (4.0, 6.0, 59.0, 61.0), -999.0, "1900-01-01")
    assert rows(got.select(F.col("date").cast("string"), "value")) == [("1900-01-02", 1.0), ("1900-01-03", None)]
    assert grid_subset(cube, (4.0, 6.0, 59.0, 61.0), -999.0, "1900-01-01", "1900-01-02").count() == 1


def test_parse_number_reads_signs(spark):
    assert spark.createDataFrame([("-1,5",)], "c string").select(parse_number("c", ",")).first()[0] == -1.5
