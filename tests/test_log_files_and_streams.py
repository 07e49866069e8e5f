import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.sources import loggers as L
from fieldspark.sources.log_files import button_readings, channel_readings, logger_readings, scan_log_lines, two_column_readings
from fieldspark.streaming.hourly import hourly_state, latest_hours, read_arriving, write_changes


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.fixture()
def small_blocks(spark):
    """Blocks of some hundred bytes, so that files are split many times."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def channel_file(n):
    lines = ["Label\tTemp-30cm\tUVB", "Unit\tC\tmV"]
    lines += [f"{1 + i % 28:02d}.03.2016 {i % 24:02d}:00\t{i},5\t{'#-INF' if i % 9 == 0 else str(i * 2)}" for i in range(n)]
    return "\r\n".join(lines) + "\r\n"


def two_file(n, site, depth, extra=0):
    lines = ["Versi 1", "Serial\t1239", f"Site\t{site}", f"Depth\t{depth}", *["note"] * extra, "Sample"]
    lines += [f"2016-03-{1 + i % 28:02d} {i % 24:02d}:00:00\t{i},25" for i in range(n)]
    return "\n".join(lines)


def test_lines_of_split_files_have_their_places(spark, scratch, small_blocks):
    rng = random.Random(1)
    texts = {f"a b+c/{i}%20 ø.txt": "\n".join("x" * rng.randint(0, 60) + str(j) for j in range(rng.choice([0, 1, 3, 200]))) + rng.choice(["", "\n", "\n\n"]) for i in range(12)}
    texts["one line.txt"] = "y" * 5000
    for name, t in texts.items():
        put(scratch, name, t.encode("latin-1"))
    put(scratch, "my log.txt", b"no\n")
    put(scratch, "other.dat", b"no\n")
    df = scan_log_lines(spark, scratch, encoding="ISO-8859-1")
    assert spark.read.option("recursiveFileLookup", True).text(scratch).rdd.getNumPartitions() > 20
    got = {}
    for r in df.collect():
        got.setdefault(r["path"].split(scratch + "/")[1], []).append((r["line_no"], r["line"], r["head"]))
    for name, t in texts.items():
        want = t.split("\n")
        want = want[:-1] if want[-1] == "" else want
        lines = sorted(got.pop(name, []))
        assert [x[:2] for x in lines] == list(enumerate(want))
        assert all(x[2] == want[:30] for x in lines)
    assert not got


def test_readings_equal_those_of_whole_files(spark, scratch, small_blocks):
    put(scratch, "Gud/ITAS_gudmedalen 1.txt", channel_file(150).encode("latin-1"))
    put(scratch, "Ves/UTL/#001_Veskre.txt", two_file(120, " ", "30 cm").encode("latin-1"))
    put(scratch, "Lav/2_Låvi.txt", two_file(90, "Låvisdalen", "200 cm", 5).encode("latin-1"))
    put(scratch, "x/neither.txt", b"something else\n1\t2\n")
    new, old = logger_readings(spark, scratch), L.read_loggers(spark, scratch)
    plain = lambda df: sorted((r["file"], r["type"], str(r["date"]), r["logger"], str(r["value"]), r["site"]) for r in df.collect())
    assert plain(new) == plain(old) and new.count() == 300 + 120 + 90


def test_a_file_without_its_header_stops_the_scan(spark, scratch):
    put(scratch, "a_gud.txt", b"Versi 1\nno sample\n2016-01-01 00:00:00\t1,5\n")
    with pytest.raises(Exception, match="no Sample line"):
        two_column_readings(scan_log_lines(spark, scratch)).collect()


def test_button_files_and_empty_folders(spark, scratch, small_blocks):
    header = "\n".join(f"h{i}" for i in range(19))
    put(scratch, "1.csv", (header + "\n" + "\n".join(f"03/{1 + i % 28}/16 01:00:00 PM,C,{i}.5" for i in range(80))).encode())
    put(scratch, "2.txt", "\n".join(f"{1 + i % 28:02d}.03.16 13:00:00,C,{i},5" for i in range(80)).encode())
    got = button_readings(spark, scratch).collect()
    old = L.parse_button_logs(L.scan_logs(spark, scratch)).collect()
    key = lambda r: (r["path"].split("/")[-1], str(r["date"]), r["unit"], r["value"])
    assert sorted(map(key, got)) == sorted(map(key, old)) and len(got) == 160
    empty = os.path.join(scratch, "nothing")
    put(empty, "0.txt", b"")
    assert scan_log_lines(spark, empty).count() == 0 and channel_readings(scan_log_lines(spark, empty)).count() == 0


def test_files_are_opened_once(spark, scratch):
    put(scratch, "in/a.txt", b"one\ntwo\n")
    lines = scan_log_lines(spark, f"{scratch}/in")
    # What is read for the result are the stored lines, no longer the files.
    assert lines.inputFiles() and not any("/in/" in f for f in lines.inputFiles())
    os.remove(f"{scratch}/in/a.txt")
    assert sorted((r["line_no"], r["line"]) for r in lines.collect()) == [(0, "one"), (1, "two")]


# --- streams


def readings(spark, n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 5, 1)
    rows = [(rng.choice(["a", "b", None]), start + dt.timedelta(minutes=rng.randint(0, 3000)), rng.choice([None, 1.0, 2.5, 7.0])) for _ in range(n)]
    return spark.createDataFrame(rows, "site string, date timestamp, value double")


def test_stream_equals_the_table_after_a_stop(spark, scratch):
    folder, out, state = (f"{scratch}/{x}" for x in ("in", "out", "state"))
    classes = {"day": F.hour("date").between(10, 18)}
    schema = readings(spark, 1, 0).schema
    for step in range(3):
        readings(spark, 200, step).repartition(2).write.mode("append").parquet(folder)
        stream = hourly_state(read_arriving(spark, folder, schema, 1), ["site"], delay="30 days", classes=classes)
        write_changes(stream, out, state).awaitTermination()
    table = hourly_state(spark.read.parquet(folder), ["site"], classes=classes)
    got = latest_hours(spark, out, stream.schema, ["site", "day", "start"])
    key = lambda df: sorted((str(tuple(r)) for r in df.collect()))
    assert key(got) == key(table)
    # The state of a batch that failed half-way is written anew, under the same number.
    again = os.listdir(out)
    write_changes(hourly_state(read_arriving(spark, folder, schema, 1), ["site"], delay="30 days", classes=classes), out, state).awaitTermination()
    assert sorted(os.listdir(out)) == sorted(again) and key(latest_hours(spark, out, stream.schema, ["site", "day", "start"])) == key(table)


def test_a_batch_that_fails_is_done_again(spark, scratch):
    folder, out, state = (f"{scratch}/{x}" for x in ("in", "out", "state"))
    schema = readings(spark, 1, 0).schema
    readings(spark, 100, 1).coalesce(1).write.parquet(folder)
    stream = hourly_state(read_arriving(spark, folder, schema), ["site"], delay="30 days")

    def broken(batch, number):
        batch.limit(3).write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("stopped in the middle")

    with pytest.raises(Exception, match="stopped in the middle"):
        stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(broken).trigger(availableNow=True).start().awaitTermination()
    write_changes(stream, out, state).awaitTermination()
    got = latest_hours(spark, out, stream.schema, ["site", "start"])
    want = hourly_state(spark.read.parquet(folder), ["site"])
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())
