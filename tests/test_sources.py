"""Files in and out."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType, TimestampNTZType

from driftline.plans import rules
from driftline.session import small_table, stage
from driftline.sources import logs, tables

SCHEMA = (StructType().add("date", TimestampNTZType()).add("no", DoubleType())
          .add("zero_box", IntegerType()))


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_null_tokens_and_types(spark, tmp_path):
    path = put(tmp_path / "m", "a.csv",
               "date,no,zero_box,note\n2022-06-01 00:00:00,missing,NA,x\n2022-06-01 00:00:10,1.5,1,\n"
               "bad,oops,1.5,NA\n2022/06/01 00:00:20,NaN,0,y\n")
    got = tables.read_table(spark, path, SCHEMA).collect()
    assert [tuple(r) for r in got] == [
        (datetime(2022, 6, 1), None, None, "x"), (datetime(2022, 6, 1, 0, 0, 10), 1.5, 1, None),
        (None, None, None, None), (datetime(2022, 6, 1, 0, 0, 20), None, 0, "y")]


def test_folder_pattern_and_provenance(spark, tmp_path):
    put(tmp_path / "d", "mvpos1.csv", "date,no,zero_box\n2022-06-01 00:00:00,1,1\n")
    put(tmp_path / "d", "mvpos2.csv", "date,no,zero_box\n2022-06-01 00:00:10,2,1\n")
    path = put(tmp_path / "d", "other.csv", "date,no,zero_box\n2022-06-01 00:00:20,3,1\n")
    assert tables.read_table(spark, path, SCHEMA).count() == 3
    some = tables.read_table(spark, path, SCHEMA, glob="*mvpos*", provenance="file")
    assert sorted((os.path.basename(r.file), r.no) for r in some.collect()) == [
        ("mvpos1.csv", 1.0), ("mvpos2.csv", 2.0)]


def test_headers_that_disagree_are_an_error(spark, tmp_path):
    put(tmp_path / "h", "a.csv", "date,no,zero_box\n2022-06-01 00:00:00,1,1\n")
    path = put(tmp_path / "h", "b.csv", "date,zero_box,no\n2022-06-01 00:00:00,1,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_table(spark, path, SCHEMA, by_name=False).collect()


def test_headers_may_differ(spark, tmp_path):
    put(tmp_path / "log files", "a.csv", "date,no,zero_box\n2022-06-01 00:00:00,1,1\n")
    put(tmp_path / "log files", "b.csv", "date,zero_box,no\n2022-06-01 00:00:10,0,2\n")
    put(tmp_path / "log files", "c.csv", "\ndate,no\n2022-06-01 00:00:20,3\n")
    put(tmp_path / "log files", "d+1%20.csv", "date,no\n2022-06-01 00:00:30,4\n")
    put(tmp_path / "log files", "empty.csv", "")
    path = put(tmp_path / "log files", "e.csv", "date,no,zero_box,new\n2022-06-01 00:00:40,NA,1,x\n")
    got = tables.read_table(spark, path, SCHEMA, provenance="file").orderBy("date")
    assert got.dtypes[:3] == [("date", "timestamp_ntz"), ("no", "double"), ("zero_box", "int")]
    assert [(r.no, r.zero_box, r.new) for r in got.collect()] == [
        (1.0, 1, None), (2.0, 0, None), (3.0, None, None), (4.0, None, None), (None, 1, "x")]
    assert got.select("file").distinct().count() == 5
    assert len(tables.files_by_header(spark, path)) == 4


def test_positional(spark, tmp_path):
    path = put(tmp_path / "s", "surfmet.csv",
               "$X,20/05/2022,01:02:03.6,a,b,c,d,e,f,g,5.5,180,1.5,80,extra\n")
    got = logs.compile_surface_met(spark, path).first()
    assert (str(got.date), got.rel_ws, got.rel_wd, got.air_humidity) == (
        "2022-05-20 01:02:04", 5.5, 180.0, 80.0)


def test_compile_met(spark, tmp_path):
    surface = put(tmp_path / "s", "surfmet.csv", "".join(
        f"$X,20/05/2022,01:02:0{i},a,b,c,d,e,f,g,{i},180,1.5,80\n" for i in (3, 5)))
    nav = put(tmp_path / "n", "mvpos.csv", "X,date,lat,long,speed,heading\n"
              "1,2022-05-20 01:02:03.2,60,-40,5,90\n2,2022-05-20 01:02:04,60,-40,5,91\n")
    got = logs.compile_met(logs.compile_navigation(spark, nav, glob="*mvpos*"),
                           logs.compile_surface_met(spark, surface)).orderBy("date").collect()
    assert [(r.heading, r.rel_ws) for r in got] == [(90.0, 3.0), (91.0, None)]
    assert "X" not in got[0]


def test_harmonise_logs(spark, tmp_path):
    head = "TheTime,T200UP_023828_NO,zero_box,t101_022639_so2,spare\n"
    bst = put(tmp_path / "BST", "1.csv", head + "05/20/2022 01:02:03,1.5,0,missing,NA\n,,,,\n")
    utc = put(tmp_path / "UTC", "1.csv", head + "05/20/2022 01:02:03,NA,1,2.5,missing\n")
    got = logs.harmonise_logs(spark, [(bst, 1), (utc, 0)], rules.LOGGER_CHANNELS).orderBy("date")
    assert got.columns == ["date", "no", "zero_box", "so2"]
    assert [(str(r.date), r.no, r.zero_box, r.so2) for r in got.collect()] == [
        ("2022-05-20 00:02:03", 1.5, 0.0, None), ("2022-05-20 01:02:03", None, 1.0, 2.5)]


def test_logger_sets_must_agree(spark, tmp_path):
    a = put(tmp_path / "A", "1.csv", "TheTime,x\n05/20/2022 01:02:03,1\n")
    b = put(tmp_path / "B", "1.csv", "TheTime,y\n05/20/2022 01:02:03,1\n")
    with pytest.raises(Exception):
        logs.harmonise_logs(spark, [(a, 0), (b, 0)], {})


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2022, 6, 1, 1, 2, 3), 1.5, None)],
                               "date timestamp_ntz, no double, zero_box int")
    path = str(tmp_path / "out")
    tables.write_table(df, path, "csv")
    text = next(p for p in os.listdir(path) if p.endswith(".csv"))
    assert open(os.path.join(path, text)).readline().strip() == "date,no,zero_box"
    assert tables.read_table(spark, path, SCHEMA).collect() == df.collect()


def test_csv_sink_in_order(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2022, 6, 1) + timedelta(hours=(i * 7) % 50),)
                                for i in range(50)], "date timestamp_ntz").repartition(4)
    path = str(tmp_path / "sorted")
    tables.write_table(df, path, "csv", sort_by=["date"])
    lines = []
    for part in sorted(p for p in os.listdir(path) if p.endswith(".csv")):
        lines += open(os.path.join(path, part)).read().split("\n")[1:-1]
    assert len(lines) == 50 and lines == sorted(lines)


def test_parquet_sink_prunes_days(spark, tmp_path):
    df = spark.range(72).select(F.expr(
        "TIMESTAMP_NTZ '2022-06-01' + make_dt_interval(0, cast(id as int), 0, 0)").alias("date"))
    path = str(tmp_path / "days")
    tables.write_table(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 72 and {r.day.day for r in back.select("day").distinct().collect()} == {1, 2, 3}
    plan = back.filter("day = date'2022-06-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_stage_and_small_table(spark):
    df = spark.range(20).withColumn("t", F.expr("TIMESTAMP_NTZ '2022-06-01'"))
    staged = stage(df)
    assert staged.schema["t"].dataType == TimestampNTZType() and staged.count() == 20
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in staged.inputFiles())
    assert small_table(df, 5) is None
    assert sorted(small_table(df, 20).collect()) == sorted(df.collect())


def test_paths_that_look_like_patterns(spark, tmp_path):
    put(tmp_path / "p", "a[1].csv", "date,no\n2022-06-01 00:00:00,1\n")
    path = put(tmp_path / "p", "b{x}.csv", "no,date\n2,2022-06-01 00:00:10\n")
    assert sorted(r.no for r in tables.read_table(spark, path, SCHEMA).collect()) == [1.0, 2.0]


def test_headers_are_read_without_the_files(spark, tmp_path):
    """What the header pass reads does not grow with the files."""
    def read_by(action):
        known = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics
        before = sum(x.getBytesRead() for x in known())
        action()
        return sum(x.getBytesRead() for x in known()) - before

    def files(name, lines):
        put(tmp_path / name, "a.csv", "date,no\n" + "2022-06-01 00:00:00,1\n" * lines)
        return put(tmp_path / name, "b.csv", "no,date\n" + "1,2022-06-01 00:00:00\n" * lines)

    small, large = files("small", 10_000), files("large", 1_000_000)
    bytes_read = [read_by(lambda: tables.files_by_header(spark, p)) for p in (small, large)]
    assert os.path.getsize(f"{large}/a.csv") > 20_000_000
    assert 0 < bytes_read[1] < 2_000_000, bytes_read


def test_what_could_not_be_read(spark, tmp_path):
    path = put(tmp_path / "r", "a.csv",
               "date,no,zero_box,note\n2022-06-01 00:00:00,1.5,1,fine\n"
               "yesterday,\"1,5\",1.5,NA\n2022-06-01 00:00:20,missing,NA,\n"
               "2022-06-01 00:00:30,1\n2022-06-01 00:00:40,oops,1,a,b\n2022-06-01 00:00:50,NaN,1,z\n")
    put(tmp_path / "r", "b.csv", "no,date\nbad,2022-06-02 00:00:00\n")
    seen = Observation()
    got = tables.read_table(spark, path, SCHEMA, rescue="lost", observe=seen)
    rows = {str(r.date)[8:]: r for r in got.collect()}
    assert rows["01 00:00:00"].lost is None and rows["01 00:00:20"].lost is None
    assert rows["01 00:00:50"].lost is None and rows["01 00:00:50"].no is None
    bad = rows["" if "" in rows else [k for k in rows if rows[k].date is None][0]]
    assert bad.lost.fields == {"date": "yesterday", "no": "1,5", "zero_box": "1.5"}
    assert (bad.lost.misfit, bad.lost.line) == (None, None)
    short, long = rows["01 00:00:30"].lost, rows["01 00:00:40"].lost
    assert (short.misfit, short.line, short.fields) == ("short", "2022-06-01 00:00:30,1", {})
    assert (long.misfit, long.fields) == ("long", {"no": "oops"})
    assert rows["02 00:00:00"].lost.fields == {"no": "bad"}
    assert seen.get == {"n_rows": 7, "n_short": 1, "n_long": 1, "n_lost_date": 1, "n_lost_no": 3,
                        "n_lost_zero_box": 1}
    plain = tables.read_table(spark, path, SCHEMA)
    assert got.drop("lost").dtypes == plain.dtypes
    assert sorted(map(str, got.drop("lost").collect())) == sorted(map(str, plain.collect()))
    counted = Observation()
    assert tables.read_table(spark, path, SCHEMA, observe=counted).columns == plain.columns
