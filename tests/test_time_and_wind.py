"""Instants, bins and wind on hand-computed rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.functions import times
from driftline.operators.timebin import time_average
from driftline.operators.wind import true_wind, wind_average


def instants(spark, *texts):
    return spark.createDataFrame(
        [(datetime.fromisoformat(t) if t else None,) for t in texts], "date timestamp_ntz")


@pytest.fixture(params=["UTC", "Europe/London", "America/New_York"])
def zone(request, spark):
    """Results must not depend on the session time zone, in a lost hour either."""
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_round_second(spark, zone):
    df = instants(spark, "2022-03-27 01:30:00.499999", "2022-03-27 01:30:00.5",
                  "2022-03-13 02:59:59.5", "1969-12-31 23:59:58.5", None)
    got = [r.r for r in df.select(times.round_second(F.col("date")).alias("r")).collect()]
    assert [str(g) for g in got] == ["2022-03-27 01:30:00", "2022-03-27 01:30:01",
                                     "2022-03-13 03:00:00", "1969-12-31 23:59:59", "None"]


def test_bins(spark, zone):
    df = instants(spark, "2022-03-27 01:30:59.7", "2022-03-13 02:15:00", "1969-12-31 23:59:59.9")
    minute = [str(r.b) for r in df.select(times.time_bin(F.col("date"), "1 min").alias("b")).collect()]
    assert minute == ["2022-03-27 01:30:00", "2022-03-13 02:15:00", "1969-12-31 23:59:00"]
    hour = [str(r.b) for r in df.select(times.time_bin(F.col("date"), "hour").alias("b")).collect()]
    assert hour == ["2022-03-27 01:00:00", "2022-03-13 02:00:00", "1969-12-31 23:00:00"]
    near = [str(r.b) for r in df.select(
        times.time_bin(F.col("date"), "1 minute", rounded=True).alias("b")).collect()]
    assert near == ["2022-03-27 01:31:00", "2022-03-13 02:15:00", "1970-01-01 00:00:00"]


def test_parsing(spark, zone):
    df = spark.createDataFrame(
        [("2022-05-20 01:02:03", "05/20/2022 01:02:03", "20/05/2022 1:2:3"),
         ("2022/5/2T01:02:03Z", "13/20/2022 01:02:03", "2022-05-20 01:02:03"),
         ("2022-03-27 01:30:00", "03/13/2022 02:30:00", None)], "a string, b string, c string")
    got = df.select(times.parse_ymd_hms(F.col("a")), times.parse_mdy_hms(F.col("b")),
                    times.parse_dmy_hms(F.col("c"))).collect()
    assert [[str(v) for v in r] for r in got] == [
        ["2022-05-20 01:02:03", "2022-05-20 01:02:03", "2022-05-20 01:02:03"],
        ["2022-05-02 01:02:03", "None", "None"],
        ["2022-03-27 01:30:00", "2022-03-13 02:30:00", "None"]]


def test_bin_length():
    assert [times.bin_seconds(t) for t in ("1 min", "hour", "10 minutes", "1 day", "2 s")] == \
        [60, 3600, 600, 86400, 2]
    with pytest.raises(ValueError):
        times.bin_seconds("1 fortnight")


def mean_frame(spark):
    return spark.createDataFrame(
        [(datetime(2022, 6, 1, 0, m, s), a, b) for m, s, a, b in
         [(0, 0, 1.0, None), (0, 10, None, None), (1, 0, 3.0, None), (1, 10, 5.0, None),
          (4, 0, None, 7.0)]], "date timestamp_ntz, a double, b double")


def test_mean_skips_or_not(spark):
    skip = time_average(mean_frame(spark), "1 minute").orderBy("date").collect()
    assert [(r.a, r.b) for r in skip] == [(1, None), (4, None), (None, 7)]
    strict = time_average(mean_frame(spark), "1 minute", strict=True).orderBy("date").collect()
    assert [(r.a, r.b) for r in strict] == [(None, None), (4, None), (None, 7)]


def test_padding_adds_the_empty_bins(spark):
    padded = time_average(mean_frame(spark), "1 minute", pad=True).orderBy("date").collect()
    assert [r.date.minute for r in padded] == [0, 1, 2, 3, 4]
    assert padded[2].a is None


def test_other_columns_drop_out_and_rows_without_instant(spark):
    df = spark.createDataFrame([(datetime(2022, 6, 1), "x", 2, True), (None, "y", 4, True)],
                               "date timestamp_ntz, s string, n int, f boolean")
    got = time_average(df, "1 hour")
    assert got.columns == ["date", "n"] and [r.n for r in got.collect()] == [2.0]


def test_vector_mean_across_north(spark):
    df = spark.createDataFrame(
        [(datetime(2022, 6, 1), 350.0, 2.0), (datetime(2022, 6, 1), 10.0, 2.0),
         (datetime(2022, 6, 1), None, 5.0)], "date timestamp_ntz, wd double, ws double")
    got = time_average(df, "1 minute", wind=[("wd", "ws")], vector_ws=True).first()
    assert min(got.wd, 360 - got.wd) == pytest.approx(0, abs=1e-9)
    assert got.ws == pytest.approx(1.969615506)
    plain = time_average(df, "1 minute", wind=[("wd", "ws")]).first()
    assert plain.ws == pytest.approx(3.0)
    assert min(plain.wd, 360 - plain.wd) == pytest.approx(0, abs=1e-9)


MET = "`...1` int, date timestamp_ntz, lat double, long double, speed double, heading double, " \
      "rel_ws double, rel_wd double, air_temp double, air_humidity double"


def met_row(speed, heading, rel_ws, rel_wd, air=1.0):
    return (1, datetime(2022, 6, 1), 60.0, -40.0, speed, heading, rel_ws, rel_wd, air, 80.0)


def test_true_wind(spark):
    df = spark.createDataFrame([met_row(0.0, 350.0, 5.0, 20.0),
                                met_row(5 * 1.9438, 0.0, 5.0, 0.0),
                                met_row(1.0, 1.0, 1.0, 1.0, None)], MET)
    got = true_wind(df, corrected_direction=True).collect()
    assert len(got) == 2 and "...1" not in got[0]
    assert (got[0].true_wd, got[0].true_wd_towards) == (10.0, 190.0)
    assert got[0].true_wd_corrected == pytest.approx(10.0) and got[0].ws == pytest.approx(5.0)
    # a headwind equal to the ship's speed is no wind
    assert (got[1].u, got[1].v, got[1].ws) == pytest.approx((0, 0, 0), abs=1e-9)


def test_wind_average_equals_separate_averages(spark):
    rows = [met_row(float(i), (i * 37.0) % 360, 1.0 + i % 5, (i * 51.0) % 360) for i in range(40)]
    met = true_wind(spark.createDataFrame(rows, MET))
    both = wind_average(met).first()
    rel = time_average(met.select("date", "rel_wd", "rel_ws"), wind=[("rel_wd", "rel_ws")],
                       vector_ws=True).first()
    assert (both.rel_wd, both.rel_ws) == pytest.approx((rel.rel_wd, rel.rel_ws))
    assert both.rel_ws <= 3.1  # never above the mean speed
    assert "u" not in wind_average(met).columns
