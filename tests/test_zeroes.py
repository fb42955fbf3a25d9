"""Zero levels, statistics, detection limits and calibrations on small series."""

import math
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators import calibration, groups, scan, zeroes
from driftline.operators.intervals import Interval
from driftline.operators.scan import Order
from driftline.plans import products, rules

ORDER = Order(time="date", ties=())
START = datetime(2022, 6, 1, 23, 59)


def series(spark, **columns):
    names = list(columns)
    length = len(columns[names[0]])
    types = ", ".join(["date timestamp_ntz"] + [
        f"{n} {'int' if n in ('zero_box', 'nox_cal', 'r') else 'double'}" for n in names])
    rows = [(START + timedelta(seconds=10 * i), *[columns[n][i] for n in names])
            for i in range(length)]
    return spark.createDataFrame(rows, types)


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_offsets(spark):
    df = spark.createDataFrame([("Nuuk", 1.0, 1.0), ("Sailing 3", 1.0, 9.0), ("Reykjavik", 1.0, 1.0)],
                               "station string, no double, no2 double")
    got = {r.station: r for r in zeroes.apply_offsets(df, rules.offsets()).collect()}
    assert got["Nuuk"].no_corr == pytest.approx(1.044)
    assert got["Nuuk"].no2_corr == pytest.approx(1.144)
    assert got["Sailing 3"].no2_corr == pytest.approx(1.144)
    assert got["Reykjavik"].no2_corr is None and got["Reykjavik"].no_corr == pytest.approx(1.5)
    fixed = {r.station: r for r in
             zeroes.apply_offsets(df, rules.offsets(), fix_sources=True).collect()}
    assert fixed["Sailing 3"].no2_corr == pytest.approx(9.144)


def test_run_fixtures(spark):
    for status, want in (([0, 1, 1, 0, 1, 1, 1, 0], [0, 1, 1, 0, 2, 2, 2, 0]),
                         ([1, None, 1], [1, 0, 2]), ([1, 0, 1], [1, 0, 2])):
        df = series(spark, zero_box=status)
        assert column(scan.run_id(df, "zero_box", 1, ORDER), "id") == want
    lengths = scan.run_lengths(series(spark, zero_box=[0, 1, 1, 0, 1, 1, 1, 0]), "zero_box", 1, ORDER)
    assert {r.id: r.n for r in lengths.collect()} == {1: 2, 2: 3}


def test_one_run_over_many_days(spark):
    df = spark.range(400).select(
        F.expr("TIMESTAMP_NTZ '2022-06-01' + make_dt_interval(0, 0, cast(id * 15 as int), 0)")
        .alias("date"), F.lit(1).alias("zero_box"), F.col("id").cast("double").alias("no"))
    for how in ("day", "hour"):
        assert [(r.start_idx, r.end_idx) for r in
                scan.runs(df, "zero_box", ORDER, 1, how).collect()] == [(1, 400)]
        got = zeroes.run_statistic(df, ["no"], "zero_box", ORDER, scan=how)
        assert got.select("zero_no").distinct().collect()[0].zero_no == 199.5


def test_trim(spark):
    df = series(spark, nox_cal=[1] * 10 + [0] * 2, no=[float(i) for i in range(1, 13)])
    got = column(scan.trim_runs(df, ["no"], "nox_cal", 1, ORDER, 6, 2), "no")
    assert got == [None] * 6 + [7.0, 8.0] + [None] * 2 + [11.0, 12.0]
    everything = scan.trim_runs(df, ["no"], "nox_cal", 1, ORDER, 6, 2, background=True)
    assert column(everything, "no")[10:] == [None, None]


@pytest.mark.parametrize("how", ["auto", "day", "hour", "range"])
def test_interpolated_zero(spark, how):
    status = [1, 1, 0, 0, 0, 1, 0, 1]
    no = [1.0, 3.0, 10.0, 10.0, 10.0, 6.0, 10.0, 90.0]
    df = series(spark, zero_box=status, no=no)
    got = zeroes.interpolated_zero(df, ["no"], "zero_box", ORDER, reject={"no": (None, 50)}, scan=how)
    assert column(got, "zero_no") == [2, 2, 3, 4, 5, 6, None, None]
    assert column(got, "no_corr") == [-1, 1, 7, 6, 5, 0, None, None]
    assert column(got, "id") == [1, 1, 0, 0, 0, 2, 0, 3]


def test_interpolated_zero_strict_and_skipping(spark):
    df = series(spark, zero_box=[1, 1, 0, 1], no=[1.0, None, 10.0, 6.0])
    strict = zeroes.interpolated_zero(df, ["no"], "zero_box", ORDER, strict=True)
    assert column(strict, "zero_no") == [None, None, None, 6]
    skipping = zeroes.interpolated_zero(df, ["no"], "zero_box", ORDER)
    assert column(skipping, "zero_no") == [1, 1, 3.5, 6]
    without = zeroes.interpolated_zero(df, ["no"], "zero_box", ORDER, skip_ids=[1])
    assert column(without, "zero_no") == [None, None, None, 6]


def test_station_zeroes(spark):
    rows = [("A", 1, 1.0), ("A", 1, 3.0), ("A", 0, 99.0), ("B", 1, 5.0), ("B", 1, None), ("B", 0, 1.0),
            ("C", 1, 7.0)]
    df = spark.createDataFrame([(START + timedelta(seconds=i), *r) for i, r in enumerate(rows)],
                               "date timestamp_ntz, station string, zero_box int, no double")
    mean = zeroes.station_zeroes(df, ["no"], ORDER, exclude_stations=["C"])
    assert {r.station: r.no for r in mean.collect()} == {"A": 2.0, "B": None}
    median = zeroes.station_zeroes(df, ["no"], ORDER, stat="median", exclude_ids=[1])
    assert {r.station: r.no for r in median.collect()} == {"B": 5.0, "C": 7.0}
    missing = zeroes.missing_keys(df, mean)
    assert [r.station for r in missing.collect()] == ["C"]


def test_bracketed_median_is_exact(spark):
    # one group holds most rows, with many ties; large enough for a real bracket
    df = spark.range(130_001).select(
        F.when(F.col("id") % 13 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "b")
        .otherwise("a").alias("g"),
        F.when(F.col("id") % 5 != 0, F.floor(F.pow(F.col("id") % 1009, F.lit(1.5)))).cast("double")
        .alias("x"))
    got = {r.g: r.x for r in groups.group_median(df, ["g"], ["x"], max_rows=10).collect()}
    want = {r.g: r.x for r in df.groupBy("g").agg(F.median("x").alias("x")).collect()}
    assert got == want and None in got
    large = df.filter("g = 'a'").union(df.filter("g = 'a'"))
    assert groups.group_median(large, ["g"], ["x"], max_rows=10).first().x == want["a"]


def test_median_exchanges_the_middle_only(spark):
    """Of a large group only the values inside the bracket leave the tasks that read them."""
    df = spark.range(0, 200_000, 1, 8).select(
        (F.col("id") % 2).alias("g"), F.rand(3).alias("x"), (F.col("id") % 977).alias("y"))
    known = df.select("g").distinct()
    bounds = groups.brackets(df, ["g"], ["x", "y"], known, max_rows=2000)
    values = groups.middle_values(df, ["g"], ["x", "y"], bounds)
    assert values.where("__side = 0 and __c = 0").count() < 2 * 2000
    assert values.agg(F.sum("__n")).first()[0] == 400_000
    got = {r.g: (r.x, r.y) for r in groups.group_median(df, ["g"], ["x", "y"], 2000).collect()}
    want = {r.g: (r.x, r.y) for r in df.groupBy("g").agg(F.median("x").alias("x"),
                                                         F.median("y").alias("y")).collect()}
    assert got == want
    # what is exchanged has been grouped by value and side in the task that read it
    plan = groups.group_median(df, ["g"], ["x", "y"], 2000)._jdf.queryExecution().executedPlan().toString()
    below = [plan[i:].split("\n")[1] for i in range(len(plan)) if plan.startswith("Exchange hash", i)]
    assert below and all("Aggregate" in x for x in below)


def test_bad_summaries_do_not_matter(spark, monkeypatch):
    """A summary that misses the middle costs a round, not the answer."""
    df = spark.range(5001).select(F.lit(None).cast("int").alias("g"),
                                  (F.col("id") * 7919 % 5003).cast("double").alias("x"))
    real = groups.F.percentile_approx
    monkeypatch.setattr(groups.F, "percentile_approx", lambda c, q, a: F.transform(
        real(c, q, a), lambda v: v + 4000))
    want = df.agg(F.median("x")).first()[0]
    assert [tuple(r) for r in groups.group_median(df, ["g"], ["x"], 10).collect()] == [(None, want)]
    assert groups.group_median(df, [], ["x"], 10).collect()[0].x == want


def test_median_of_many_columns_and_of_nothing(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5), ("a", 2.0, None), ("a", 2.0, 6), (None, None, 1), (None, None, 4),
         ("c", None, None)], "g string, x double, y int")
    for most in (0, 1_000_000):
        got = {r.g: (r.x, r.y) for r in groups.group_median(df, ["g"], ["x", "y"], most).collect()}
        assert got == {"a": (2.0, 5.5), None: (None, 2.5), "c": (None, None)}
    assert groups.group_median(df.filter("false"), ["g"], ["x"]).count() == 0


def test_distinct_and_lod(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,)], "x double")
    row = groups.distinct_stats(df, ["x"]).first()
    assert (row.x_mean, row.x_sd) == pytest.approx((2, math.sqrt(2)))
    two = spark.createDataFrame([(None, 1, 5.0), (None, 1, None), (None, 3, 5.0), ("a", None, None)],
                                "g string, x int, y double")
    stats = groups.distinct_stats(two, ["x", "y"], ["g"])
    assert {r.g: tuple(r)[1:] for r in stats.collect()} == {
        None: (2.0, pytest.approx(math.sqrt(2)), 5.0, None), "a": (None, None, None, None)}
    assert "Expand" not in stats._jdf.queryExecution().executedPlan().toString()
    no, no2 = [1.0, 1.01, 1.02], [2.0, 2.02, 2.04]
    df = spark.createDataFrame([(4, a, b) for a, b in zip(no, no2)] + [(5, 1.0, 1.0)],
                               "id int, no double, no2 double")
    got = {r.id: r for r in groups.lod(df, "no", "no2", ["id"]).collect()}
    a, b = 2 * statistics.stdev(no), 2 * statistics.stdev(no2)
    assert got[4].no_lod == pytest.approx(a / math.sqrt(6))
    assert got[4].nox_lod == pytest.approx(math.hypot(a, b) / math.sqrt(6))
    assert got[5].no_lod is None  # one row has no deviation


def test_group_mean_strict(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (2, 5.0), (3, None)], "g int, x double")
    strict = {r.g: r.x for r in groups.group_mean(df, ["g"], ["x"], strict=True).collect()}
    skip = {r.g: r.x for r in groups.group_mean(df, ["g"], ["x"]).collect()}
    assert strict == {1: None, 2: 4, 3: None} and skip == {1: 1, 2: 4, 3: None}


def test_calibration_from_sensitivity(spark):
    # constant, two changes, constant; edge of one
    sens = [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 3.0]
    df = series(spark, sens=sens, co=[1.0] * 8 + [None])
    got = calibration.calibration_from_sensitivity(df, "sens", ORDER, edge=1)
    # groups: the first row alone (no change known), rows 2-6, rows 7-9
    assert column(got, "co_cal") == [1, 1, 0, 0, 0, 1, 1, 0, 0]
    pooled = calibration.calibration_from_sensitivity(df, "sens", ORDER, edge=1, carry=False)
    # changing rows 1, 5, 6 are one group: first and last flagged
    assert column(pooled, "co_cal") == [1, 1, 0, 1, 0, 1, 1, 0, 1]


def test_calibration_response(spark):
    df = series(spark, nox_cal=[0] + [1] * 10 + [0, 1], no=[float(i) for i in range(13)],
                zero_box=[0] * 13)
    got = calibration.calibration_response(df, "no", "nox_cal", ORDER)
    assert {r.id: r.no for r in got.collect()} == {1: 7.5, 2: None}


def test_zero_diagnostics(spark):
    df = series(spark, zero_box=[1, 1, 1, 0, 1], no2=[1.0, 2.0, 6.0, 9.0, 5.0])
    df = df.withColumns({"flag_all": F.lit(1), "nox_flag": F.lit(1), "press": F.lit(1.0)})
    drop = [Interval("2022-06-01 23:59:35", None)]
    rows, spread = zeroes.zero_diagnostics(df, "no2", ["press"], ORDER, drop)
    assert column(rows, "flag") == [1] * 5 and column(rows, "zero_flag") == [0, 0, 0, 0, 1]
    assert column(rows, "zero_med_no2") == [2, 2, 2, None, None]
    assert column(rows, "zero_mean_no2_line")[:3] == [3, 3, 3]
    assert spread.first().zero_mean_no2_mean == 3 and spread.first().zero_mean_no2_sd is None


def test_constant_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "no double, no2 double")
    row = zeroes.apply_constant(df, rules.CONSTANT_ZEROES).first()
    assert (row.no_corr, row.no2_corr) == pytest.approx((1.0363139655120056, 1.134759009068831))


def test_computed_offsets_feed_the_correction(spark):
    df = spark.createDataFrame([("A", 3.0), ("Z", 1.0)], "station string, no double")
    table = spark.createDataFrame([("A", 1.0)], "station string, no double")
    got = {r.station: r.no_corr for r in zeroes.apply_offset_table(df, table, ["no"]).collect()}
    assert got == {"A": 2.0, "Z": None}


def test_station_tag_before_zeroes(spark):
    df = series(spark, zero_box=[1, 1], no=[1.0, 2.0])
    got = zeroes.station_zeroes(products.tag_station(df), ["no"], ORDER).first()
    assert (got.station, got.no) == ("Maniitsoq 1", 1.5)
