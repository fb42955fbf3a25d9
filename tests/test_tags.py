"""Labels, flags and masks on hand-computed rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.functions import cond
from driftline.operators import align, intervals, rows, zeroes
from driftline.operators.intervals import Interval, Value
from driftline.plans import products, rules


def tag_one(spark, fn, col, date, **values):
    names = ["date", *values]
    types = ", ".join(["date timestamp_ntz", *[f"{k} double" for k in values]])
    df = spark.createDataFrame([(datetime.fromisoformat(date), *values.values())], types)
    return fn(df).select(*names, col).first()[col]


@pytest.mark.parametrize("date, station", [
    ("2022-05-20 20:14:59", "Reykjavik"), ("2022-05-20 20:15:00", "Sailing 1"),
    ("2022-05-23 06:15:00", "Sailing 1"), ("2022-05-23 06:15:01", "East Greenland"),
    ("2022-06-16 09:00:00", "Maniitsoq 2"), ("2022-06-16 09:00:01", "Sailing home")])
def test_station_edges(spark, date, station):
    assert tag_one(spark, products.tag_station, "station", date) == station


@pytest.mark.parametrize("flag, date, values, want", [
    ("flag_all", "2022-06-11 13:33:00", {}, 0), ("flag_all", "2022-06-11 13:33:01", {}, 1),
    ("flag_all", "2022-06-11 13:37:00", {}, 0), ("noy_cal", "2022-06-18 12:00:00", {}, 0),
    ("co_flag", "2022-06-01 00:00:00", {"co": 250.0}, 0),
    ("co_flag", "2022-06-01 00:00:00", {"co": 250.1}, 1),
    ("noy_flag", "2022-06-01 00:00:00", {"noy": 1.0, "no": 1.0, "no2": 1.0}, 1),
    ("noy_flag", "2022-06-01 00:00:00", {"noy": 2.0, "no": 0.5, "no2": 0.5}, 0),
    ("noy_flag", "2022-06-01 00:00:00", {"no": 0.5, "no2": 0.5}, 0)])
def test_instrument_flags(spark, flag, date, values, want):
    row = {"co": None, "noy": None, "no": None, "no2": None, **values}
    assert tag_one(spark, products.instrument_flags, flag, date, **row) == want


@pytest.mark.parametrize("ws, wd, code", [
    (2.0, 180.0, 1), (5.0, 157.5, 0), (5.0, 157.6, 2), (5.0, 202.5, 0), (None, None, 0)])
def test_stack_flag(spark, ws, wd, code):
    # no plume window holds this instant
    assert tag_one(spark, products.stack_flags, "stack_flag", "2022-06-02 00:00:00",
                   rel_ws=ws, rel_wd=wd) == code


def test_plume_windows_are_closed(spark):
    for date, code in (("2022-05-22 19:50:00", 3), ("2022-05-22 23:45:00", 3),
                       ("2022-05-22 23:45:01", 0), ("2022-05-23 01:00:00", 4)):
        assert tag_one(spark, products.stack_flags, "stack_flag", date,
                       rel_ws=5.0, rel_wd=0.0) == code


def test_versions_differ_where_they_should(spark):
    date = "2022-06-11 11:00:00"
    for version, want in (("current", 1), ("v2", 0), ("v1", 0)):
        got = tag_one(spark, lambda d: products.instrument_flags(d, version), "co_flag", date,
                      co=1.0, noy=9.0, no=1.0, no2=1.0)
        assert got == want
    old = tag_one(spark, lambda d: products.instrument_flags(d, "v2"), "o3_flag",
                  "2022-06-20 10:00:00")
    assert old == 2


def test_rule_counts_and_warnings():
    assert len(rules.stations()) == 16 and len(rules.plume_rules()) == 55
    assert sum(map(len, rules.flag_rules().values())) == 31
    assert len(rules.offsets()) == 31 and len(rules.zeroing_flag()) == 12
    assert len(intervals.check_rules(rules.flag_rules()["noy_cal"])) == 2
    assert not intervals.check_rules(rules.plume_rules())


def test_segments_give_the_same_labels_as_the_chain(spark):
    rng = random.Random(5)
    base = datetime(2022, 5, 1)

    def moment():
        return base + timedelta(minutes=rng.randint(0, 6000))

    made = [Interval(None, str(base + timedelta(hours=3)), "early"),
            Interval(str(base + timedelta(hours=90)), None, "late")]
    for i in range(60):
        lo, hi = moment(), moment()  # some end before they start
        made.append(Interval(str(lo), str(hi), f"r{i % 9}", closed=rng.random() < 0.5))
    edges = [datetime.fromisoformat(t) for r in made for t in (r.start, r.end) if t]
    dates = [d + timedelta(microseconds=m) for d in edges for m in (-1, 0, 1)] + [None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "k int, date timestamp_ntz")
    chain = intervals.tag_intervals(df, made, "l", "none")
    table = intervals.tag_intervals(df, made, "l", "none", limit=0)
    assert sorted(chain.collect()) == sorted(table.collect()) or \
        {r.k: r.l for r in chain.collect()} == {r.k: r.l for r in table.collect()}
    assert table.count() == len(dates)


def test_long_lists_mean_the_same(spark):
    """Value rules and mixed labels, as conditions and through the segment table."""
    df = spark.createDataFrame(
        [(datetime(2022, 1, 1) + timedelta(hours=7 * i), i) for i in range(120)] + [(None, 3)],
        "date timestamp_ntz, co int")
    many = [Interval(str(datetime(2022, 1, 1) + timedelta(days=i % 40)),
                     str(datetime(2022, 1, 1) + timedelta(days=i % 40 + 2 + i % 3)), f"r{i}")
            for i in range(201)]
    mixed = [Value("co % 11 = 0", 7), *many, Value("co > 100", "high"), Interval(None, None, 5)]
    short = intervals.tag_intervals(df, mixed, "l", default=0, limit=1000)
    long = intervals.tag_intervals(df, mixed, "l", default=0)
    assert dict(short.dtypes)["l"] == dict(long.dtypes)["l"] == "string"
    assert sorted(map(tuple, short.collect()), key=str) == sorted(map(tuple, long.collect()), key=str)
    assert "Exchange hash" not in long._jdf.queryExecution().executedPlan().toString()


def test_numeric_labels_through_segments(spark):
    df = spark.createDataFrame([(datetime(2022, 6, 13),), (datetime(2022, 6, 1),)],
                               "date timestamp_ntz")
    got = intervals.flag_intervals(df, rules.pollution(), "poll", limit=0).orderBy("date")
    assert [r.poll for r in got.collect()] == [0, 1]


def test_unknown_values(spark):
    df = spark.createDataFrame([(0.001, 1, 5.0), (0.01, 0, 5.0), (None, None, 5.0)],
                               "no double, zero int, v double")
    got = df.select(cond.below_limit(F.col("no"), 0.00687).alias("f"),
                    cond.masked(F.col("v"), [F.col("zero")], "keep").alias("keep"),
                    cond.masked(F.col("v"), [F.col("zero")], "drop").alias("drop")).collect()
    assert [tuple(r) for r in got] == [(1, None, None), (0, 5.0, 5.0), (None, 5.0, None)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),)], "co double")
    clean = rows.nan_as_null(df).withColumn("date", F.expr("TIMESTAMP_NTZ '2022-06-01'"))
    clean = clean.withColumns({c: F.lit(None).cast("double") for c in ("no", "no2", "noy")})
    got = products.instrument_flags(clean).first()
    assert got.co is None and got.co_flag == 0


def test_reject_and_mask_interval(spark):
    df = spark.createDataFrame([(0.2,), (0.3,), (-0.3,), (None,)], "m double")
    assert [r.m for r in rows.clip_to_null(df, "m", -0.25, 0.25).collect()] == [0.2, None, None, None]
    df = spark.createDataFrame([(datetime(2022, 6, 10, 6), 1.0), (datetime(2022, 6, 10, 12, 30), 2.0),
                                (datetime(2022, 6, 10, 12, 31), 3.0)], "date timestamp_ntz, ws double")
    assert [r.ws for r in rows.mask_interval(df, "ws", *rules.WS_MASK).collect()] == [None, None, 3.0]


def test_override_flag(spark):
    df = spark.createDataFrame(
        [(datetime(2022, 6, 15, 10, 10), 1, 0), (datetime(2022, 6, 15, 10, 35), 1, 0),
         (datetime(2022, 6, 15, 10, 35), 1, 1), (datetime(2022, 6, 15, 10, 35), 1, None)],
        "date timestamp_ntz, nox_cal int, zero_box int")
    got = rows.override_flag(df, "nox_cal", rules.NO_CAL_OVERRIDES, "zero_box").collect()
    assert [r.nox_cal for r in got] == [0, 1, 0, None]


def test_names_and_empties(spark):
    df = spark.createDataFrame([("a", None, 1, None), (None, None, None, None)],
                               "`The Time` string, `O3 %` double, theTime int, x double")
    named = rows.clean_names(df)
    assert named.columns == ["the_time", "o3_percent", "the_time_2", "x"]
    kept = rows.remove_empty(named)
    assert kept.columns == ["the_time", "the_time_2"] and kept.count() == 1
    with pytest.raises(ValueError):
        rows.rename_channels(named, {"nothing": "y"})


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows.assert_unique(df, ["k"]) is df
    with pytest.raises(ValueError):
        rows.assert_unique(df.union(df), ["k"])


def test_tagging_keeps_every_row(spark):
    df = spark.range(500).select(F.expr(
        "TIMESTAMP_NTZ '2022-05-15' + make_dt_interval(0, cast(id * 2 as int), 0, 0)").alias("date"),
        F.lit(1.0).alias("no"), F.lit(1.0).alias("no2"), F.lit(3.0).alias("noy"),
        F.lit(100.0).alias("co"), F.lit(5.0).alias("rel_ws"), F.lit(0.0).alias("rel_wd"))
    assert products.flagged_table(df).count() == 500


def test_clean_names_never_repeat(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `A` int, a_2 int")
    assert len(set(rows.clean_names(df.toDF("a", "A ", "a_2")).columns)) == 3


def test_unique_align_refuses_repeats(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "date int, x int")
    b = spark.createDataFrame([(1, 5), (2, 6)], "date int, y int")
    with pytest.raises(Exception, match="repeats a key"):
        align.align_full([a, b], unique=True).collect()
    assert align.align_full([a.limit(1), b], unique=True).count() == 2


def test_older_mask_needs_its_flags(spark):
    df = spark.createDataFrame([(1.0, 0)], "co double, co_flag int")
    with pytest.raises(ValueError, match="co_cal"):
        products.qc_mask_older(df)
    assert products.qc_mask_older(df, skip=["co_cal", "flag_all"]).first().co == 1.0


def brute_full(tables):
    """A fold of full joins over lists of (key, value)."""
    done = [(k, (v,)) for k, v in tables[0]]
    for n, table in enumerate(tables[1:], 1):
        out = []
        for k, vs in done:
            met = [v for other, v in table if other is not None and other == k]
            out += [(k, (*vs, v)) for v in met or [None]]
        known = {k for k, _ in done if k is not None}
        out += [(k, (None,) * n + (v,)) for k, v in table if k not in known]
        done = out
    return sorted(done, key=str)


@pytest.mark.parametrize("key_rows", [1, 2, 3, 1000])
def test_many_tables_multiply_their_repeats(spark, key_rows):
    rng = random.Random(key_rows)
    data = [[(rng.choice([None, 1, 2, 3, 4, 4, 4]), rng.randrange(3)) for _ in range(n)]
            for n in (12, 9, 0, 14)]
    frames = [spark.createDataFrame(rows, f"date int, v{i} int").repartition(3)
              for i, rows in enumerate(data)]
    got = align.align_full(frames, key_rows=key_rows)
    assert got.columns == ["date", "v0", "v1", "v2", "v3"]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted(((r[0], tuple(r[1:])) for r in got.collect()), key=str) == brute_full(data)


def test_offsets_of_an_unknown_key(spark):
    df = spark.createDataFrame([("a", 5.0), (None, 7.0), ("b", 1.0)], "station string, no double")
    table = spark.createDataFrame([("a", 1.0), (None, 2.0)], "station string, no double")
    got = zeroes.apply_offset_table(df, table, ["no"])
    assert {r.station: r.no_corr for r in got.collect()} == {"a": 4.0, None: 5.0, "b": None}
    assert [r.station for r in zeroes.missing_keys(df, table).collect()] == ["b"]
    assert [r.station for r in zeroes.missing_keys(df, table.where("station = 'a'")).orderBy(
        "station").collect()] == [None, "b"]
