"""The published tables on a small campaign."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators.align import align_full, align_left
from driftline.operators.rows import bind_rows, species_long, tagged_union
from driftline.operators.wind import true_wind
from driftline.plans import products

START = datetime(2022, 6, 2, 12, 0)  # Maniitsoq 1, inside a listed calm window from 07:15
QUIET = datetime(2022, 6, 8, 20, 0)  # no plume, no flag; sea ice


def campaign(spark, start, minutes=3, zero_in_minute=None):
    """Ten-second samples; one sample of ``zero_in_minute`` is a zero."""
    rows, met = [], []
    for i in range(minutes * 6):
        now = start + timedelta(seconds=10 * i)
        zero = 1 if zero_in_minute is not None and i == zero_in_minute * 6 else 0
        rows.append((now, 1.0, 9.0, 2.0 + i % 2, 1.0, zero, 0, 40.0))
        met.append((now, 60.0, -40.0, 3.0, 90.0, 5.0, 30.0, 1.0, 80.0))
    measured = spark.createDataFrame(
        rows, "date timestamp_ntz, so2 double, noy double, no double, no2 double, zero_box int, "
              "so2_zero_channel int, o3 double")
    met = true_wind(spark.createDataFrame(
        met, "date timestamp_ntz, lat double, long double, speed double, heading double, "
             "rel_ws double, rel_wd double, air_temp double, air_humidity double"))
    co = spark.createDataFrame([(start, 100.0), (start + timedelta(seconds=30), 120.0)],
                               "date timestamp_ntz, co_calibrated double")
    return measured, co, met


def test_minute_product(spark):
    inputs = campaign(spark, QUIET, zero_in_minute=1)
    got = products.minute_product(*inputs).orderBy("date").collect()
    # three minutes, and the half-minute instant at which only CO exists
    assert [r.date.second for r in got] == [0, 30, 0, 0]
    first, only_co, zeroed, last = got
    assert first.co_ppb == 100 and only_co.co_ppb == 120 and only_co.no_ppb is None
    assert first.no_ppb == pytest.approx(2.5 + 0.033) and first.no2_ppb == pytest.approx(1.139)
    assert first.nox_ppb == pytest.approx(first.no_ppb + first.no2_ppb)
    # one zero sample spoils the minute's NO, not its SO2
    assert zeroed.no_ppb is None and zeroed.so2_ppb == 1.0 and zeroed.no_flag is None
    assert (last.no_flag, last.no_lod, last.stack_flag) == (0, 0.00687, 0)
    assert products.minute_product(*inputs).columns == [
        "date", "co_ppb", "so2_ppb", "noy_ppb", "o3_ppb", "no_ppb", "no2_ppb", "nox_ppb",
        "stack_flag", "no_lod", "noy_lod", "no2_lod", "nox_lod", "no_flag", "no2_flag", "noy_flag",
        "nox_flag"]


def test_minute_product_binned_co(spark):
    got = products.minute_product(*campaign(spark, QUIET), bin_first=True).orderBy("date").collect()
    assert [r.co_ppb for r in got] == [110.0, None, None]


def test_hourly_product(spark):
    got = products.hourly_product(*campaign(spark, START, minutes=90)).orderBy("date").collect()
    assert [r.date.hour for r in got] == [12, 13]
    assert got[0].stack_flag == 1.0 and got[0].no_ppb == pytest.approx(2.5 + 0.028)
    assert got[0].co_ppb == 100.0 and got[1].co_ppb is None


def test_hours_without_a_trusted_minute_go(spark):
    start = datetime(2022, 5, 22, 5, 30)  # everything is flagged until 06:00
    hourly = products.hourly_product(*campaign(spark, start, minutes=60)).collect()
    assert [r.date.hour for r in hourly] == [6]
    filtered = products.qc_mask(products.flagged_table(
        products.minute_table(*campaign(spark, start, minutes=60))))
    # 06:00 itself lies outside the open window
    assert filtered.agg(F.min("date")).first()[0] == datetime(2022, 5, 22, 6, 0)


def test_masking_never_adds_values(spark):
    table = products.flagged_table(products.minute_table(*campaign(spark, START, 5, 2)))
    masked = products.qc_mask(table, drop_flag=None)
    before, after = ({c: df.filter(F.col(c).isNotNull()).count() for c in products.SPECIES}
                     for df in (table, masked))
    assert all(after[c] <= before[c] for c in products.SPECIES)
    assert masked.count() == table.count()


def test_so2_tables(spark):
    measured, co, met = campaign(spark, START)
    diag = products.so2_diagnostics(measured.withColumn("t101_022639_boxtemp", F.lit(3.0))).first()
    assert diag.box_temp == 3.0 and diag.samp_flow is None and len(diag) == 9
    flags = products.so2_flags(products.flagged_table(products.minute_table(measured, co, met)))
    assert {(r.flag, r.ship_flag) for r in flags.collect()} == {(0, 1)}


def test_stack_fractions(spark):
    flagged = products.flagged_table(products.minute_table(*campaign(spark, START)))
    row = products.stack_fractions(flagged).first()
    assert (row.share_ws, row.share_no) == (1.0, 0.0)


def test_full_alignment(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "date int, a double")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0)], "date int, b double")
    c = spark.createDataFrame([(3, 300.0), (3, 301.0)], "date int, c double")
    want = {(1, 1.0, None), (2, 2.0, 20.0), (3, None, 30.0)}
    for unique in (False, True):
        assert {tuple(r) for r in align_full([a, b], unique=unique).collect()} == want
    assert align_full([a, b, c]).count() == 4  # a repeated key repeats rows
    assert align_left(a, [b]).count() == 2
    with pytest.raises(ValueError):
        align_full([a, a], unique=True)


def test_long_forms_and_unions(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "date int, no double, o3 double")
    assert {tuple(r) for r in species_long(df, ["no", "o3"]).collect()} == \
        {(1, "no", 1.0), (1, "o3", 2.0)}
    tagged = tagged_union({"NO": (df, "no"), "O3": (df, "o3")})
    assert {(r.species, r.value) for r in tagged.collect()} == {("NO", 1.0), ("O3", 2.0)}
    other = spark.createDataFrame([(2, 5.0)], "date int, y double")
    assert {tuple(r) for r in bind_rows(df, other).collect()} == \
        {(1, 1.0, 2.0, None), (2, None, None, 5.0)}
    with pytest.raises(Exception):
        bind_rows(df, other, strict=True).collect()
