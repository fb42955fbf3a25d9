"""What the physical plans must and must not contain."""

import os

import pytest

from driftline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hourly_product", "minute_product", "interpolate_by_day",
                                  "interval_tag_many_rules", "station_zero_medians",
                                  "align_full_unique_minutes", "calibration_from_sensitivity_pooled",
                                  "interpolated_zero_by_day", "station_median_bracketed"])
def test_no_products_of_rows_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython",
                 "MapInPandas", "FlatMapGroups"):
        assert node not in text


@pytest.mark.parametrize("name", ["run_ids_by_day", "interpolate_by_day", "locf_by_day",
                                  "diff_by_day", "row_position_by_day"])
def test_rows_are_shuffled_by_slice_only(spark, name):
    lines = plan(catalog.QUERIES[name](spark, SF)).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:  # one row per slice, already aggregated
            assert "Aggregate(key" in lines[i + 1] and "=[__slice" in lines[i + 1]
    assert any("hashpartitioning(__slice" in line for line in lines)
    assert not any("unboundedfollowing" in line for line in lines)


def test_tags_do_not_shuffle(spark):
    for name in ("interval_tag", "instrument_flags", "stack_flags", "offset_apply"):
        assert "Exchange" not in plan(catalog.QUERIES[name](spark, SF))


def test_scans_read_the_columns_they_need(spark):
    text = plan(catalog.QUERIES["wind_vector_mean"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_one_shuffle_per_time_average(spark):
    assert plan(catalog.QUERIES["wind_minutes"](spark, SF)).count("Exchange hashpartitioning") == 1
    # three tables, each shuffled for its average, then all of them once
    text = plan(catalog.QUERIES["align_full_unique_minutes"](spark, SF))
    assert text.count("Exchange hashpartitioning(date") == 1


def test_flag_rules_are_not_pushed_to_raw_rows(spark):
    text = plan(catalog.QUERIES["hourly_product"](spark, SF))
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert filters and not any("2022-05-21" in line for line in filters)
