"""Rule tables, resolved and met, against a plain loop over rules."""

import random
from datetime import datetime, timedelta

import pytest

from driftline.operators import rule_tables
from driftline.operators.intervals import Interval, tag_intervals

START = datetime(2022, 5, 1)
SCHEMA = "start timestamp_ntz, end timestamp_ntz, label string, p int, closed boolean"


def rules_of(n, seed, instants=200):
    rng = random.Random(seed)
    at = lambda: START + timedelta(minutes=rng.randrange(instants))
    rows = []
    for i in range(n):
        lo = None if rng.random() < 0.03 else at()
        hi = None if rng.random() < 0.03 else (lo or START) + timedelta(
            minutes=rng.choice([-3, 0, 1, 5, 50, 150]))
        rows.append((lo, hi, None if rng.random() < 0.1 else f"r{rng.randrange(30)}",
                     None if rng.random() < 0.1 else rng.randrange(40),
                     rng.choice([True, False, None])))
    return rows


def plain(rules, t, default=None):
    """The label of the best rule that holds ``t``."""
    if t is None:
        return default
    found = []
    for lo, hi, label, p, closed in rules:
        inside = (lo is None or (t >= lo if closed else t > lo)) and \
            (hi is None or (t <= hi if closed else t < hi))
        if inside and label is not None:
            found.append((p is None, p or 0, label))
    return min(found)[2] if found else default


@pytest.fixture(scope="module")
def instants(spark):
    rows = [(i, START + timedelta(seconds=30 * i), "x") for i in range(-20, 460)]
    rows += [(1000 + i, START + timedelta(minutes=40), "crowd") for i in range(300)]
    rows += [(2000, None, None), (2001, None, "y")]
    return spark.createDataFrame(rows, "k int, date timestamp_ntz, label string").withColumnRenamed(
        "label", "lo")  # a name the stretches use as well


@pytest.mark.parametrize("n, few, cuts, range_rows", [
    (0, 100, 100, 100), (1, 0, 100, 100), (60, 10_000, 7, 100), (60, 0, 7, 50),
    (400, 5, 11, 64), (400, 0, 10_000, 10_000)])
def test_tags_as_a_loop_would(spark, instants, n, few, cuts, range_rows, monkeypatch):
    made = rules_of(n, seed=n + few)
    table = spark.createDataFrame(made, SCHEMA)
    monkeypatch.setattr(rule_tables, "RANGE_CUTS", cuts)
    monkeypatch.setattr(rule_tables.resolve_intervals, "__defaults__",
                        (*rule_tables.resolve_intervals.__defaults__[:-1], cuts))
    got = rule_tables.tag_by_table(instants, table, "tag", default="none", few=few,
                                   range_rows=range_rows)
    assert got.columns == ["k", "date", "lo", "tag"]
    want = {r.k: plain(made, r.date, "none") for r in instants.collect()}
    rows = got.collect()
    assert {r.k: r.tag for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("cuts", [5, 1000])
def test_stretches_do_not_overlap(spark, cuts):
    made = rules_of(300, seed=1)
    found = rule_tables.resolve_intervals(spark.createDataFrame(made, SCHEMA), cuts=cuts)
    rows = sorted(tuple(r) for r in found.collect())
    assert all(a[0] < a[1] <= b[0] for a, b in zip(rows, rows[1:]))
    seconds = rule_tables.stretch_bounds(found).collect()
    for r in seconds:
        inside = (r.start or r.end - timedelta(days=9)) + timedelta(microseconds=0)
        assert plain(made, inside) == r.label
    covered = sum(plain(made, START + timedelta(seconds=s, microseconds=1)) is not None
                  for s in range(0, 20_000, 60))
    assert covered == sum(any(lo <= x < hi for lo, hi, _ in rows) for x in (
        int((START + timedelta(seconds=s, microseconds=1) - datetime(1970, 1, 1))
            / timedelta(microseconds=1)) for s in range(0, 20_000, 60)))


def test_crowd_of_rules_meets_once_per_range(spark):
    """Rules that start together with ends far apart are one row where they start."""
    rules = spark.range(5000).selectExpr(
        "TIMESTAMP_NTZ '2022-05-01' as start",
        "TIMESTAMP_NTZ '2022-06-01' + make_dt_interval(0, 0, 0, cast(id as decimal(18,6))) as end",
        "concat('r', id) as label", "cast(5000 - id as int) as p")
    found = rule_tables.resolve_intervals(rules, cuts=100)
    rows = sorted(tuple(r) for r in found.collect())
    assert {r[2] for r in rows} == {"r4999"}  # the best rule is the longest
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_same_as_a_list(spark, instants):
    listed = [Interval("2022-05-01 00:10:00", "2022-05-01 01:00:00", 3, closed=True),
              Interval("2022-05-01 00:30:00", None, 2), Interval(None, "2022-05-01 00:05:00", 1)]
    table = spark.createDataFrame(
        [(i, r.start, r.end, r.label, r.closed) for i, r in enumerate(listed)],
        "p int, start string, end string, label int, closed boolean").selectExpr(
        "p", "cast(start as timestamp_ntz) start", "cast(end as timestamp_ntz) end", "label", "closed")
    want = {r.k: r.flag for r in tag_intervals(instants, listed, "flag", 0).collect()}
    for few in (0, 100):
        got = rule_tables.flag_by_table(instants, table, "flag", few=few)
        assert dict(got.dtypes)["flag"] == "int"
        assert {r.k: r.flag for r in got.collect()} == want
