"""Ordered operators against plain Python, under every way of cutting a series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators import scan as S
from driftline.operators.scan import Order

ORDER = Order(time="date", ties=("k",), series=("s",))
SCHEMA = "s string, k long, date timestamp_ntz, z int, x double, r int"
SCANS = ("series", "day", "hour", "range")


def make_rows(seed):
    """Three series, one holding most rows; gaps over days; runs across slices."""
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 400), ("b", 30), ("c", 1)):
        now, z = datetime(2022, 6, 1, 22), 0
        for k in range(n):
            now += timedelta(seconds=rng.choice([0, 10, 10, 10, 600, 40_000 if k % 50 == 0 else 10]))
            if rng.random() < 0.1:
                z = 1 - z
            rows.append((s, k, now, None if rng.random() < 0.04 else z,
                         None if rng.random() < 0.7 else round(rng.uniform(-5, 5), 3),
                         rng.randint(0, 3)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[1])
def rows(request):
    return make_rows(request.param)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(params=SCANS)
def scan(request, monkeypatch):
    monkeypatch.setattr(S, "MAX_SLICE_ROWS", 60)
    if request.param == "range":
        original = S.slice_series
        monkeypatch.setattr(S, "slice_series",
                            lambda df, order, scan: original(df, order, scan, 60))
    return request.param


def by_series(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def expect_runs(series):
    run_no = ident = carried = 0
    out, prev = [], "none"
    for i, row in enumerate(series):
        z = row[3]
        if prev == "none" or z is None or prev != z:
            run_no += 1
            if z == 1:
                carried += 1
        ident = carried if z == 1 else 0
        out.append([i + 1, run_no, ident, carried])
        prev = z
    for col in (1, 3):  # bounds of runs and of carried groups
        for r in out:
            same = [o[0] for o in out if o[col] == r[col]]
            r += [min(same), max(same)]
    others = [o[0] for o in out if o[2] == 0]
    for r in out:
        r += [sum(1 for p in others if p <= r[0]), len(others)]
    return [tuple(r) for r in out]


def collect(df, *cols):
    return {(r["s"], r["k"]): tuple(r[c] for c in cols) for r in df.select("s", "k", *cols).collect()}


def test_runs_everything(frame, rows, scan):
    sliced = S.slice_series(frame, ORDER, scan)
    got = collect(S._runs(sliced, "z", 1).df, *S._RUN_COLUMNS)
    assert len(got) == len(rows)
    for name, series in by_series(rows).items():
        for row, want in zip(series, expect_runs(series)):
            have = got[name, row[1]]
            # runs: position, number, id, carried, run bounds, group bounds, others
            assert have == want, (scan, name, row)


def test_run_table(frame, rows, scan):
    got = {(r.s, r.id): (r.start_idx, r.end_idx, r.n)
           for r in S.runs(frame, "z", ORDER, value=1, scan=scan).collect()}
    want = {}
    for name, series in by_series(rows).items():
        for r in expect_runs(series):
            if r[2]:
                want[name, r[2]] = (r[4], r[5], r[5] - r[4] + 1)
    assert got == want
    lengths = {(r.s, r.id): r.n for r in S.run_lengths(frame, "z", 1, ORDER, scan).collect()}
    assert lengths == {k: v[2] for k, v in want.items()}


def test_position_sum_diff(frame, rows, scan):
    pos = collect(S.with_position(frame, ORDER, scan=scan), "idx")
    total = collect(S.running_sum(frame, F.col("r"), "t", ORDER, scan), "t")
    change = collect(S.diff(frame, "x", ORDER, scan=scan), "diff")
    for name, series in by_series(rows).items():
        running, before = 0, None
        for i, row in enumerate(series):
            running += row[5]
            key = name, row[1]
            assert pos[key] == (i + 1,)
            assert total[key] == (running,)
            want = None if i == 0 or before is None or row[4] is None else row[4] - before
            assert change[key] == (want,)
            before = row[4]


def test_locf(frame, rows, scan):
    got = collect(S.locf(frame, ["x", "z"], ORDER, suffix="_f", scan=scan), "x_f", "z_f")
    for name, series in by_series(rows).items():
        x = z = None
        for row in series:
            x = row[4] if row[4] is not None else x
            z = row[3] if row[3] is not None else z
            assert got[name, row[1]] == (x, z)


@pytest.mark.parametrize("mode", ["position", "time"])
def test_interpolate(frame, rows, scan, mode):
    got = collect(S.interpolate(frame, "x", ORDER, x=mode, scan=scan), "x")
    for name, series in by_series(rows).items():
        place = [i if mode == "position" else (r[2] - datetime(2022, 1, 1)).total_seconds()
                 for i, r in enumerate(series)]
        known = [i for i, r in enumerate(series) if r[4] is not None]
        for i, row in enumerate(series):
            lo = max((k for k in known if k <= i), default=None)
            hi = min((k for k in known if k >= i), default=None)
            have = got[name, row[1]][0]
            if lo is None or hi is None:
                assert have is None
            elif place[lo] == place[hi]:
                assert have == series[lo][4]
            else:
                want = series[lo][4] + (series[hi][4] - series[lo][4]) \
                    * (place[i] - place[lo]) / (place[hi] - place[lo])
                assert have == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("grouping", ["run", "carry"])
def test_group_positions(frame, rows, scan, grouping):
    got = collect(S.with_run_position(frame, "z", 1, ORDER, grouping, scan),
                  "id", "from_start", "from_end")
    for name, series in by_series(rows).items():
        ids = [r[2 if grouping == "run" else 3] for r in expect_runs(series)]
        for i, row in enumerate(series):
            members = [j for j, ident in enumerate(ids) if ident == ids[i]]
            want = (ids[i], members.index(i) + 1, len(members) - members.index(i))
            assert got[name, row[1]] == want


def test_auto_takes_the_coarsest_cut_that_fits(spark, frame):
    sizes = S.measure(frame, ORDER)
    assert sizes["total"] == 431 and sizes["series"] == 400
    assert not S.slice_series(frame, ORDER, "auto", 400).cut
    assert S.slice_series(frame, ORDER, "auto", sizes["day"]).df.schema["__slice"]
    one = spark.range(100).select(F.lit("a").alias("s"), F.col("id").alias("k"),
                                  F.expr("TIMESTAMP_NTZ '2022-01-01'").alias("date"))
    # a hundred rows at one instant: only splitting them by their tie-breaker is enough
    cut = S.slice_series(one, ORDER, "auto", 20)
    largest = cut.df.groupBy("__slice").count().agg(F.max("count")).first()[0]
    assert largest <= 20


def test_crowded_hours_are_split_by_values(spark):
    """A third of all rows at one instant, an hour too full, and a null series among them."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 7 != 0, F.lit("a")).alias("s"), F.col("id").alias("k"),
        F.expr("TIMESTAMP_NTZ '2022-01-01' + make_dt_interval(0, 0, 0, "
               "if(id % 3 = 0, 100, cast(id as int)))").alias("date"))
    cut = S.slice_series(df, ORDER, "range", 30)
    sizes = cut.df.groupBy("s", "__slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 30
    assert cut.df.count() == 6000
    again = S.slice_series(df.repartition(3, "k"), ORDER, "range", 30).df
    first = {r.k: r["__slice"] for r in cut.df.select("k", "__slice").collect()}
    assert first == {r.k: r["__slice"] for r in again.select("k", "__slice").collect()}
    # slices follow each other in the order of rows
    rows = sorted(cut.df.filter("s = 'a'").collect(), key=lambda r: (r.date, r.k))
    places = [r["__slice"] for r in rows]
    assert places == sorted(places)
    assert not cut.df.inputFiles()  # nothing was staged


def test_rows_that_share_their_place_are_refused(spark):
    df = spark.range(50).select(F.lit("a").alias("s"), F.lit(1).alias("k"),
                                F.expr("TIMESTAMP_NTZ '2022-01-01'").alias("date"))
    with pytest.raises(ValueError, match="share one place"):
        S.slice_series(df, ORDER, "range", 20)


def test_single_series_without_keys(spark):
    df = spark.createDataFrame(
        [(datetime(2022, 1, 1, 23, 59, 50) + timedelta(seconds=10 * i), z)
         for i, z in enumerate([0, 1, 1, 1, 0, 1])], "date timestamp_ntz, z int")
    for scan in SCANS:
        got = [r.id for r in S.run_id(df, "z", 1, Order(), scan=scan).orderBy("date").collect()]
        assert got == [0, 1, 1, 1, 0, 2], scan


def test_rows_without_an_instant_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (datetime(2022, 1, 1), 2), (datetime(2022, 1, 3), 3)],
                               "date timestamp_ntz, k int")
    for scan in SCANS:
        got = [r.idx for r in S.with_position(df, Order(ties=("k",)), scan=scan)
               .orderBy("k").collect()]
        assert got == [1, 2, 3], scan


def test_null_series_is_one_series_under_every_cut(spark):
    rows = [(None if i % 3 else "s", datetime(2022, 1, 1 + i // 5, i % 24), i, i % 2)
            for i in range(24)]
    df = spark.createDataFrame(rows, "s string, date timestamp_ntz, v int, status int")
    order = Order(time="date", ties=("v",), series=("s",))
    sparse = df.withColumn("v2", F.expr("if(v % 4 = 1, v, null)"))

    def found(cut):
        frames = [S.with_position(df, order, scan=cut).select("v", "idx"),
                  S.locf(sparse, "v2", order, scan=cut).select("v", "v2"),
                  S.diff(df, "v", order, scan=cut).select("v", "diff"),
                  S.interpolate(sparse, "v2", order, scan=cut).select("v", "v2"),
                  S.running_sum(df, F.col("v"), "t", order, scan=cut).select("v", "t")]
        return [sorted(map(tuple, f.collect())) for f in frames]

    whole = found("series")
    assert all(found(cut) == whole for cut in ("day", "hour", "range"))
