"""Stored slices, scopes and stages."""

import os

import pytest
from pyspark.sql import functions as F

from driftline import session
from driftline.operators import scan, stored, zeroes
from driftline.operators.scan import Order

ORDER = Order(time="date", ties=("k",), series=("s",))


@pytest.fixture
def source(spark, tmp_path):
    df = spark.range(4000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("s"),
        F.expr("TIMESTAMP_NTZ '2022-05-01' + make_dt_interval(0, 0, cast(id as int))").alias("date"),
        (F.floor(F.col("id") / 50) % 3).alias("status"),
        F.when(F.col("id") % 17 == 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    path = str(tmp_path / "source")
    df.write.parquet(path)
    return path


def exchanged(df):
    """The columns that each exchange of the plan carries."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = [p for p in text.split("\n\n") if ") Exchange" in p.split("\n")[0]]
    return [next(x for x in p.split("\n") if x.startswith("Input")) for p in parts]


@pytest.mark.parametrize("max_rows", [2_000_000, 20])
def test_scans_of_stored_slices(spark, source, tmp_path, max_rows):
    df = spark.read.parquet(source)
    path = str(tmp_path / "layout")
    slices = stored.store_slices(df, ORDER, path, source, max_rows=max_rows)
    counts = stored.slice_counts(spark, path)
    assert counts.agg(F.sum("n")).first()[0] == 4000 and counts.agg(F.max("n")).first()[0] <= max(max_rows, 1)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for fn in (lambda x: scan.run_id(x, "status", 1, ORDER),
               lambda x: scan.with_position(x, ORDER),
               lambda x: scan.diff(x, "v", ORDER),
               lambda x: scan.locf(x, ["v"], ORDER),
               lambda x: scan.interpolate(x, ["v"], ORDER, x="time"),
               lambda x: scan.trim_runs(x, ["v"], "status", 2, ORDER, head=2, tail=1),
               lambda x: scan.running_sum(x, F.col("status"), "t", ORDER)):
        got = fn(slices)
        assert same(got.select(*sorted(got.columns)), fn(df).select(*sorted(got.columns)))
        # k is in every row and in no summary
        assert not [x for x in exchanged(got) if " k#" in x or "[k#" in x]
    fn = lambda x: zeroes.run_statistic(x, ["v"], "status", ORDER)
    got = fn(slices)
    assert same(got.select(*sorted(got.columns)), fn(df).select(*sorted(got.columns)))
    assert same(scan.run_lengths(slices, "status", 1, ORDER), scan.run_lengths(df, "status", 1, ORDER))
    with pytest.raises(ValueError, match="stored for"):
        scan.run_id(slices, "status", 1, Order(time="date"))


def test_old_layouts_are_refused(spark, source, tmp_path):
    path = str(tmp_path / "layout")
    stored.store_slices(spark.read.parquet(source), ORDER, path, source)
    again = stored.open_slices(spark, path)
    assert again.df.count() == 4000
    # another session doesn't know the table
    spark.sql(f"DROP TABLE {stored._table_name(path)}")
    assert scan.run_id(stored.open_slices(spark, path), "status", 1, ORDER).count() == 4000
    spark.read.parquet(source).limit(5).write.mode("append").parquet(source)
    with pytest.raises(stored.StaleLayout):
        stored.open_slices(spark, path)
    stored.drop_slices(spark, path)
    assert not os.path.exists(path)


def test_statistics_of_runs_with_an_unknown_series(spark, source):
    df = spark.read.parquet(source)
    for how in ("series", "day", "hour"):
        got = zeroes.run_statistic(df, ["v"], "status", ORDER, scan=how)
        known = got.where("s is null and status = 1").agg(
            F.count("zero_v").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        assert known.n == known.rows > 0


def test_scope_removes_its_stages(spark, source, tmp_path):
    df = spark.read.parquet(source)
    with session.Scope(spark, "zeroes") as outer:
        with session.Scope(spark) as inner:
            session.stage(df)
            assert len(os.listdir(inner.folder)) == 1
        assert not os.path.exists(inner.folder)
        out = zeroes.interpolated_zero(df, ["v"], "status", ORDER, scan="day")
        assert len(os.listdir(outer.folder)) > 0
        out.write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(outer.folder)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000
    with pytest.raises(RuntimeError, match="consumer"):
        with session.Scope(spark) as failed:
            session.stage(df)
            raise RuntimeError("consumer")
    assert not os.path.exists(failed.folder)


def test_remains_of_a_lost_driver_are_listed(spark, source):
    """A scope that was never closed, of an application that is not this one."""
    scope = session.Scope(spark, "lost")
    gone = scope.folder.replace(spark.sparkContext.applicationId, "app-1")
    spark.read.parquet(source).write.parquet(f"{gone}/stage-x")
    with scope:
        session.stage(spark.read.parquet(source))
        found = [x for x in session.leftovers(spark) if x.folder.endswith(os.path.basename(gone))]
    assert [(x.application, x.label, x.bytes > 0) for x in found] == [("app-1", "lost", True)]
    assert session.remove_folder(spark, found[0].folder) and not session.remove_folder(spark, gone)


def test_stages_without_a_setting_lie_in_the_warehouse(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Bare:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}.get(key, default)

    assert session.shared_folder(Bare) == "hdfs://x/warehouse/_driftline"
