"""Time the paths that a large table takes: many files, one long series, one crowded day.

    python bench_scale.py [folder of events.parquet] [copies] [cores]

The events are repeated under instants and series of their own until one series holds most
rows and one day a third of them, written in many files, and read back. Prints a line for
each query: seconds with the jobs at plan time, thousands of rows a second.
"""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from driftline.operators import groups, rule_tables, scan, stored, timebin, zeroes  # noqa: E402
from driftline.operators.align import align_full  # noqa: E402
from driftline.operators.scan import Order  # noqa: E402
from driftline.session import Scope, build_session  # noqa: E402

ORDER = Order(time="date", ties=("event_id", "copy"), series=("series",))


def table(spark, events, copies, path):
    """``copies`` of the events: nine of ten in one series, a third of the copies on one day."""
    base = spark.read.parquet(events).crossJoin(F.broadcast(spark.range(copies).toDF("copy")))
    day = F.when(F.col("copy") % 3 == 0, F.expr("TIMESTAMP_NTZ '2022-06-01'") + (
        F.col("ts") - F.date_trunc("day", "ts")).cast("interval day to second"))
    base.select(
        F.coalesce(day, F.expr("cast(ts as timestamp_ntz)")).alias("date"), "event_id", "copy",
        F.when(F.col("copy") % 10 == 0, F.col("user_id") % 50).otherwise(-1).alias("series"),
        (F.floor(F.col("event_id") / 40) % 3 == 1).cast("int").alias("status"),
        "user_id", "value", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("no"),
    ).repartition(96).write.parquet(path)


def queries(df, source, folder):
    spark = df.sparkSession
    rules = df.where("event_id % 199 = 0").select(
        F.col("date").alias("start"),
        F.expr("date + make_dt_interval(0, 0, cast(event_id % 500 as int))").alias("end"),
        F.concat_ws(" ", "series", "event_id").alias("label"), F.col("copy").alias("p"))
    keyed = [df.where(f"event_id % 5 = {i}").select(
        F.col("user_id").alias("date"), F.col("event_id").alias(f"e{i}")).where(f"e{i} % 700 = {i}")
        for i in range(3)]
    layout = lambda: stored.store_slices(df, ORDER, f"{folder}/layout", source)
    yield "hour means", lambda: timebin.time_average(df, "1 hour", by=["series"], columns=["no"])
    yield "median of series", lambda: groups.group_median(df, ["series"], ["no", "value"])
    yield "run ids", lambda: scan.run_id(df, "status", 1, ORDER)
    yield "interpolation", lambda: scan.interpolate(df, ["no"], ORDER)
    yield "interpolated zero", lambda: zeroes.interpolated_zero(df, ["no"], "status", ORDER)
    yield "rule table", lambda: rule_tables.tag_by_table(df, rules, "label")
    yield "three tables aligned", lambda: align_full(keyed)
    yield "layout stored", lambda: layout().df.groupBy().count()
    yield "run ids, stored", lambda: scan.run_id(
        stored.open_slices(spark, f"{folder}/layout"), "status", 1, ORDER)
    yield "interpolation, stored", lambda: scan.interpolate(
        stored.open_slices(spark, f"{folder}/layout"), ["no"], ORDER)


def main():
    events = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1") + "/events.parquet"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 40
    cores = int(sys.argv[3]) if len(sys.argv) > 3 else os.cpu_count()
    folder = tempfile.mkdtemp(prefix="driftline-scale-")
    spark = build_session("scale", master=f"local[{cores}]", shuffle_partitions=4 * cores, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": f"{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    spark.sparkContext.setLogLevel("ERROR")
    source = f"{folder}/events"
    table(spark, events, copies, source)
    df = spark.read.parquet(source)
    rows = df.count()
    print(f"{rows:,} rows in 96 files, {cores} cores")
    for name, query in queries(df, source, folder):
        with Scope(spark, "scale"):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
        print(f"| {name} | {took:.1f} | {rows / took / 1000:,.0f} |", flush=True)


if __name__ == "__main__":
    main()
