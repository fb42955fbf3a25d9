"""Slices of ordered series, stored so that scans neither measure nor move rows.

A layout is a folder with the rows, bucketed by slice and sorted in series order, the
slices with their counts, and a note of what it was made from. The scans of
:mod:`driftline.operators.scan` take an opened layout in place of a frame. A layout is
refused when a file of its source has changed since.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from driftline.operators.groups import join_on
from driftline.operators.scan import MAX_SLICE_ROWS, SLICE, Order, Sliced, slice_series
from driftline.session import remove_folder, small_table, stage

#: Rows of a bucket, on average; a bucket holds whole slices.
BUCKET_ROWS = 1_000_000
_ROWS, _SLICES, _NOTE = "rows", "slices", "note"


class StaleLayout(ValueError):
    """The source of a layout has changed since the layout was made."""


@dataclass(frozen=True)
class Note:
    """What a layout holds and what it was made from."""

    time: str
    ties: list[str]
    series: list[str]
    schema: str
    buckets: int
    source: list[str]
    files: str

    @property
    def order(self) -> Order:
        return Order(self.time, tuple(self.ties), tuple(self.series))


def files_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Number, size, latest change and a checksum of the files behind ``paths``.

    Read from the listing; no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    row = files.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.max("modificationTime").cast("string").alias("latest"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
        .cast("string").alias("sum")).first()
    return json.dumps(row.asDict(), sort_keys=True)


def _table_name(path: str) -> str:
    return "driftline_layout_" + sha256(path.encode()).hexdigest()[:24]


def store_slices(df: DataFrame, order: Order, path: str, source: str | Sequence[str],
                 max_rows: int = MAX_SLICE_ROWS, buckets: int | None = None) -> Sliced:
    """Store ``df``, made from the files of ``source``, as a layout in the new folder ``path``.

    Slices are days of a series, hours where days have more than ``max_rows`` rows, or
    parts of hours. They are counted here, once. A slice gets a number over all series, in
    their order, and rows lie in buckets by that number alone.
    """
    spark = df.sparkSession
    source = [source] if isinstance(source, str) else list(source)
    before = files_state(spark, source)
    sliced = slice_series(df, order, "auto", max_rows)
    if not sliced.cut:
        sliced = slice_series(df, order, "day", max_rows)
    counts = sliced.df.groupBy(*sliced.keys).agg(F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.orderBy(*sliced.keys)).cast("bigint")
    slices = stage(counts.withColumn("__nr", number))
    total = slices.agg(F.sum("n").alias("n")).first()["n"] or 0
    if buckets is None:
        buckets = max(1, min(-(-total // BUCKET_ROWS), 100_000),
                      min(spark.sparkContext.defaultParallelism, slices.count()))
    numbers = slices.select(*sliced.keys, "__nr")
    rows = join_on(sliced.df, small_table(numbers) or numbers, sliced.keys, "left")
    rows = rows.drop(SLICE).withColumnRenamed("__nr", SLICE)
    (rows.repartition(buckets, SLICE).write.format("parquet").option("path", f"{path}/{_ROWS}")
     .bucketBy(buckets, SLICE).sortBy(SLICE, *order.by).saveAsTable(_table_name(path)))
    slices.drop(SLICE).withColumnRenamed("__nr", SLICE).write.parquet(f"{path}/{_SLICES}")
    note = Note(order.time, list(order.ties), list(order.series), rows.schema.json(), buckets,
                source, before)
    spark.createDataFrame([(json.dumps(asdict(note)),)], "value string").coalesce(1).write.text(
        f"{path}/{_NOTE}")
    return open_slices(spark, path)


def open_slices(spark: SparkSession, path: str) -> Sliced:
    """The layout in ``path``, for any scan in its order; :class:`StaleLayout` if it is old."""
    note = Note(**json.loads(spark.read.text(f"{path}/{_NOTE}").first()["value"]))
    now = files_state(spark, note.source)
    if now != note.files:
        raise StaleLayout(f"{path} was made from {note.files}, its source now is {now}")
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        _register(spark, name, path, note)
    return Sliced(spark.table(name), note.order, cut=True, numbered=True)


def _register(spark: SparkSession, name: str, path: str, note: Note) -> None:
    """Name the stored rows in a catalog that doesn't know them (a new session, a new cluster)."""
    fields = StructType.fromJson(json.loads(note.schema))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ordered = ", ".join(f"`{c}`" for c in (SLICE, *note.order.by))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{SLICE}`) "
              f"SORTED BY ({ordered}) INTO {note.buckets} BUCKETS LOCATION '{path}/{_ROWS}'")


def slice_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each stored slice: the series columns, the slice's number and n."""
    return spark.read.parquet(f"{path}/{_SLICES}")


def drop_slices(spark: SparkSession, path: str) -> None:
    """Forget and delete a layout."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    remove_folder(spark, path)
