"""Small helpers the text operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import shared_folder

NON_SPACE = r"[^\x20\x09-\x0D]+"
_NOT_WORD = [b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)]
#: Bytes of A-Z to a-z, every other ASCII byte that is no letter or digit to a space;
#: bytes of code points above ASCII stay. ``bytes.split`` then gives the words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _NOT_WORD else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-case words of letters, digits and code points above ASCII."""
    return data.translate(WORD_BYTES).split() if data else []


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: With it, a frame's shuffle files go when an action on it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(df: DataFrame) -> DataFrame:
    """``df`` for one action, whose end removes the shuffle files that it wrote.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")  # read where a frame is made
    try:
        return df.select("*")
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, so that later steps start there.

    The folder is the one that ``spark.checkpoint.dir`` names, or lies in the warehouse.
    Files that were exchanged on the way are removed.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return freed(df).checkpoint()


#: Keys with the most rows that :func:`join_groups` broadcasts.
HEAVY_KEYS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; NULL where ``groups`` has no such key.

    ``groups`` has one row per (binary) key and its number of rows in ``size``. The groups
    with most rows, a thousand at most, are broadcast, and their rows are spread instead of
    meeting in the exchange: no key that is left there has a thousandth of all rows. They
    are spread by the partition they were read in, which a retried task finds again.
    """
    values = [c for c in groups.columns if c != key]
    heavy = groups.orderBy(F.col(size).desc(), key).limit(HEAVY_KEYS).select(
        F.col(key).alias("__heavy"), F.struct(*values).alias("__heavy_row"))
    met = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    # a heavy row's key is one that no group has
    met = met.withColumns({
        "__own": F.when(F.col("__heavy").isNull(), F.col(key)).otherwise(
            F.encode(F.concat(F.lit("h"), F.spark_partition_id(), F.lit("-"),
                              F.substring(F.hex(key), 1, 4)), "UTF-8"))})
    light = groups.select(F.col(key).alias("__light"), F.struct(*values).alias("__light_row"))
    joined = met.join(light, F.col("__own") == F.col("__light"), "left").withColumn(
        "__g", F.coalesce("__heavy_row", "__light_row"))
    return joined.select(*rows.columns, *[F.col(f"__g.{c}").alias(c) for c in values])


ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(),
         "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}


def pieces_of(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows with some ``most`` bytes of text each, one row at least."""
    column = batch.column(text)
    sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: rows go to Python a few megabytes at a time, not 10,000 at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def per_text(docs: DataFrame, id_column: str, text_column: str,
             prepare: Callable[[], Callable[[bytes | None], tuple]],
             fields: dict[str, str], keep_null: bool = False) -> DataFrame:
    """Id and ``fields`` of every row, from a function of the text's UTF-8 bytes.

    ``prepare`` runs once in each task and returns the function. No exchange; a task
    holds one Arrow batch of texts at a time and works on a small slice of it.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_column) if keep_null else whole_text(text_column)
    rows = docs.select(F.col(id_column).alias("__id"), text.cast("binary").alias("__text"))
    names = list(fields)
    kinds = [ARROW[k] for k in fields.values()]

    def run(batches):
        of = prepare()
        for batch in (x for whole in batches for x in pieces_of(whole, 1)):
            found = [of(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*found)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["__id", *names])

    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), *[
        T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()]])
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_column)


def with_answer(docs: DataFrame, column: str, text_column: str,
                prepare: Callable[[], Callable[[bytes | None], tuple]],
                fields: dict[str, str]) -> DataFrame:
    """``docs`` with a struct column of ``fields`` from the text; other columns stay in the JVM."""
    small_batches(docs.sparkSession)
    names = list(fields)

    def answers(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = prepare()
        for part in texts:
            yield pd.DataFrame([of(x) for x in part], columns=names)

    # a filter on the answer is not moved below it, where the answer would be computed twice
    answer = F.pandas_udf(answers, ", ".join(
        f"{k} {v}" for k, v in fields.items())).asNondeterministic()
    return docs.withColumn(column, answer(F.col(text_column).cast("binary")))
