"""Spark session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import re
import uuid
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


# Java compiles no method above 8000 bytes of code, and compiles long ones badly. Spark
# then does better with its split projections than with one large generated loop;
# rule sets run several times faster this way.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "4000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings that can be changed on a running session."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "driftline", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    Nothing here fixes the cluster size: the shuffle partition count is left to
    Spark and AQE unless the caller (tests, bench) sets it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **_RUNTIME,
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Reads ``spark.checkpoint.dir`` from the session; without it, a folder in the warehouse,
    which all executors reach as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else \
        f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_driftline"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own, inside the scope that is open, if any."""
    scope = _OPEN.get()
    parent = scope.folder if scope else shared_folder(spark)
    return f"{parent}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage between two ordered passes. The written table survives the
    loss of executors, and later passes read only the columns they need. It stays
    until the :class:`Scope` it was made in closes; without one it is the caller's.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# scopes -----------------------------------------------------------------------

_OPEN: ContextVar[Scope | None] = ContextVar("driftline_scope", default=None)
_SCOPE = "scope-"


def hadoop_path(spark: SparkSession, folder: str):
    """The folder and its file system, whichever store it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Scope:
    """Owns the tables that are staged while it is open, and deletes them when it closes.

        with Scope(spark):
            corrected = interpolated_zero(...)
            write_table(corrected, path)

    A result that reads staged tables has to be written, or collected, before the scope
    closes; so it is closed whether the block ends or fails. Scopes nest, each with its own
    tables; every thread has its own. The folder's name tells the application and the label,
    so that what a lost driver left can be named (:func:`leftovers`) and removed.
    """

    def __init__(self, spark: SparkSession, label: str = "job"):
        if not re.fullmatch(r"[A-Za-z0-9_.]+", label):
            raise ValueError(f"not a label: {label!r}")
        self.spark, self.label = spark, label
        owner = spark.sparkContext.applicationId
        self.folder = f"{shared_folder(spark)}/{_SCOPE}{owner}~{label}~{uuid.uuid4().hex}"

    def __enter__(self) -> Scope:
        path, store = hadoop_path(self.spark, self.folder)
        store.mkdirs(path)
        self._token = _OPEN.set(self)
        return self

    def __exit__(self, *failure) -> None:
        _OPEN.reset(self._token)
        remove_folder(self.spark, self.folder)


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder with all it holds; False where it is not there."""
    path, store = hadoop_path(spark, folder)
    return bool(store.delete(path, True))


@dataclass(frozen=True)
class Leftover:
    """The folder of a scope whose application is not this one."""

    folder: str
    application: str
    label: str
    modified: datetime
    bytes: int


def leftovers(spark: SparkSession) -> list[Leftover]:
    """Scopes of other applications under the shared folder, the oldest first.

    Whether such an application still runs is the caller's to know; its scopes may be
    removed (:func:`remove_folder`) once it does not.
    """
    path, store = hadoop_path(spark, shared_folder(spark))
    found = []
    for status in (store.listStatus(path) if store.exists(path) else []):
        name = status.getPath().getName()
        application, _, rest = name.removeprefix(_SCOPE).partition("~")
        if not (name.startswith(_SCOPE) and rest) or application == spark.sparkContext.applicationId:
            continue
        size = store.getContentSummary(status.getPath()).getLength()
        found.append(Leftover(status.getPath().toString(), application, rest.rpartition("~")[0],
                              datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc),
                              size))
    return sorted(found, key=lambda x: x.modified)


def small_table(df: DataFrame, max_rows: int = 10_000) -> DataFrame | None:
    """``df`` as a literal table when it has at most ``max_rows`` rows, else None.

    The bound is checked before anything is kept on the driver, so a join with
    the result may be broadcast; the caller joins ``df`` itself on None.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)
