"""Text and Parquet tables in and out.

Every field is read as text and converted with an explicit schema: what cannot be
converted is NULL, whatever the file around it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import (DoubleType, FloatType, StructType, TimestampNTZType,
                               TimestampType)

from driftline.functions.cond import nan_to_null
from driftline.functions.times import parse_ymd_hms
from driftline.operators.rows import bind_rows
from driftline.session import hadoop_path

NULL_TOKENS = ("NA", "missing", "")


def null_tokens_to_null(text: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~F.trim(text).isin(list(tokens)), text)


def _typed(df: DataFrame, schema: StructType | None, tokens: Sequence[str],
           parse=parse_ymd_hms, rescue: str | None = None) -> DataFrame:
    wanted = {f.name: f.dataType for f in schema} if schema else {}
    names = [c for c in df.columns if c not in _READ]

    def text(name: str) -> Column:
        return null_tokens_to_null(F.col(f"`{name}`"), tokens)

    def convert(name: str) -> Column:
        type_ = wanted.get(name)
        if type_ is None:
            return text(name)
        if isinstance(type_, (TimestampNTZType, TimestampType)):
            return parse(text(name)).cast(type_)
        return text(name).try_cast(type_)

    def value(name: str) -> Column:
        floating = isinstance(wanted.get(name), (DoubleType, FloatType))
        return (nan_to_null(convert(name)) if floating else convert(name)).alias(name)

    out = [value(c) for c in names]
    if rescue:
        typed = [c for c in names if c in wanted]
        lost = [F.when(convert(c).isNull(), text(c)) for c in typed]
        out.append(_rescued(typed, lost).alias(rescue))
    return df.select(*out)


# what could not be read ---------------------------------------------------------

#: Read beside the columns of a file: the line where it has too few or too many fields.
_LINE, _WIDTH = "__line", "__width"
_READ = (_LINE, _WIDTH)
#: Bytes of a file read at a time to find its header, and files read at a time.
_HEAD_BYTES, _HEADS_AT_ONCE = 1 << 14, 16
_QUOTED = r'"(?:[^"\\]|\\.)*"'


def _rescued(names: Sequence[str], lost: Sequence[Column]) -> Column:
    """What a row lost (line, misfit, fields), NULL where it lost nothing."""
    fields = F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(c) for c in names]).cast("array<string>"),
        F.array(*lost).cast("array<string>")), lambda _, x: x.isNotNull())
    separators = F.length(F.regexp_replace(F.regexp_replace(_LINE, _QUOTED, ""), "[^,]", ""))
    misfit = F.when(separators + 1 < F.col(_WIDTH), "short").when(
        separators + 1 > F.col(_WIDTH), "long")
    return F.when(misfit.isNotNull() | (F.size(fields) > 0), F.struct(
        F.when(misfit.isNotNull(), F.col(_LINE)).alias("line"), misfit.alias("misfit"),
        fields.alias("fields")))


def reading_counts(names: Iterable[str], rescue: str) -> list[Column]:
    """Aggregates over read rows: n_rows, n_short, n_long and n_lost_<column>."""
    kind, fields = F.col(f"{rescue}.misfit"), F.col(f"{rescue}.fields")
    return [F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(kind == "short", 1)).alias("n_short"),
            F.count(F.when(kind == "long", 1)).alias("n_long"),
            *[F.count(fields[c]).alias(f"n_lost_{c}") for c in names]]


# files and their headers --------------------------------------------------------

def _literal_path(path: str) -> str:
    """The path with the characters of a pattern taken as they are."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _header(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that isn't blank, from as many bytes as that takes."""
    path, store = hadoop_path(spark, file)
    stream, head = store.open(path), b""
    try:
        while True:
            piece = bytes(stream.readNBytes(_HEAD_BYTES))
            head += piece
            *whole, rest = head.splitlines(keepends=True) or [b""]
            ended = [rest] if len(piece) < _HEAD_BYTES or rest.endswith(b"\n") else []
            for line in [*whole, *ended]:
                if line.strip():
                    return line.rstrip(b"\r\n").decode("utf-8", "replace")
            if len(piece) < _HEAD_BYTES:
                return None
    finally:
        stream.close()


def files_by_header(spark: SparkSession, paths: str | Sequence[str],
                    glob: str | None = None) -> list[list[str]]:
    """The files behind ``paths``, those with the same header line together.

    Only the first kilobytes of a file are read, however long it is, through the file
    system that Spark reads it with. The driver, which holds the list of files anyway,
    reads some files at a time and keeps one line of each.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    known = sorted(unquote(f) for f in reader.text(
        paths if isinstance(paths, str) else list(paths)).inputFiles())
    if len(known) < 2:
        return [[_literal_path(f) for f in known]]
    with ThreadPoolExecutor(_HEADS_AT_ONCE) as pool:
        headers = pool.map(lambda f: _header(spark, f), known)
        groups: dict[str, list[str]] = {}
        for file, header in zip(known, headers):
            if header is not None:
                groups.setdefault(header, []).append(_literal_path(file))
    return list(groups.values()) or [[_literal_path(f) for f in known]]


def read_table(spark: SparkSession, paths: str | Sequence[str],
               schema: StructType | None = None,
               null_tokens: Sequence[str] = NULL_TOKENS, glob: str | None = None,
               parse=parse_ymd_hms, provenance: str | None = None,
               by_name: bool = True, rescue: str | None = None,
               observe: Observation | None = None) -> DataFrame:
    """CSV files (or folders of them) with a header line.

    ``schema`` types the columns it names; others stay text. Files may have headers of
    their own: those with equal headers are read together and the groups appended by
    name, a column that a group lacks being NULL. That takes a pass over the first lines;
    without ``by_name`` there is none, and headers that disagree are an error.
    ``glob`` selects files by name, ``provenance`` adds the source file.

    ``rescue`` names a column for what would be lost: the texts of fields that could not
    be converted (fields, by column) and the line of a row with too few or too many fields
    (line, and misfit ``short`` or ``long``); NULL where a row lost nothing. ``observe``
    takes the counts of :func:`reading_counts` on the way, without a pass of its own.
    """
    # files of one set have the same header, or are checked to have it
    options = {"header": True, "enforceSchema": bool(rescue and by_name), "mode": "PERMISSIVE",
               **({"pathGlobFilter": glob} if glob else {})}
    hidden = observe is not None and not rescue
    rescue = "__rescued" if hidden else rescue
    sets = [paths if isinstance(paths, str) else list(paths)]
    if by_name and len(found := files_by_header(spark, paths, glob)) > 1:
        sets = found
    parts = []
    for files in sets:
        part = spark.read.options(**options).csv(files)
        if rescue:
            fields = StructType(list(part.schema.fields)).add(_LINE, "string")
            part = (spark.read.options(**options, columnNameOfCorruptRecord=_LINE).schema(fields)
                    .csv(files).withColumn(_WIDTH, F.lit(len(part.columns))))
        parts.append(part)
    if provenance:
        parts = [p.withColumn(provenance, F.col("_metadata.file_path")) for p in parts]
    table = _typed(bind_rows(*parts), schema, null_tokens, parse, rescue)
    if observe is not None:
        typed = [f.name for f in schema or () if f.name in table.columns]
        table = table.observe(observe, *reading_counts(typed, rescue))
    return table.drop(rescue) if hidden else table


def read_positional(spark: SparkSession, paths: str | Sequence[str],
                    columns: Mapping[int, str], schema: StructType | None = None,
                    null_tokens: Sequence[str] = NULL_TOKENS,
                    glob: str | None = None) -> DataFrame:
    """Headerless CSV; ``columns`` names the wanted fields by place, from 1.

    The number of fields is given by the last wanted one, so no file is sampled.
    """
    width = max(columns)
    reader = spark.read.schema(", ".join(f"_c{i} STRING" for i in range(width)))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(paths if isinstance(paths, str) else list(paths))
    named = raw.select(*[F.col(f"_c{place - 1}").alias(name) for place, name in columns.items()])
    return _typed(named, schema, null_tokens)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", time: str = "date",
                mode: str = "error", sort_by: Sequence[str] = ()) -> None:
    """Parquet in one folder per day, or CSV with a header and no row names.

    Rows are spread by day before writing; a day too large for one task is split.
    ``sort_by`` orders CSV rows over all part files, Parquet rows within each file.
    """
    if fmt == "csv":
        ordered = df.orderBy(*sort_by) if sort_by else df
        (ordered.write.mode(mode).option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path))
        return
    by_day = df.withColumn("day", F.to_date(time)).hint("rebalance", "day")
    if sort_by:
        by_day = by_day.sortWithinPartitions("day", *sort_by)
    by_day.write.mode(mode).partitionBy("day").format(fmt).save(path)
