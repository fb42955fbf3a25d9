"""Exact deduplication by 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import join_groups, whole_text


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def text_groups(texts: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per different text of ``texts`` (__h, __text, __id): the id to keep and the size.

    The grouping key holds the hash and the text, so two texts of one hash stay apart.
    Every task sends a text once, however many copies it has read.
    """
    best = F.max if keep == "largest" else F.min
    return texts.groupBy("__h", "__text").agg(
        best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                keep: str = "largest",
                hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows whose texts are the same bytes form a group; the one with the largest (or
    ``keep="smallest"``) id stays. A null text counts as empty. A null id never wins
    against a number; a group of null ids has a null keep_id and keeps all its rows, and
    rows that repeat the winning id are all kept, as nothing tells them apart. An empty
    table gives an empty result; other columns of ``docs`` are not looked at.

    One exchange carries texts, each once per task that read it; it groups by hash and
    bytes. Rows then find their group by the hash and the SHA-256 of their text, so two
    texts of one hash stay apart, and rows of the groups with most copies are not
    exchanged by either (:func:`driftline.llm.common.join_groups`).
    """
    texts = docs.select(F.col(id_column).alias("__id"), whole_text(text_column).alias("__text"))
    texts = texts.withColumn("__h", hash_of(F.col("__text")))
    # a key that is never null, so that both uses of the groups share their exchange
    key = F.coalesce(F.concat(F.col("__h").cast("string").cast("binary"), F.unhex(
        F.sha2("__text", 256))), F.lit(b"")).alias("__key")
    groups = text_groups(texts, keep).select(key, "__keep", "__n")
    rows = join_groups(texts.select("__id", key), groups, "__key", "__n").withColumn(
        "__sha", F.lower(F.substring(F.hex("__key"), -64, 64)))
    return rows.select(F.col("__id").alias(id_column), F.col("__keep").alias("keep_id"),
                       F.col("__n").alias("group_size"),
                       F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
                       F.col("__sha").alias("text_sha256"))
