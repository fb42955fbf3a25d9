"""Folds and bounded samples that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def fold(id_column: str) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def drawn(id_column: str, rate: Column | float) -> Column:
    """Whether a row belongs to a sample of this rate, by a hash of its id."""
    wanted = rate if isinstance(rate, Column) else F.lit(rate)
    return F.pmod(F.xxhash64(F.lit("sample"), id_column), F.lit(1 << 20)) < wanted * (1 << 20)
