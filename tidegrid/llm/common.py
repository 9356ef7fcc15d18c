"""Helpers that the text operators share: staged tables, stable row numbers, words, uniform hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.session import CLEANUP, release, stage  # noqa: F401  (for the operators)

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(*columns: str | Column, seed: int = 0) -> Column:
    """A number strictly between 0 and 1 that depends on the values and the seed alone."""
    h = F.xxhash64(F.lit(seed), *columns)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))
