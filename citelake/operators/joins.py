"""Joining answers back to very many rows of few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def left_join_hot(rows: DataFrame, answers: DataFrame, keys: dict[str, str], spread: str | list[str], salts: int = SALTS) -> DataFrame:
    """Left join where one key may hold a third of ``rows``; ``answers`` has one row per key.

    Each answer is copied ``salts`` times and the rows of a key are dealt over the copies by the
    hash of ``spread``, so a hot key is joined by several tasks. ``keys`` maps columns of the rows
    to columns of the answers; nulls match nulls, and the answers' key columns are dropped.
    """
    return _dealt(rows, answers, keys, spread, salts, "left")


def join_hot(rows: DataFrame, answers: DataFrame, keys: dict[str, str], spread: str | list[str], salts: int = SALTS) -> DataFrame:
    """As ``left_join_hot``, but rows without an answer go; a key may have several answers."""
    return _dealt(rows, answers, keys, spread, salts, "inner")


def _dealt(rows: DataFrame, answers: DataFrame, keys: dict[str, str], spread: str | list[str], salts: int, how: str) -> DataFrame:
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(salts)).cast("int"))
    copies = answers.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = F.col("__salt") == F.col("__copy")
    for left, right in keys.items():
        match = match & F.col(left).eqNullSafe(F.col(right))
    return dealt.join(copies, match, how).drop("__salt", "__copy", *keys.values())
