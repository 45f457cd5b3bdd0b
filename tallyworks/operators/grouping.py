"""Grouped totals and counts.

All of them aggregate inside each map task first, so a key holding a third of the
rows sends one row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyworks.functions.strings import words


def total_by(frame: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Sum per key. Null amounts are skipped; a key with only nulls has a null total."""
    return frame.groupBy(key).agg(F.sum(amount).alias(name))


def flag_above(frame: DataFrame, total: str, limit: float, name: str = "limit_breached") -> DataFrame:
    """Add a flag that is true strictly above the limit, and null for a null total."""
    return frame.withColumn(name, F.col(total) > F.lit(float(limit)))


def count_by(frame: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """Rows per key. Rows with a null key form a group of their own, which counts 0."""
    return frame.groupBy(key).agg(F.count(key).alias(name))


def count_rows(frame: DataFrame, name: str = "c") -> DataFrame:
    return frame.agg(F.count("*").alias(name))


def word_rows(frame: DataFrame, column: str = "value") -> DataFrame:
    """One row per word of a text column, in a column ``word``."""
    return frame.select(F.explode(words(column)).alias("word")).filter("word <> ''")


def count_words(frame: DataFrame, column: str = "value") -> DataFrame:
    """How often each word occurs."""
    return word_rows(frame, column).groupBy("word").agg(F.count("*").alias("cnt"))
