"""Picking rows and columns. All of these reach the scan as pushed filters or pruned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def column_as_text(frame: DataFrame, column: str | None = None, name: str = "val") -> DataFrame:
    """One column, the first unless named, with its values as text; null stays null."""
    return frame.select(F.col(column or frame.columns[0]).cast("string").alias(name))


def rows_with(frame: DataFrame, column: str, *values: object) -> DataFrame:
    """The rows holding one of the values in a column."""
    if len(values) == 1:
        return frame.filter(F.col(column) == F.lit(values[0]))
    return frame.filter(F.col(column).isin(*values))


def has_value(frame: DataFrame, column: str, value: object) -> bool:
    """Whether a value occurs in a column.

    Spark looks into a few splits first, and into more only while it has found none.
    """
    return not rows_with(frame, column, value).isEmpty()
