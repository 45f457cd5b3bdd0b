"""String functions for SQL and for DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# The characters that separate words, vertical tab not among them; a fixed value.
WORD_SEPARATORS = r"[ \t\n\r\f]"


def register_to_upper(spark: SparkSession) -> None:
    """Make ``to_upper(text)`` callable from this session's SQL; null stays null.

    A SQL function, which the optimizer inlines; a Python function would not be.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION to_upper(s STRING) RETURNS STRING RETURN upper(s)")


def store_to_upper(spark: SparkSession, database: str) -> str:
    """Keep ``to_upper`` in the catalog, for every session that uses it, and name it."""
    name = f"{database}.to_upper"
    spark.sql(f"CREATE OR REPLACE FUNCTION {name}(s STRING) RETURNS STRING RETURN upper(s)")
    return name


def split_pair(column: str, separator: str = ",") -> tuple[Column, Column]:
    """The text before the first match of a separator pattern, and the rest.

    The second is null for a text without separator.
    """
    parts = F.split(F.col(column), separator, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def words(column: str) -> Column:
    """An array of the words of a text.

    One separator character per split is faster than a run of them; the empty strings
    it leaves between neighbouring separators are dropped by ``word_rows``.
    """
    return F.split(F.col(column), WORD_SEPARATORS)
