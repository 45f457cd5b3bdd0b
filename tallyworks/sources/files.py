"""Delimited and plain text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """Comma-separated files.

    With a schema the columns are taken by position and a value that does not parse
    is null. Without one every column is a string; types are never guessed, which
    would read the files twice.
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One row per line of a text file or of all files in a folder."""
    return spark.read.text(path).withColumnRenamed("value", name)


def read_tab_text(spark: SparkSession, path: str, schema: str, skip_bad: bool = False) -> DataFrame:
    """Tab-separated lines as ``write_tab_text`` leaves them.

    Quotes are ordinary characters here, so the lines are split rather than read as
    CSV. An empty field is null. A line with another number of fields, or with a field that
    does not parse, fails the read, in ANSI mode or not; ``skip_bad`` leaves such lines out.
    """
    columns = StructType.fromDDL(schema).fields
    fields = F.split("value", "\t", -1)
    texts = [F.nullif(F.get(fields, F.lit(i)), F.lit("")) for i in range(len(columns))]
    parsed = [text.try_cast(column.dataType) for text, column in zip(texts, columns)]
    good = F.size(fields) == len(columns)
    for text, value in zip(texts, parsed):
        good = good & (text.isNull() | value.isNotNull())
    lines = spark.read.text(path)
    if skip_bad:
        lines = lines.filter(good)
    else:
        bad = F.raise_error(F.concat(F.lit("not a line of the expected fields: "), F.col("value")))
        lines = lines.filter(F.when(good, F.lit(True)).otherwise(bad.cast("boolean")))
    return lines.select(*[value.alias(column.name) for value, column in zip(parsed, columns)])
