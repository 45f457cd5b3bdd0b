"""Ad-hoc SQL: a short preview for a person, or the whole result as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DayTimeIntervalType, MapType, StructType, YearMonthIntervalType

# How many rows a preview shows; a fixed value.
PREVIEW_ROWS = 100


@dataclass(frozen=True)
class Preview:
    sql: str
    columns: list[str]
    count: int
    data: list[list]


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The whole result of a statement, left distributed.

    ``tables`` are frames the statement names in braces.
    """
    if sql is None or not sql.strip():
        raise ValueError("empty SQL")
    return spark.sql(sql, **tables)


def positional_rows(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The whole result of a statement as rows of one column ``row``, an ``ARRAY<VARIANT>`` with the values by position; left distributed.

    Two columns may have one name. Every value keeps its type where a variant has it, and nested ones become variant objects and arrays;
    a null is a null element. Keys of maps become text, and intervals are given as text. A statement without columns has empty arrays.
    """
    frame = run_sql(spark, sql, **tables)
    # By position: names may be repeated.
    frame = frame.toDF(*[f"c{at}" for at in range(len(frame.columns))])
    values = [_variant(F.col(field.name), field.dataType) for field in frame.schema.fields]
    return frame.select((F.array(*values) if values else F.array().cast("array<variant>")).alias("row"))


def _variant(value: Column, kind: DataType) -> Column:
    told = _telling(value, kind)
    nested = isinstance(kind, (ArrayType, MapType, StructType))
    return F.to_variant_object(told) if nested else told.cast("variant")


def _telling(value: Column, kind: DataType) -> Column:
    """A value in the types that variants have."""
    if isinstance(kind, StructType):
        fields = [_telling(value.getField(field.name), field.dataType).alias(field.name) for field in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda one: _telling(one, kind.elementType))
    if isinstance(kind, MapType):
        keys = F.transform(F.map_keys(value), lambda key: key.cast("string"))
        return F.map_from_arrays(keys, F.transform(F.map_values(value), lambda one: _telling(one, kind.valueType)))
    if isinstance(kind, (DayTimeIntervalType, YearMonthIntervalType)):
        return value.cast("string")
    return value


def preview_rows(spark: SparkSession, sql: str, rows: int = PREVIEW_ROWS, **tables: DataFrame) -> DataFrame:
    """The first rows of a statement's result."""
    return run_sql(spark, sql, **tables).limit(rows)


def preview(spark: SparkSession, sql: str, rows: int = PREVIEW_ROWS, **tables: DataFrame) -> Preview:
    """The first rows as plain lists, with the column names. ``count`` is the number returned."""
    frame = preview_rows(spark, sql, rows, **tables)
    data = [list(row) for row in frame.collect()]
    return Preview(sql, frame.columns, len(data), data)
