"""Fingerprints of tables as multisets of rows, for checking copies without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType, VariantType

# Seeds of the two hashes of a row.
SEEDS = (1, 2)


def _hashable(value: Column, kind: DataType) -> Column:
    """A value that can be hashed: maps as sorted entries, and nulls told apart at every depth."""
    return F.struct(*_parts(value, kind))


def _parts(value: Column, kind: DataType) -> list[Column]:
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda one: F.struct(_hashable(one["key"], kind.keyType).alias("k"), _hashable(one["value"], kind.valueType).alias("v")))
        return [value.isNull(), F.array_sort(entries)]
    if isinstance(kind, ArrayType):
        return [value.isNull(), F.size(value), F.transform(value, lambda one: _hashable(one, kind.elementType))]
    if isinstance(kind, StructType):
        return [value.isNull(), *[_hashable(value.getField(field.name), field.dataType).alias(f"f{at}") for at, field in enumerate(kind.fields)]]
    if isinstance(kind, VariantType):
        return [value.isNull(), F.to_json(value)]
    if isinstance(kind, (DoubleType, FloatType)):
        # Zeros of both signs are equal, and so are all NaN.
        return [value.isNull(), F.when(F.isnan(value), F.lit(float("nan")).cast(kind)).otherwise(value + F.lit(0.0).cast(kind))]
    return [value.isNull(), value]


def fingerprint(frame: DataFrame) -> DataFrame:
    """One row ``rows, first, second``: how many rows there are, and the sums of two 64-bit hashes of each.

    Columns are taken by position. Equal multisets of rows have equal fingerprints, whatever their order, files and
    partitions; others have unequal ones but for chance: a value that was changed or moved to another row or column, a row that was lost and
    one that was doubled change both sums. Each task sends one row of sums. An empty table has zeros.
    """
    values = [part for field in frame.schema.fields for part in _parts(F.col(f"`{field.name.replace('`', '``')}`"), field.dataType)]
    hashed = frame.select(*[F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)").alias(f"h{seed}") for seed in SEEDS])
    zero = F.lit(0).cast("decimal(30,0)")
    return hashed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("h1"), zero).alias("first"), F.coalesce(F.sum("h2"), zero).alias("second"))


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, in any order; three numbers of each reach the driver."""
    return fingerprint(one).first() == fingerprint(other).first()


def require_copy(source: DataFrame, copy: DataFrame) -> None:
    """Fail when a copy does not hold the rows of its source."""
    wanted, found = fingerprint(source).first(), fingerprint(copy).first()
    if wanted != found:
        raise ValueError(f"the copy has {found.rows} rows and the source {wanted.rows}" if wanted.rows != found.rows else "the copy has other rows than the source")
