"""What the operators share: the way to the Python workers, and folders for tables on the way."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyworks.storage import Workspace

ROOT = str(Path(__file__).resolve().parents[2])

# The characters between words; a fixed value.
SEPARATORS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def for_workers(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package from where the driver did.

    On machines without that folder the package is shipped as usual, with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *known]))


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage is cut and it is computed once."""
    spark = frame.sparkSession
    path = Workspace.of(spark).path(label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """How many ways the session deals out a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def named(frame: DataFrame) -> list[Column]:
    """The columns of a frame, whatever their names hold."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in frame.columns]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
