"""Jobs from input path to output path.

Each is one Spark plan: a pruned scan, an aggregate with a partial step in the map
tasks, and where the output is ordered a range exchange over one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyworks.functions.strings import split_pair
from tallyworks.operators.exact import exact_total_by
from tallyworks.operators.fingerprint import require_copy
from tallyworks.operators.grouping import count_by, count_words, flag_above
from tallyworks.plans.contract import read_contract
from tallyworks.sinks import write_csv, write_tab_text
from tallyworks.sources import read_csv, read_lines

# The columns of the files the jobs read and write; fixed values.
SALES = "country STRING, amount DOUBLE"
SALES_TOTALS = "country STRING, total_amount DOUBLE"
POSITIONS = "trade_id STRING, desk STRING, notional DOUBLE, currency STRING"
EXPOSURE = "desk STRING, total_notional DOUBLE, limit_breached BOOLEAN"
KEY_VALUES = "k STRING, v INT"
KEY_COUNTS = "k STRING, cnt BIGINT"
WORD_COUNTS = "word STRING, cnt BIGINT"


def sales_totals(spark: SparkSession, source: str, target: str) -> None:
    """Amounts per country, ordered by country, from headed CSV to headed CSV. Totals are exact, whatever the order of the rows."""
    sales = read_csv(spark, source, SALES)
    write_csv(exact_total_by(sales, "country", "amount", "total_amount").orderBy("country"), target)


def exposure_by_desk(positions: DataFrame, limit: float) -> DataFrame:
    """Totals are exact, so that one at the limit is never taken for one above it."""
    totals = exact_total_by(positions, "desk", "notional", "total_notional")
    return flag_above(totals, "total_notional", limit).orderBy("desk")


def exposure_check(
    spark: SparkSession, source: str, target: str, limit: float, under_contract: bool = False
) -> None:
    """Exposure per desk with a flag above the limit, from headed CSV to headed CSV.

    Under contract, positions whose header or values drifted fail the job.
    """
    if under_contract:
        positions = read_contract(spark, source, POSITIONS, strict_values=True)
    else:
        positions = read_csv(spark, source, POSITIONS)
    write_csv(exposure_by_desk(positions, limit), target)


def word_count(spark: SparkSession, source: str, target: str) -> bool:
    """Words of text files with their counts, ordered, as tab-separated lines."""
    write_tab_text(count_words(read_lines(spark, source)).orderBy("word"), target)
    return True


def key_count(spark: SparkSession, source: str, target: str) -> None:
    """Rows per key of headerless CSV, as tab-separated lines."""
    write_tab_text(count_by(read_csv(spark, source, KEY_VALUES, header=False), "k"), target)


def line_key_count(spark: SparkSession, source: str, target: str) -> None:
    """The same count from plain lines, cut at the first comma."""
    key, value = split_pair("line")
    pairs = read_lines(spark, source, "line").select(key.alias("k"), value.alias("v"))
    write_tab_text(count_by(pairs, "k"), target)


def csv_to_parquet(spark: SparkSession, source: str, target: str, verified: bool = False) -> DataFrame:
    """Convert headed CSV to Parquet with every column a string, and read it back; ``verified`` as in ``copied``."""
    return copied(read_csv(spark, source), target, verified)


def table_to_parquet(spark: SparkSession, table: str, target: str, verified: bool = False) -> DataFrame:
    """Copy a catalog table to Parquet files and read them back; ``verified`` as in ``copied``."""
    return copied(spark.table(table), target, verified)


def copied(source: DataFrame, target: str, verified: bool = False) -> DataFrame:
    """A frame written as Parquet, replacing what lies at the target, and read back.

    With ``verified`` source and copy are read once more, and it fails when they are not the same rows, in any order.
    """
    source.write.mode("overwrite").parquet(target)
    copy = source.sparkSession.read.parquet(target)
    if verified:
        require_copy(source, copy)
    return copy
