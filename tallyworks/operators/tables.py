"""Databases and tables in the session catalog. Names are qualified; no current database is changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The rows of the sample table; fixed values.
SAMPLE_PEOPLE = ((1, "Alice"), (2, "Bob"), (3, "Charlie"))


def quoted(text: str) -> str:
    """A text as a SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION {quoted(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{place}")


def ensure_table(spark: SparkSession, name: str, columns: str, using: str = "parquet") -> bool:
    """Create a managed table unless it exists; true when it was created."""
    missing = not spark.catalog.tableExists(name)
    if missing:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using}")
    return missing


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_csv_table(spark: SparkSession, name: str, columns: str, location: str, header: bool = False) -> None:
    """An external table over a folder of CSV files; dropping it leaves the files.

    Without ``header`` every line is a row, header lines too.
    """
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING csv OPTIONS (header '{str(header).lower()}') LOCATION {quoted(location)}"
    )


def insert_rows(frame: DataFrame, name: str) -> None:
    """Append the rows of a frame to a table, by position."""
    frame.write.insertInto(name)


def load_people(spark: SparkSession, name: str, people: DataFrame | None = None) -> DataFrame:
    """Create a table ``(id, name)`` if it is missing, append people, and count all its rows.

    ``people`` holds an id and a name; the id column takes its type from there. The three
    sample people are taken when none are given. Every call appends.
    """
    if people is None:
        ensure_table(spark, name, "id INT, name STRING")
        rows = ", ".join(f"({number}, '{person}')" for number, person in SAMPLE_PEOPLE)
        spark.sql(f"INSERT INTO {name} VALUES {rows}")
    else:
        ensure_table(spark, name, f"id {people.dtypes[0][1]}, name STRING")
        insert_rows(people, name)
    return spark.sql(f"SELECT count(*) AS rowcount FROM {name}")
