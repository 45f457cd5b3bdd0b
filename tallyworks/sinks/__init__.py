"""File sinks. Each writes its partitions in parallel; none gathers rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_csv(frame: DataFrame, path: str, header: bool = True) -> None:
    """Comma-separated files, replacing what lies at the path."""
    frame.write.mode("overwrite").option("header", header).csv(path)


def write_tab_text(frame: DataFrame, path: str) -> None:
    """The columns of each row joined by tabs, without quoting; null is an empty field.

    Fails when the path exists, and on a value that holds a tab or a line end, which could not be read back.
    """

    def field(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        bad = F.raise_error(F.concat(F.lit(f"tab or line end in {name}: "), text)).cast("string")
        return F.when(F.regexp_like(text, F.lit("[\\t\\n\\r]")), bad).otherwise(text)

    fields = [field(name) for name in frame.columns]
    frame.select(F.concat_ws("\t", *fields).alias("value")).write.mode("errorifexists").text(path)


def write_lines(frame: DataFrame, path: str) -> None:
    """One line per row of a single string column, replacing what lies at the path.

    A null has no line; a value with line ends becomes several lines.
    """
    frame.filter(F.col(f"`{frame.columns[0]}`").isNotNull()).write.mode("overwrite").text(path)


def write_records(frame: DataFrame, path: str, header: bool = True) -> None:
    """Comma-separated files whose values are kept as they are, line ends and outer blanks included, replacing what lies at the path.

    Quotes are doubled; a null is an empty field and an empty text a quoted one. ``read_records`` reads them.
    """
    options = {"header": header, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    frame.write.mode("overwrite").options(**options).csv(path)
