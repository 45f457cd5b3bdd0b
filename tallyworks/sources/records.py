"""CSV whose values may hold line ends, read in as many tasks as the files have splits; built-in functions only.

A line that ends inside a quoted value belongs to the same record as the next one. Whether a line begins inside
a value depends on how many lines before it have an odd number of quotes: these open or close a value. They are
counted per split first, a row each; a running sum over the splits of a file says where each split begins, and one
within the split, where each line does. Lines that are a record by themselves are parsed as they are, and only
the others are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# What no value of a file is: an empty field without quotes is null, and one with quotes is an empty text.
NO_VALUE = "\0"


def _quotes(line: Column, escape: str) -> Column:
    """How many quotes open or close a value; a doubled one does neither in sum, and one after a backslash is none."""
    if escape == "\\":
        line = F.when(F.contains(line, F.lit("\\")), F.regexp_replace(line, r"\\.", "")).otherwise(line)
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def read_records(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, escape: str = '"') -> DataFrame:
    """Comma-separated files whose quoted values may hold line ends.

    As ``read_csv`` otherwise: with a schema columns are taken by position and a value that does not parse is null; without one every
    column is a string. Quotes in a value are doubled, or follow a backslash if that is the ``escape``. An empty field is null, a quoted
    empty one an empty text, as ``write_records`` leaves them. Records end at a line feed, before which a carriage return is dropped;
    within a value both are kept. Blank lines between records are passed over. The header is a file's first line, without line ends in
    its names. A file that ends inside a value fails the read, and so does a value that takes up a whole split. Other lines are shuffled
    once, by split.
    """
    if escape not in ('"', "\\"):
        raise ValueError("quotes are escaped by a quote or by a backslash")
    if schema is None:
        names = spark.read.option("header", header).csv(path).columns
        schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)
    records = _records(spark, path, header, escape)
    options = {"escape": escape, "multiLine": "true", "nullValue": NO_VALUE}
    return records.select(F.from_csv("record", schema, options).alias("row")).select("row.*")


def _records(spark: SparkSession, path: str, header: bool, escape: str) -> DataFrame:
    """``record``, the text of every record but headers."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        (_quotes(F.col("value"), escape) % 2).alias("odd"),
    )
    in_file = Window.partitionBy("file").orderBy("split")
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("odds"))
    splits = splits.withColumn("before", F.coalesce(F.sum("odds").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = splits.withColumn("all", F.sum("odds").over(Window.partitionBy("file")))

    def refused(reason: str) -> Column:
        return F.raise_error(F.concat(F.lit(reason), F.col("file"))).cast("bigint")

    # A record then has less than two splits.
    inside = (F.col("before") % 2 == 1) & (F.col("odds") == 0) & (F.col("split") > 0)
    before = F.when(F.col("all") % 2 == 1, refused("the file ends inside a quoted value: ")).when(
        inside, refused("a quoted value takes up a whole split: ")
    )
    splits = splits.select("file", "split", before.otherwise(F.col("before")).alias("before"))
    in_split = Window.partitionBy("file", "split").orderBy("at")
    placed = lines.join(splits, ["file", "split"])
    placed = placed.withColumn("line", F.row_number().over(in_split)).withColumn(
        "toggles", F.col("before") + F.coalesce(F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    alone = (F.col("toggles") % 2 == 0) & (F.col("odd") == 0)
    first = (F.col("split") == 0) & (F.col("line") == 1)
    # A record of several lines opens with an odd line and closes with one.
    kept = placed.withColumn("number", F.when(~alone, F.floor(F.col("toggles") / 2))).withColumn("first", first)
    whole = kept.filter("number is null").select(F.col("value").alias("record"), "first")
    parts = kept.filter("number is not null").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("parts"), F.max("first").alias("first")
    )
    joined = parts.select(F.array_join("parts.value", "\n").alias("record"), "first")
    records = whole.unionByName(joined)
    if header:
        records = records.filter(~F.col("first"))
    cut = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return records.select(cut.alias("record")).filter(F.trim("record") != "")
