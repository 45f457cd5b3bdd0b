"""Keyed cells: a wide table kept as one row per written value.

A cell is named by row key, column family and qualifier. Putting a cell again adds a
version; reading returns the version with the highest ``(ts, seq)``. The table is
partitioned by a hash of the row key and the catalog knows its partitions, so reading
one row lists and opens one folder, however large the table is. Files carry a bloom filter of their row keys, so a key that a
file does not have costs its footer and no row group. Values are bytes; text is put
as its UTF-8 bytes, and ``text_values`` reads it back. Superseded versions stay until the table is compacted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType

from tallyworks.operators.tables import quoted
from tallyworks.storage import Workspace

CELL_KEY = ("row_key", "family", "qualifier")
# Settings of the files' bloom filters; each is as large as its file's number of keys asks for.
BLOOM = {"parquet.bloom.filter.enabled#row_key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
CELL_COLUMNS = "row_key STRING, family STRING, qualifier STRING, value BINARY, ts BIGINT, seq BIGINT"


def buckets_for(expected_cells: int) -> int:
    """Folders of about ten million cells each, and 16 at least, which only spreads small tables.

    More folders make reading a row cheaper and writing dearer: every put opens a file in each folder it has cells for.
    """
    return max(expected_cells // 10_000_000, 16)


def create_cell_table(spark: SparkSession, name: str, families: Sequence[str], buckets: int = 256) -> bool:
    """Create a table for cells of the given column families unless it exists; true when created.

    ``buckets`` is the number of folders; ``buckets_for`` gives one for an expected size.
    """
    missing = not spark.catalog.tableExists(name)
    held = quoted(json.dumps(list(families)))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({CELL_COLUMNS}, row_bucket INT) USING parquet "
        f"OPTIONS ({', '.join(f'{quoted(option)} {quoted(value)}' for option, value in BLOOM.items())}) "
        f"PARTITIONED BY (row_bucket) "
        f"TBLPROPERTIES ('cells.families' = {held}, 'cells.buckets' = '{buckets}')"
    )
    return missing


def put_cells(cells: DataFrame, name: str) -> None:
    """Append versions of cells: ``row_key, family, qualifier, value, ts, seq``.

    A cell of a family the table does not have fails the write, and so does one without row key, family or
    qualifier. Binary values are kept as they are, others as the bytes of their text; a null value is a version
    like any other. The rows are rebalanced by folder; adaptive execution splits a folder holding far more
    than the others over several tasks and files.
    """
    families, buckets = _layout(cells.sparkSession, name)
    unknown = F.raise_error(F.concat(F.lit("unknown column family: "), F.col("family")))
    known = F.when(F.col("family").isin(families), F.lit(True)).otherwise(unknown.cast("boolean"))
    for part in CELL_KEY:
        known = F.when(F.col(part).isNull(), F.raise_error(F.lit(f"a cell without {part}")).cast("boolean")).otherwise(known)
    is_binary = isinstance(cells.schema["value"].dataType, BinaryType)
    value = F.col("value") if is_binary else F.col("value").cast("string").cast("binary")
    (
        cells.filter(known)
        .select(
            F.col("row_key").cast("string"),
            "family",
            "qualifier",
            value,
            F.col("ts").cast("bigint"),
            F.col("seq").cast("bigint"),
            _bucket(F.col("row_key").cast("string"), buckets).alias("row_bucket"),
        )
        .hint("rebalance", "row_bucket")
        .sortWithinPartitions("row_bucket", *CELL_KEY)
        .write.insertInto(name)
    )


def compact_cells(spark: SparkSession, name: str) -> int:
    """Drop superseded versions of cells, and give the number of folders that were written anew.

    Only folders that hold a cell in several versions are read and replaced, as a whole each; files of the others stay. Reads give the
    same before and after, also of null values, and a second call does nothing. What is kept is written to the shared folder first, so
    no folder is replaced by something that is still being read from it. As with any rewrite, no one else may put cells meanwhile.
    """
    cells = spark.table(name)
    versions = cells.groupBy("row_bucket", *CELL_KEY).agg(F.count("*").alias("n")).filter("n > 1")
    # Folders are as many as the table was created with; their numbers are one each.
    folders = [row.row_bucket for row in versions.select("row_bucket").distinct().collect()]
    if not folders:
        return 0
    path = Workspace.of(spark).path("compacted")
    changed = cells.filter(F.col("row_bucket").isin(folders))
    latest_by(changed, ["row_bucket", *CELL_KEY], ("ts", "seq")).write.parquet(path)
    # A session of its own, in which an overwrite replaces the folders that it writes to and no others.
    own = spark.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    arranged = own.read.schema(cells.schema).parquet(path).hint("rebalance", "row_bucket").sortWithinPartitions("row_bucket", *CELL_KEY)
    arranged.select(*cells.columns).write.insertInto(name, overwrite=True)
    spark.catalog.refreshTable(name)
    return len(folders)


def latest_by(frame: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` columns for every key.

    Spark keeps one row per key inside each map task before it shuffles, so many
    versions of a single key do not end up in one task.
    """
    newest = Window.partitionBy(*key).orderBy(*[F.desc(name) for name in order])
    return frame.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def latest_cells(cells: DataFrame) -> DataFrame:
    """The current value of every cell among versions of cells."""
    return latest_by(cells, CELL_KEY, ("ts", "seq")).select(*CELL_KEY, "value")


def get_row(spark: SparkSession, name: str, row_key: str) -> DataFrame:
    """The current cells of one row."""
    _, buckets = _layout(spark, name)
    in_bucket = F.col("row_bucket") == _bucket(F.lit(row_key), buckets)
    return latest_cells(spark.table(name).filter(in_bucket & (F.col("row_key") == row_key)))


def get_value(spark: SparkSession, name: str, row_key: str, family: str, qualifier: str) -> DataFrame:
    """The current value of one cell, or no row."""
    return get_row(spark, name, row_key).filter((F.col("family") == family) & (F.col("qualifier") == qualifier))


def text_values(cells: DataFrame) -> DataFrame:
    """Cells with their bytes read as UTF-8 text."""
    return cells.withColumn("value", F.decode("value", "UTF-8"))


def _bucket(row_key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(row_key), F.lit(buckets)).cast("int")


def _layout(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """The column families and the number of folders a cell table was created with."""
    properties = {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return json.loads(properties["cells.families"]), int(properties["cells.buckets"])
