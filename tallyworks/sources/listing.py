"""The files of a table, from the metadata that a scan has of every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TREE = "path STRING, depth INT, is_dir BOOLEAN, files BIGINT, len BIGINT, rows BIGINT"


def table_files(scan: DataFrame) -> DataFrame:
    """``path, len, rows`` of every file that a scan finds rows in.

    ``scan`` is a DataFrame straight from a file source. Rows are counted per file before the shuffle, so
    what is shuffled is a row per file and task; the driver gets nothing.
    """
    return scan.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("len")).agg(
        F.count("*").alias("rows")
    )


def file_tree(files: DataFrame, root: str) -> DataFrame:
    """Files and all folders above them below a root: ``path, depth, is_dir, files, len, rows``, in depth-first order.

    ``files`` has ``path, len, rows``; ``root`` is written as in these paths. Paths are relative to the root, and those of folders end with a slash.
    A folder has the number of files below it at any depth, their bytes and rows. Each path is taken apart into
    the folders above it, which are added up per task before the shuffle, so a folder of very many files is no hot key. A
    folder comes before what it holds, and names are in code-point order. Folders without a file below them are not told.
    """
    start = root.rstrip("/") + "/"
    parts = F.split(F.substring(F.col("path"), len(start) + 1, 1 << 30), "/")
    below = files.filter(F.startswith("path", F.lit(start))).select("len", "rows", parts.alias("parts"))
    sizes = F.sequence(F.lit(1), F.size("parts"))
    nodes = below.select("len", "rows", F.size("parts").alias("size"), "parts", F.explode(sizes).alias("depth"))
    nodes = nodes.select("len", "rows", "depth", (F.col("depth") < F.col("size")).alias("is_dir"), F.slice("parts", 1, F.col("depth")).alias("parts"))
    summed = nodes.groupBy("parts", "depth", "is_dir").agg(F.count("*").alias("files"), F.sum("len").alias("len"), F.sum("rows").alias("rows"))
    path = F.concat(F.array_join("parts", "/"), F.when(F.col("is_dir"), "/").otherwise(""))
    return summed.orderBy("parts").select(path.alias("path"), "depth", "is_dir", "files", "len", "rows")


def list_tree(spark: SparkSession, root: str, source: str = "text") -> DataFrame:
    """``file_tree`` of what a source reads below a root; no rows where there is no such root. Files without a row are not told."""
    from tallyworks.storage import path_exists, qualified_path

    if not path_exists(spark, root):
        return spark.createDataFrame([], TREE)
    return file_tree(table_files(spark.read.format(source).option("recursiveFileLookup", True).load(root)), qualified_path(spark, root))
