"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyworks.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from tallyworks.llm.tasks import named
from tallyworks.storage import Workspace

# The last two stages have no equivalent in SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def _held(docs: DataFrame) -> DataFrame:
    """The columns that the operators take, and the given row in a struct, so that no name of its columns meets one of theirs."""
    return docs.select("doc_id", "text", "source", F.struct(*named(docs)).alias("given"))


def _with_text(held: DataFrame, names: list[str]) -> DataFrame:
    """The given rows with the cleaned text, and its length where there is a column for it."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return held.select(*[new.get(name, F.col(f"given.`{name.replace('`', '``')}`")).alias(name) for name in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; take a host's boilerplate lines out of the others.

    A null text has too few words and goes. Repeated rows are judged alike; a null source is a host. No rows give no rows.
    """
    return _with_text(quality_rules.quality_rules(_held(docs)).filter("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one occurrence of lines that many sites share; drop documents that consist of nothing else.

    A null text has no lines and stays. Repeated rows have the same lines cut. No rows give no rows.
    """
    return _with_text(line_dedup.line_dedup(_held(docs)).filter("not emptied"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones: the one with the smallest id, those without id last.

    Each distinct ``(doc_id, text)`` is a document of its own, so rows that share an id or have none are compared like
    any others. Of rows that repeat a document one stays, chosen by a hash of all columns. Texts without words, and null ones, are
    similar to nothing. No rows give no rows.
    """
    node = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    rows = docs.select(node.alias("node"), "doc_id", "text", F.xxhash64(*named(docs)).alias("hash"), F.struct(*named(docs)).alias("given"))
    groups = ngram_join.ngram_join(rows.select(F.col("node").alias("doc_id"), "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    components = groups.select(F.col("doc_id").alias("node"), "component_id").distinct()
    chosen = rows.select("node", "doc_id").join(components, "node").groupBy("component_id").agg(least.alias("least"))
    repeats = Window.partitionBy("node").orderBy("hash")
    kept = rows.join(chosen.select("least.node"), "node", "left_semi").withColumn("at", F.row_number().over(repeats))
    return kept.filter("at = 1").select("given.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks for, in training order: the order of the rows in the files they are written to.

    Null texts have no words and are taken with their neighbours; a null source is one. Of repeated rows any may be taken. No rows give no rows.
    """
    return mixing.stream(_held(docs)).select("given.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, packed in the order of the rows in their files.

    ``place`` is that of a document in the order: the number of its file, of the part of it, and the row. It tells copies of a document apart.
    Rows that come from no files are packed in any order, without it. Null texts are empty; repeated rows are documents; no rows give no rows.
    """
    file, part = (F.regexp_extract("_metadata.file_name", pattern, 1) for pattern in (r"^part-(\d+)-", r"-c(\d+)\."))
    number = lambda digits: F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
    place = F.shiftleft(number(file), 43) + F.shiftleft(number(part), 36) + F.col("_metadata.row_index")
    try:
        ordered = docs.select("doc_id", "text", place.alias("place"))
    except AnalysisException:
        return packing.pack_documents(docs)
    return packing.pack_in_order(ordered)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = Workspace.of(spark).path(name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
