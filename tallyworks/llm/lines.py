"""Lines of documents as DataFrame rows; built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.tasks import SEPARATORS, named


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_in(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SEPARATORS + "+"), "")


def normalised(line: Column) -> Column:
    """A line as it is compared: in lower case, runs of separators as one blank, none at the ends."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.trim(F.regexp_replace(F.lower(line), runs, " "))


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: ``doc_id, source, text_hash, position, line_hash, line_words``.

    ``text_hash`` tells apart texts that share a ``doc_id``; null text has no lines.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda line, at: F.struct(at.alias("at"), normalised(line).alias("line"))),
        lambda row: row["line"] != "",
    )
    return (
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.explode_outer(lines).alias("row"))
        .filter(F.col("row").isNotNull())
        .select(
            "doc_id",
            "source",
            "text_hash",
            F.col("row.at").alias("position"),
            F.xxhash64("row.line").alias("line_hash"),
            (F.octet_length("row.line") - F.octet_length(F.replace(F.col("row.line"), F.lit(" "), F.lit(""))) + 1).alias("line_words"),
        )
    )


def without_lines(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The documents with ``clean_text``, ``cut_lines`` and ``cut_words`` added.

    ``cut`` holds rows of ``line_rows`` to be removed. Rows that repeat a document have the same
    lines removed. ``clean_text`` keeps the other lines as they were; null text stays null.
    """
    key = ["doc_id", "source", "text_hash"]
    one = cut.groupBy(*key, "position").agg(F.first("line_words").alias("line_words"))
    per_doc = one.groupBy(*key).agg(
        F.collect_set("position").alias("positions"), F.count("*").alias("cut_lines"), F.sum("line_words").alias("cut_words")
    )
    # The given row in a struct, so that no name of its columns meets one that is made here.
    held = docs.select(F.struct(*named(docs)).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("site"), "text", F.xxhash64("text").alias("hash"))
    left, right = held.alias("d"), per_doc.alias("c")
    on = (
        F.col("d.id").eqNullSafe(F.col("c.doc_id"))
        & F.col("d.site").eqNullSafe(F.col("c.source"))
        & (F.col("d.hash") == F.col("c.text_hash"))
    )
    # Positions are in order and matched in one pass over both arrays.
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.split("d.text", "\n")) - 1), F.col("c.positions"))
    clean = let(F.split("d.text", "\n"), lambda lines: F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n"))
    return left.join(right, on, "left").select(
        "d.row.*",
        F.when(F.col("c.cut_lines").isNull(), F.col("d.text")).otherwise(clean).alias("clean_text"),
        F.coalesce("c.cut_lines", F.lit(0)).alias("cut_lines"),
        F.coalesce("c.cut_words", F.lit(0)).alias("cut_words"),
    )

