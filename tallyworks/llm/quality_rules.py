"""Quality rules with cross-document line frequency; built-in functions only.

Lines are normalised and hashed; the distinct texts that hold a line are counted per host. Lines
in so many of them are removed, and a document that loses too many of its words is rejected.
Rules on the document alone come first: too few words, or too many words in repeated windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.lines import let, line_rows, without_lines, words_in
from tallyworks.llm.tasks import named, text_or_empty, written

# A line is boilerplate of a host when it is in so many of the host's distinct texts, however many texts the host has.
MIN_TEXTS = 10
# The share of its words that a document must keep.
MIN_LEFT = 0.5

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more in the text.

    Windows are compared by hash. Where one repeats, they are sorted by it; neighbours then give the
    places of all repeated windows, and one pass over the places counts the words they cover.
    """
    hashes = F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda at: F.xxhash64(*[F.get(words, at + step) for step in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def places(ordered: Column) -> Column:
        def own(row: Column, at: Column) -> Column:
            before = (at > 0) & (F.get(ordered, at - 1)["hash"] == row["hash"])
            after = F.coalesce(F.get(ordered, at + 1)["hash"] == row["hash"], F.lit(False))
            return F.when(before | after, row["at"])

        return F.array_sort(F.array_compact(F.transform(ordered, own)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("words"))
        return F.aggregate(
            at,
            start,
            lambda seen, place: F.struct(
                place.alias("last"),
                (seen["words"] + F.least(F.lit(width), place - seen["last"]).cast("bigint")).alias("words"),
            ),
        )["words"]

    def count(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda value, at: F.struct(value.alias("hash"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(
            covered(let(ordered, places))
        )

    return let(hashes, count)


def measured(docs: DataFrame) -> DataFrame:
    """The documents with the measures of each text alone, and ``base_failed``."""
    # One expression from words to measures: the optimizer may move it, but no part of it is computed per word.
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    # The given row in a struct, so that no name of its columns meets one that is made here.
    found = docs.select(
        F.struct(*named(docs)).alias("row"),
        let(words_in(text), of_words).alias("measures"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda held: F.size(held) - F.size(F.array_distinct(held))).cast("bigint").alias("n_dup_lines"),
    ).select("row.*", "measures.n_words", "measures.word_chars", "n_symbols", "n_dup_lines", "measures.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def host_boilerplate(rows: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``source, line_hash`` of the lines in at least ``min_texts`` texts of a host. Copies of a text count once; a null host is a host."""
    per_line = rows.groupBy("source", "line_hash").agg(F.count_distinct("text_hash").alias("texts"))
    return per_line.filter(F.col("texts") >= min_texts).select("source", "line_hash")


def quality_rules(docs: DataFrame, min_texts: int = MIN_TEXTS, min_left: float = MIN_LEFT) -> DataFrame:
    """Every document with its measures, ``clean_text``, ``cut_lines``, ``cut_words`` and ``kept``.

    ``docs`` has ``doc_id, text, source``; columns of other names pass through, and any that has a
    name of the result, in whatever letter case, is replaced. Null text counts as empty and fails for want of words, so nothing
    is kept of it. Repeated rows get equal results, each on a row of its own. An empty table gives an
    empty one.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "cut_lines", "cut_words", "kept"}
    docs = docs.drop(*made)
    rows = written(line_rows(docs), "lines")
    lines, frequent = rows.alias("r"), host_boilerplate(rows, min_texts).alias("f")
    cut = lines.join(
        frequent,
        F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.line_hash") == F.col("f.line_hash")),
    ).select("r.*")
    found = without_lines(measured(docs), cut)
    enough = F.col("n_words") - F.col("cut_words") >= min_left * F.col("n_words")
    return found.withColumn("kept", ~F.col("base_failed") & enough)
