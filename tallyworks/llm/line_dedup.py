"""Line dedup by the spread of a line over distinct sites; built-in functions only.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation. Lines whose estimate is
near the threshold get an exact distinct count. Of a line on enough sites one occurrence stays, the first
in the document with the smallest id; it is removed everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyworks.llm.lines import line_rows, without_lines
from tallyworks.llm.tasks import written

# Distinct sites that make a line boilerplate, and the words a line has at least.
MIN_SITES = 10
MIN_WORDS = 4
# The sketch's size as a power of two: a standard error of 1.6 percent.
SKETCH = 12
# Estimates within this share of the threshold are counted exactly; eight standard errors and more.
BAND = 0.15


def spread_lines(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line_hash`` of the lines on at least ``min_sites`` sites, and where each one stays.

    A null site is no site. ``first`` is the smallest ``(doc_id, text_hash, position)``, with rows
    without id last.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "position")
    # Most lines occur once. Only those with as many rows as sites are asked for can be spread.
    many = rows.groupBy("line_hash").agg(F.count("source").alias("n"), F.min(place).alias("first")).filter(F.col("n") >= min_sites)
    many = written(many, "many")
    # Written, so that each task sends one sketch of a hot line: after the join alone its rows are in one place.
    sites = written(rows.join(many.select("line_hash"), "line_hash", "left_semi").select("line_hash", "source"), "sites")
    estimated = sites.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", SKETCH)).alias("estimate"))
    near = F.col("estimate").between((1 - BAND) * min_sites - 1, (1 + BAND) * min_sites + 1)
    exact = (
        sites.distinct()
        .join(estimated.filter(near).select("line_hash"), "line_hash", "left_semi")
        .groupBy("line_hash")
        .agg(F.count("source").alias("exact"))
    )
    counted = estimated.join(exact, "line_hash", "left").filter(F.coalesce("exact", "estimate") >= min_sites)
    return many.join(counted.select("line_hash"), "line_hash", "left_semi").select("line_hash", "first")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with ``clean_text``, ``cut_lines``, ``cut_words`` and ``emptied``.

    ``docs`` has ``doc_id, text, source``; columns of other names pass through, and any that has a name
    of the result, in whatever letter case, is replaced. Lines compare as normalised, and those with under ``min_words`` words never
    count. ``emptied`` is true for a document all of whose words were removed. Null text has no
    lines and stays null. Repeated rows are cut alike. An empty table gives an empty one.
    """
    docs = docs.drop("clean_text", "cut_lines", "cut_words", "emptied")
    rows = written(line_rows(docs).filter(F.col("line_words") >= min_words), "lines")
    # Written, so that adaptive execution can split the rows of a line that very many documents hold.
    spread = written(spread_lines(rows, min_sites), "spread")
    first = F.col("first")
    elsewhere = ~(
        F.col("doc_id").eqNullSafe(first["doc_id"])
        & (F.col("text_hash") == first["text_hash"])
        & (F.col("position") == first["position"])
    )
    cut = rows.join(spread, "line_hash").filter(elsewhere).select(*rows.columns)
    found = without_lines(docs, cut)
    emptied = (F.col("cut_lines") > 0) & ~F.regexp_like(F.coalesce("clean_text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    return found.withColumn("emptied", emptied)
