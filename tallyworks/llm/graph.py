"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyworks.llm.tasks import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``); a component is named by its smallest node.

    Rounds of large-star and small-star: every node's larger neighbours are moved to its smallest one, then
    its smaller ones, until nothing moves. Minima are aggregated before the shuffle, and written, so that adaptive execution
    can split the edges of a node that has very many. Each round is written to the shared folder; the driver
    gets its row count and checksum. Nulls and loops are left out.
    """
    current = written(_directed(edges), "edges")
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        least = written(least, "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = written(large, "large")
        smaller = written(large.groupBy("a").agg(F.min("b").alias("least")), "smaller")
        moved = large.join(smaller, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("edge"))
        current = written(_directed(moved.select("edge.*")), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
