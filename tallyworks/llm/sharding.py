"""Sharding by a two-pass external shuffle.

The first pass scatters records by a seeded hash over buckets that fit in memory. The second pass
shuffles each bucket by Fisher and Yates and lays the buckets end to end: a uniform order of all
records. Shards are equal runs of that order, so their row counts are at most one apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructType

from tallyworks.llm.tasks import for_workers, named, written

SHARDS = 24
SEED = 6
# What a bucket holds on average, and what a record takes besides its text.
BUCKET_BYTES = 32 << 20
RECORD_BYTES = 8
# Copies of one row that one task numbers.
COPIES = 1000


def record_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + RECORD_BYTES


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """``row, doc_id, size, order``: the records with the hash they are scattered by.

    The hash takes in all columns, and for rows that repeat another in all of them the number of the repetition, so that no
    value, however frequent, gathers records in one bucket. Such rows are aggregated before they are shuffled, and dealt out again ``COPIES`` at
    a time. Null and empty values hash alike only where whole rows are alike but for them, which their places then tell apart.
    """
    hashed = F.xxhash64(F.lit(seed), *[part for column in named(docs) for part in (column.isNull(), column)])
    held = docs.select(F.struct(*named(docs)).alias("row"), "doc_id", record_size().alias("size"), hashed.alias("hash"))
    order = lambda number: F.xxhash64(F.lit(seed), "hash", number).alias("order")
    often = held.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("hash").alias("of"))
    often = written(often, "repeated_rows")
    if often.isEmpty():
        return held.select("row", "doc_id", "size", order(F.lit(0).cast("bigint")))
    on = held["hash"] == often["of"]
    single = held.join(often, on, "left_anti").select("row", "doc_id", "size", order(F.lit(0).cast("bigint")))
    groups = held.join(often, on, "left_semi").groupBy("hash", "row").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    begins = groups.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    numbers = F.sequence(F.col("begin"), F.least(F.col("begin") + COPIES, F.col("n")) - 1)
    copies = begins.repartition(F.xxhash64("hash", "begin")).withColumn("number", F.explode(numbers))
    return single.unionByName(copies.select("row", F.col("row.doc_id").alias("doc_id"), "size", order(F.col("number"))))


def fisher_yates(count: int, seed: int) -> np.ndarray:
    """A uniform order of ``count`` places: each place is swapped with one not before it."""
    draw, order = np.random.default_rng(seed), np.arange(count)
    others = (np.arange(count) + np.floor(draw.random(count) * (count - np.arange(count))).astype(np.int64)).tolist()
    for place, other in enumerate(others):
        if other != place:
            order[place], order[other] = order[other], order[place]
    return order


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with ``shard`` and ``slot``; slots count from 0 without gap in every shard.

    ``docs`` has ``doc_id, text``; columns of other names pass through, ``shard`` and ``slot`` are
    replaced. The bucket of a record depends on its columns, and for one that repeats others on which repetition it is, so a repeated run
    gives the same shards, and copies are scattered like any records. Null text, null ids and
    repeated rows are records. An empty table gives an empty one, and with fewer records than shards
    some shards are empty. Maps, which have no order, can't be among the columns.
    """
    spark = docs.sparkSession
    for_workers(spark)
    docs = docs.drop("shard", "slot")
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(record_size()), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    scattered = _numbered(docs, seed).drop("size").withColumn("bucket", F.pmod("order", F.lit(buckets)))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("count"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))

    # Records meet the start of their bucket where they are shuffled to, so they are shuffled once.
    dealt = scattered.join(starts.hint("merge"), "bucket")
    schema = StructType(list(dealt.schema.fields)).add("rank", LongType())

    def shuffled(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        bucket = table.column("bucket")[0].as_py()
        order = fisher_yates(table.num_rows, [seed, bucket])
        ranks = np.arange(table.num_rows) + table.column("start")[0].as_py()
        return table.take(pa.array(order)).append_column("rank", pa.array(ranks, pa.int64()))

    placed = dealt.groupBy("bucket").applyInArrow(shuffled, schema)
    # Shard k has the places from floor(k * rows / shards) on.
    placed = placed.withColumn("shard", F.expr(f"cast((rank * {shards} + {shards - 1}) div {max(rows, 1)} as int)"))
    return placed.select("row.*", "shard", F.expr(f"rank - shard * {rows}L div {shards}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the records of a shard are ordered by slot within each file, and no two files of it overlap in slots.

    A task writes the runs of shards that its buckets hold, so nothing is shuffled once more.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The records of shards that were written, with ``shard`` and ``slot``."""
    return spark.read.parquet(path)
