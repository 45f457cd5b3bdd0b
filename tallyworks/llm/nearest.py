"""Approximate nearest neighbours by inner product along shifted space-filling curves.

Vectors are projected on a few directions, shifted, and ordered along a Hilbert curve; another rotation
and another shift give another order. The orders are range-partitioned and cut into blocks of equal row
count. A query is compared with all vectors of its own block and of as many to either side as its reach, in every
order. The reach is at least one block and grows until the windows hold ``RECALL`` of the true neighbours of a
sample of queries, which are found by comparing the sample with all vectors. The same sample tells which number of
orders, each with the reach that it needs, costs least; no more are searched. A task searches a stretch of blocks, so that a query
goes there once and not once per block. The windows' best are merged and ranked exactly.

The largest inner product becomes the smallest distance by one more coordinate, which fills every vector up
to the largest norm and is zero for queries. Equal vectors are one, with as many of their smallest ids as
could be wanted, so they fill no window. They are told apart by 64-bit hashes, so two of a billion vectors may be taken
for one with a chance of one in forty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import FloatType

from tallyworks.llm.tasks import for_workers, partitions, written

NEAREST = 20
# Orders at most and at least, directions in each, bits of each direction, and rows of a block.
CURVES = 16
FEWEST = 4
DIRECTIONS = 8
BITS = 8
BLOCK = 2048
# Blocks that a task searches at a time.
STRETCH = 16
# Taking a vector to a task costs about as much as comparing it with so many queries.
CARRIED = 800
# The most vectors that centre and spread of the coordinates are taken from; they go through the driver.
FITTED = 10_000
# The most queries whose true neighbours set the reach, and the share of these that the windows are to hold.
TESTED = 256
RECALL = 0.98
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (a row of coordinates below 2**bits) along the Hilbert curve, as unsigned numbers.

    The published transformation between coordinates and the curve, a bit plane at a time: inversions
    and exchanges undo the curve's rotations, and a Gray code gives the place.
    """
    axes = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for plane in range(bits - 1, 0, -1):
        high = one << np.uint64(plane)
        low = high - one
        for axis in range(len(axes)):
            turned = (axes[axis] & high) != 0
            exchanged = np.where(turned, np.uint64(0), (axes[0] ^ axes[axis]) & low)
            axes[0] ^= np.where(turned, low, exchanged)
            axes[axis] ^= exchanged
    for axis in range(1, len(axes)):
        axes[axis] ^= axes[axis - 1]
    flip = np.zeros(axes.shape[1], np.uint64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(plane)) & one, (one << np.uint64(plane)) - one, np.uint64(0))
    axes ^= flip
    place = np.zeros(axes.shape[1], np.uint64)
    for plane in range(bits - 1, -1, -1):
        for axis in axes:
            place = (place << one) | ((axis >> np.uint64(plane)) & one)
    return place


class Curves:
    """Rotations, shifts and scales that turn vectors into places along each curve."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, seed: int):
        self.largest = largest
        full = self.filled(sample, False)
        draw = np.random.default_rng(seed)
        self.directions = min(DIRECTIONS, full.shape[1])
        self.centre = full.mean(axis=0)
        self.turns = [np.linalg.qr(draw.normal(size=(full.shape[1], full.shape[1])))[0][:, : self.directions] for _ in range(curves)]
        self.shifts = [draw.uniform(0, 0.5, self.directions) for _ in range(curves)]
        self.spreads = [np.maximum((full - self.centre).dot(turn).std(axis=0), 1e-12) for turn in self.turns]

    def filled(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Candidates filled up to the largest norm; queries scaled to it."""
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        if queries:
            return np.column_stack((vectors * (self.largest / norms)[:, None], np.zeros(len(vectors))))
        return np.column_stack((vectors, np.sqrt(np.maximum(self.largest**2 - norms**2, 0))))

    def places(self, vectors: np.ndarray, queries: bool) -> Iterator[np.ndarray]:
        full = self.filled(vectors, queries) - self.centre
        for turn, shift, spread in zip(self.turns, self.shifts, self.spreads):
            # Four standard deviations to either side take half of the grid, and the shift moves within the other half.
            along = np.clip((full.dot(turn) / spread / 8 + 0.5) * 0.5 + shift, 0, 1)
            yield hilbert(np.minimum(along * 2**BITS, 2**BITS - 1), BITS)


def kind_of(vectors: DataFrame) -> str:
    """How the components are kept: as floats where they are floats, else as doubles."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def components_of(kind: str) -> Column:
    """A row's components in the type that they are kept in."""
    return F.transform("embedding", lambda value: value.cast("float" if kind == "<f4" else "double"))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors kept as bytes, as they are."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1)


def _doubles(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return _matrix(column, kind).astype("<f8", copy=False)


def distinct_vectors(vectors: DataFrame, nearest: int, every: int) -> DataFrame:
    """``vector_id, vector, ids, asked``: each distinct usable vector once.

    ``ids`` are its smallest ids, one more than can be wanted; ``asked`` tells that a query has it.
    """
    for_workers(vectors.sparkSession)
    kind = kind_of(vectors)
    values = components_of(kind)
    usable = F.forall("embedding", lambda value: F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False)))
    some = F.exists("embedding", lambda value: value != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable & some)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("values"))
    length = rows.groupBy(F.size("values").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("values") == (length.length if length else 0))
    smallest = Window.partitionBy("values").orderBy("vec_id")
    kept = rows.distinct().withColumn("at", F.row_number().over(smallest)).filter(F.col("at") <= nearest + 1)
    ids = kept.groupBy("values").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(F.col("vec_id") % every == 0).select("values").distinct().withColumn("asked", F.lit(True))
    joined = ids.join(asked, "values", "left").select(
        F.xxhash64("values").alias("vector_id"), "values", "ids", F.coalesce("asked", F.lit(False)).alias("asked")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(one, kind).tobytes() for one in batch.column("values").to_pylist()]
            arrays = [batch.column("vector_id"), pa.array(data, pa.binary()), batch.column("ids"), batch.column("asked")]
            yield pa.RecordBatch.from_arrays(arrays, ["vector_id", "vector", "ids", "asked"])

    return joined.mapInArrow(packed, "vector_id BIGINT, vector BINARY, ids ARRAY<BIGINT>, asked BOOLEAN")


def fit(spark: SparkSession, base: DataFrame, kind: str, curves: int, seed: int) -> Curves | None:
    """The curves, from the largest norm of all vectors and a sample of at most ``FITTED``."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _doubles(batch.column("vector"), kind)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((matrix * matrix).sum(axis=1)).max())])], ["norm"])

    largest = base.select("vector").mapInArrow(norms, "norm DOUBLE").agg(F.max("norm")).first()[0]
    if largest is None:
        return None
    sample = base.select("vector").orderBy(F.xxhash64(F.lit(seed), "vector_id")).limit(FITTED).collect()
    held = np.frombuffer(b"".join(bytes(row.vector) for row in sample), kind).reshape(len(sample), -1)
    return Curves(held.astype("<f8"), largest, curves, seed)


def ordered(base: DataFrame, kind: str, curves: Curves, block: int) -> DataFrame:
    """``vector_id, curve, block, query``: the block of every vector, and of every query, along every curve."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vector_id", "curve", "key", "query"]
        sign = np.uint64(1 << 63)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, matrix = batch.column("vector_id").to_numpy(), _doubles(batch.column("vector"), kind)
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for query, chosen in ((False, np.ones(len(ids), bool)), (True, asked)):
                if chosen.any():
                    for curve, places in enumerate(curves.places(matrix[chosen], query)):
                        count = len(places)
                        arrays = [ids[chosen], np.full(count, curve, np.int32), (places ^ sign).view(np.int64), np.full(count, query)]
                        yield pa.RecordBatch.from_arrays([pa.array(array) for array in arrays], names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            count = batch.num_rows
            arrays = [batch.column("vector_id"), batch.column("curve"), batch.column("query")]
            arrays += [pa.array(np.full(count, task, np.int32)), pa.array(np.arange(seen, seen + count))]
            seen += count
            yield pa.RecordBatch.from_arrays(arrays, ["vector_id", "curve", "query", "task", "place"])

    keyed = base.select("vector_id", "vector", "asked").mapInArrow(keys, "vector_id BIGINT, curve INT, key BIGINT, query BOOLEAN")
    by = ["curve", "key", "vector_id", "query"]
    ranged = keyed.repartitionByRange(partitions(base.sparkSession), *by).sortWithinPartitions(*by)
    placed = written(ranged.mapInArrow(numbered, "vector_id BIGINT, curve INT, query BOOLEAN, task INT, place BIGINT"), "order")
    counts = placed.groupBy("curve", "task").agg(F.count("*").alias("n"), F.min("place").alias("from"))
    before = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).alias("start"))
    return placed.join(starts, ["curve", "task"]).select(
        "vector_id", "curve", "query", F.floor((F.col("start") + F.col("place")) / block).cast("bigint").alias("block")
    )


def true_neighbours(base: DataFrame, kind: str, nearest: int, tested: int, seed: int) -> DataFrame:
    """``vector_id, other_id``: the nearest vectors of at most ``tested`` queries, each compared with all vectors."""
    sample = base.filter("asked").select("vector_id", "vector").orderBy(F.xxhash64(F.lit(seed), "vector_id")).limit(tested).collect()
    names = np.array([row.vector_id for row in sample], np.int64)
    queries = np.frombuffer(b"".join(bytes(row.vector) for row in sample), kind).astype("<f8").reshape(len(sample), -1)

    def nearest_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.empty((len(names), 0), np.int64), np.empty((len(names), 0))
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            held = batch.column("vector_id").to_numpy()
            found = queries.dot(_doubles(batch.column("vector"), kind).T)
            found[names[:, None] == held] = -np.inf
            ids, scores = np.hstack((ids, np.broadcast_to(held, found.shape))), np.hstack((scores, found))
            if scores.shape[1] > nearest:
                best = np.argpartition(-scores, nearest - 1, axis=1)[:, :nearest]
                ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        real = np.isfinite(scores)
        arrays = [np.broadcast_to(names[:, None], ids.shape)[real], ids[real], scores[real]]
        yield pa.RecordBatch.from_arrays([pa.array(array) for array in arrays], ["vector_id", "other_id", "score"])

    found = base.select("vector_id", "vector").mapInArrow(nearest_in_task, "vector_id BIGINT, other_id BIGINT, score DOUBLE")
    order = Window.partitionBy("vector_id").orderBy(F.desc("score"), "other_id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= nearest).select("vector_id", "other_id")


def search_plan(places: DataFrame, truth: DataFrame, recall: float, queries_per_block: float) -> tuple[int, int]:
    """How many curves to search, and how many blocks to either side of a query's own.

    For every number of curves from ``FEWEST`` on, the reach is the least with which the windows hold that share of
    the true neighbours; the cheapest of these is taken, by vectors carried and comparisons made.
    """
    asked = places.filter("query").select("vector_id", "curve", F.col("block").alias("own"))
    held = places.filter("not query").select(F.col("vector_id").alias("other_id"), "curve", "block")
    so_far = Window.partitionBy("vector_id", "other_id").orderBy("curve")
    apart = (
        truth.join(asked, "vector_id")
        .join(held, ["other_id", "curve"])
        .select("curve", F.min(F.abs(F.col("own") - F.col("block"))).over(so_far).alias("reach"))
    )
    counts = apart.groupBy("curve", "reach").count().orderBy("curve", "reach").collect()
    plans = []
    last = max((row.curve for row in counts), default=0)
    for curve in range(min(FEWEST - 1, last), last + 1):
        of_curve = [(row.reach, row["count"]) for row in counts if row.curve == curve] or [(1, 0)]
        seen = np.cumsum([count for _, count in of_curve])
        reach = max(1, of_curve[int(np.searchsorted(seen, recall * seen[-1]))][0])
        plans.append(((curve + 1) * (CARRIED + (2 * reach + 1) * queries_per_block), curve + 1, reach))
    return min(plans)[1:]


def _best(nearest: int, reach: int, kind: str):
    kept = nearest + 12

    def search(table: pa.Table) -> pa.Table:
        is_query = table["query"].to_numpy(zero_copy_only=False)
        empty = pa.table({"vector_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not is_query.any() or is_query.all():
            return empty
        table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
        is_query = table["query"].to_numpy(zero_copy_only=False)
        asked, held = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        queries, candidates = _doubles(asked["vector"], kind), _matrix(held["vector"], kind)
        own, blocks = asked["block"].to_numpy(), held["block"].to_numpy()
        ids = held["ids"].to_pylist()
        smallest = np.array([one[0] for one in ids])
        names, found_ids, scores = [], [], []
        query_ids = asked["vector_id"].to_pylist()
        for block in np.unique(own).tolist():
            first, last = np.searchsorted(own, [block, block + 1])
            begin, end = np.searchsorted(blocks, [block - reach, block + reach + 1])
            if begin == end:
                continue
            window = candidates[begin:end].astype("<f8", copy=False)
            count = min(kept, end - begin)
            for at in range(first, last, 128):
                rough = queries[at : min(at + 128, last)].dot(window.T)
                edge = -np.partition(-rough, count - 1, axis=1)[:, count - 1]
                for row, query in enumerate(queries[at : min(at + 128, last)]):
                    # All that tie with the last one, up to rounding.
                    near = np.flatnonzero(rough[row] >= edge[row] - 1e-9 * max(1.0, abs(edge[row])))
                    exact = np.einsum("ij,j->i", window[near], query)
                    order = np.lexsort((smallest[begin + near], -exact))[: nearest + 1]
                    for place in order.tolist():
                        for one in ids[begin + near[place]]:
                            names.append(query_ids[at + row])
                            found_ids.append(one)
                            scores.append(exact[place])
        return pa.table({"vector_id": pa.array(names, pa.int64()), "vec_id": pa.array(found_ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    return search


def nearest_neighbours(
    vectors: DataFrame,
    nearest: int = NEAREST,
    every: int = 20,
    curves: int = CURVES,
    block: int = BLOCK,
    seed: int = SEED,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found for each query, a row with ``vec_id`` divisible by ``every``.

    ``vectors`` has ``vec_id, embedding``; other columns are dropped. The score is the inner product in double
    precision; ties go to the smaller id. A query's own id is no candidate. Where there are fewer candidates, all
    are returned. Of ``curves`` orders as many are searched as are cheapest, ``FEWEST`` at least. The windows grow with the table where ``recall`` asks for it. Vectors that are null, zero, hold null or non-finite components, have no id, or are not
    of the commonest length take no part. Repeated rows count once. An empty table gives no rows.
    """
    spark, kind = vectors.sparkSession, kind_of(vectors)
    base = written(distinct_vectors(vectors, nearest, every), "vectors")
    fitted = fit(spark, base, kind, curves, seed)
    if fitted is None:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    places = ordered(base, kind, fitted, block)
    searched, reach = search_plan(places, true_neighbours(base, kind, nearest, TESTED, seed), recall, block / every)
    stretch = lambda at: F.greatest(F.floor(at / STRETCH), F.lit(0))
    own = F.col("block")
    around = F.when(F.col("query"), F.sequence(stretch(own - reach), stretch(own + reach))).otherwise(F.array(stretch(own)))
    dealt = places.filter(F.col("curve") < searched).withColumn("stretch", F.explode(around)).join(base, "vector_id")
    found = (
        dealt.select("curve", "stretch", "block", "query", "vector_id", "vector", "ids")
        .groupBy("curve", "stretch")
        .applyInArrow(_best(nearest, reach, kind), "vector_id BIGINT, vec_id BIGINT, score DOUBLE")
    )
    merged = found.groupBy("vector_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("vector_id").orderBy(F.desc("score"), "vec_id")
    best = merged.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= nearest + 1)
    asked = vectors.filter(F.col("vec_id") % every == 0).select(
        F.col("vec_id").cast("bigint").alias("query_id"), F.xxhash64(components_of(kind)).alias("vector_id")
    ).distinct()
    per_query = Window.partitionBy("query_id", "vector_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(best, "vector_id")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
