"""Exact search for the largest integer inner products: a Voronoi join of queries with all vectors.

Vectors are numbered in 1,024ths. One more coordinate, which fills every vector up to the largest norm and is zero for
queries, makes the largest product the smallest distance; queries are scaled to that norm. Pivots divide this space into cells.
A first pass summarises the cells: how many queries each has and how far these are from its pivot, and for each pivot its
nearest vectors. The triangle inequality turns that into a distance that no query of a cell needs to look beyond. A second pass
sends a vector only to those groups of cells that it may be near enough to. There each task solves its part: cell by cell, nearest
pivot first, passing over cells and distance rings that the best found so far rule out. The bests of all parts are merged.

The table of cells has a fixed size. Queries of a full cell are split into blocks, small cells share one, and a block meets the
vectors it needs in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyworks.llm.hashing import mixed
from tallyworks.llm.tasks import for_workers, partitions, written

NEAREST = 10
EVERY = 100
SCALE = 1024
# Cells; the most vectors that pivots are fitted on, which go through the driver; and rounds of fitting.
PIVOTS = 64
FITTED = 4096
ROUNDS = 4
# Queries of one block, and vectors of one slice.
BLOCK = 1 << 14
SLICE = 1 << 15
# Products computed at a time.
PRODUCTS = 1 << 21
# Distances are rounded; bounds are loosened by this share of the largest norm.
SLACK = 1e-6
SEED = 11

# Products are exact in doubles below this, and fit a long if squared norms are below 2**62.
EXACT = 2.0**53
LARGEST = 2.0**62

FOUND = "query_id BIGINT, query_hash BIGINT, vec_id BIGINT, score BIGINT"


def _matrix(data: list[bytes], dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<i4").reshape(-1, dimensions) if dimensions else np.zeros((len(data), 0), "<i4")


def numbered(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dimensions, vector, norm``: usable vectors as bytes of 32-bit numbers floor(scale * x), and their squared norm."""
    for_workers(vectors.sparkSession)
    names = ["vec_id", "dimensions", "vector", "norm"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                held = values.values
                if held.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    whole = np.floor(scale * held.to_numpy(zero_copy_only=False).astype(np.float64))
                    norm = float((whole * whole).sum())
                if np.isfinite(whole).all() and norm < LARGEST:
                    whole = whole.astype(np.int64)
                    rows.append((vec_id, len(whole), whole.astype("<i4").tobytes(), int((whole * whole).sum())))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names)

    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return rows.mapInArrow(number, "vec_id BIGINT, dimensions INT, vector BINARY, norm BIGINT")


def _first_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows with the ``most`` smallest ids of each vector; rows that repeat both count once."""
    if not len(ids):
        return np.empty(0, np.int64)
    keys = np.ascontiguousarray(vectors).view(f"V{max(1, 4 * vectors.shape[1])}").ravel() if vectors.shape[1] else np.zeros(len(ids), "V1")
    _, which = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, which))
    which, held = which[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (which[1:] != which[:-1]) | (held[1:] != held[:-1])
    order, which = order[new], which[new]
    begin = np.searchsorted(which, which)
    return np.sort(order[np.arange(len(order)) - begin < most])


@dataclass
class Cells:
    """Pivots in the space with one more coordinate, and what the summaries tell of the cells."""

    pivots: np.ndarray
    largest: float
    dimensions: int
    # Of each cell: the least and greatest distance of its queries, and what none of them needs to look beyond.
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    reach: np.ndarray | None = None
    # The first block of each cell's queries, and the number of its blocks.
    block: np.ndarray | None = None
    blocks: np.ndarray | None = None

    @property
    def slack(self) -> float:
        return SLACK * max(self.largest, 1.0)

    def filled(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        vectors = vectors.astype(np.float64)
        squares = (vectors * vectors).sum(axis=1)
        if queries:
            scale = np.divide(self.largest, np.sqrt(squares), out=np.zeros(len(vectors)), where=squares > 0)
            return np.column_stack((vectors * scale[:, None], np.zeros(len(vectors))))
        return np.column_stack((vectors, np.sqrt(np.maximum(self.largest**2 - squares, 0))))

    def distances(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """From every vector to every pivot."""
        return _apart(self.filled(vectors, queries), self.pivots)

    def needed(self, apart: np.ndarray) -> np.ndarray:
        """Which vectors, given by their distances to the pivots, may be among the nearest of a query of which cell."""
        own = apart.argmin(axis=1)
        between = _apart(self.pivots, self.pivots)[own]
        # To the plane between the pivots of both cells, on whose other side the queries are.
        plane = np.divide(apart**2 - apart.min(axis=1)[:, None] ** 2, 2 * between, out=np.zeros_like(apart), where=between > 0)
        nearest = np.maximum(np.maximum(apart - self.high, self.low - apart), plane)
        return nearest <= self.reach + self.slack


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    squares = (one * one).sum(axis=1)[:, None] + (two * two).sum(axis=1) - 2 * one.dot(two.T)
    return np.sqrt(np.maximum(squares, 0))


def fit(base: DataFrame, largest: float, dimensions: int, pivots: int, seed: int) -> Cells:
    """Pivots: means of a sample of at most ``FITTED`` vectors and as many queries, moved a few rounds."""
    order = F.xxhash64(F.lit(seed), "vector", "vec_id")
    cells, held = Cells(np.zeros((1, dimensions + 1)), largest, dimensions), []
    for queries in (False, True):
        rows = (base.filter("asked") if queries else base).orderBy(order, "vec_id").limit(FITTED).select("vector").collect()
        held.append(cells.filled(_matrix([bytes(row.vector) for row in rows], dimensions), queries))
    sample = np.concatenate(held)
    points = np.unique(sample[np.random.default_rng(seed).permutation(len(sample))[:pivots]], axis=0)
    for _ in range(ROUNDS):
        own = _apart(sample, points).argmin(axis=1)
        counts = np.bincount(own, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, own, sample)
        points = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points)
    cells.pivots = np.unique(points, axis=0)
    return cells


def _nearest_of(ids: np.ndarray, apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least distances, one per id."""
    order = np.lexsort((apart, ids))
    ids, apart = ids[order], apart[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    ids, apart = ids[new], apart[new]
    kept = np.argsort(apart, kind="stable")[:most]
    return ids[kept], apart[kept]


def summarise(base: DataFrame, cells: Cells, nearest: int) -> None:
    """Fill in the table of cells. A task summarises its vectors, and the summaries of each cell are put together."""
    names = ["query", "cell", "n", "low", "high", "ids", "apart"]
    kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
    schema = "query BOOLEAN, cell INT, n BIGINT, low DOUBLE, high DOUBLE, ids ARRAY<BIGINT>, apart ARRAY<DOUBLE>"
    most = nearest + 1

    def put(held: dict, key: tuple, n: int, low: float, high: float, ids: np.ndarray, apart: np.ndarray) -> None:
        if key in held:
            was = held[key]
            n, low, high = n + was[0], min(low, was[1]), max(high, was[2])
            ids, apart = _nearest_of(np.concatenate((ids, was[3])), np.concatenate((apart, was[4])), most)
        held[key] = (n, low, high, ids, apart)

    def rows(held: dict) -> list[pa.Array]:
        made = [(*key, n, low, high, ids.tolist(), apart.tolist()) for key, (n, low, high, ids, apart) in held.items()]
        return [pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * len(kinds), kinds)]

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            ids, asked = batch.column("vec_id").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("vector").to_pylist(), cells.dimensions)
            for query in (False, True):
                chosen = np.flatnonzero(asked) if query else np.arange(len(ids))
                if not len(chosen):
                    continue
                apart = cells.distances(vectors[chosen], query)
                own = apart.argmin(axis=1)
                apart = apart[np.arange(len(own)), own]
                for cell in np.unique(own).tolist():
                    at = np.flatnonzero(own == cell)
                    least = (np.empty(0, np.int64), np.empty(0)) if query else _nearest_of(ids[at], apart[at], most)
                    put(held, (query, cell), len(at), float(apart[at].min()), float(apart[at].max()), *least)
        yield pa.RecordBatch.from_arrays(rows(held), names)

    def together(table: pa.Table) -> pa.Table:
        held: dict = {}
        for row in table.to_pylist():
            put(held, (row["query"], row["cell"]), row["n"], row["low"], row["high"], np.array(row["ids"], np.int64), np.array(row["apart"]))
        return pa.table(rows(held), names)

    found = base.select("vec_id", "vector", "asked").mapInArrow(in_task, schema).groupBy("query", "cell").applyInArrow(together, schema).collect()
    count = len(cells.pivots)
    cells.low, cells.high, cells.reach = np.full(count, np.inf), np.full(count, -np.inf), np.full(count, -np.inf)
    sizes = np.zeros(count, np.int64)
    between = _apart(cells.pivots, cells.pivots)
    near = [(row.cell, np.array(row.ids, np.int64), np.array(row.apart)) for row in found if not row.query]
    for row in found:
        if row.query:
            cells.low[row.cell], cells.high[row.cell], sizes[row.cell] = row.low, row.high, row.n
            # A vector of another cell is no farther than by way of both pivots.
            bounds = np.concatenate([row.high + between[row.cell, cell] + apart for cell, _, apart in near])
            _, bounds = _nearest_of(np.concatenate([ids for _, ids, _ in near]), bounds, most)
            cells.reach[row.cell] = bounds[-1] if len(bounds) == most else np.inf
    # Cells near one another share a block until it is full; a cell with more than a block has several.
    cells.blocks = np.maximum(1, -(-sizes // BLOCK))
    cells.block = np.zeros(count, np.int64)
    number, filled = 0, 0
    for cell in np.argsort(between[0], kind="stable").tolist():
        if filled and filled + sizes[cell] > BLOCK:
            number, filled = number + 1, 0
        cells.block[cell] = number
        filled += int(sizes[cell])
        if cells.blocks[cell] > 1:
            number, filled = number + int(cells.blocks[cell]), 0


def _spread(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A hash of id and vector, for dealing rows out evenly."""
    odd = mixed(np.arange(1, vectors.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return mixed(ids.view(np.uint64) + (vectors.astype(np.int64).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64))


def deal(base: DataFrame, cells: Cells, slices: int, nearest: int) -> DataFrame:
    """``block, slice, query, ids, vectors``: each vector in the blocks that may need it, each query in all slices of its block."""
    names = ["block", "slice", "query", "ids", "vectors"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    first = np.unique(cells.block[np.isfinite(cells.low)]) if np.isfinite(cells.low).any() else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("vec_id").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            vectors, rows = _matrix(batch.column("vector").to_pylist(), cells.dimensions), []
            if not len(ids):
                continue
            # Of vectors that a batch has often, only the smallest ids can be among the nearest.
            kept = _first_copies(ids, vectors, nearest + 1)
            needed = cells.needed(cells.distances(vectors[kept], False))
            part = (_spread(ids, vectors) % np.uint64(slices)).astype(np.int64)
            for block in first:
                own = (cells.block == block) & np.isfinite(cells.low)
                at = kept[needed[:, own].any(axis=1)]
                at = at[np.argsort(part[at], kind="stable")]
                cuts = np.flatnonzero(np.diff(part[at])) + 1
                for rows_of in np.split(at, cuts) if len(at) else []:
                    for more in range(int(cells.blocks[own].max())):
                        rows.append((block + more, part[rows_of[0]], False, ids[rows_of].tobytes(), vectors[rows_of].tobytes()))
            chosen = np.flatnonzero(asked)
            if len(chosen):
                cell = cells.distances(vectors[chosen], True).argmin(axis=1)
                more = (_spread(ids[chosen], vectors[chosen]) >> np.uint64(32)) % cells.blocks[cell].astype(np.uint64)
                of = cells.block[cell] + more.astype(np.int64)
                for block in np.unique(of).tolist():
                    at = chosen[of == block]
                    rows += [(block, one, True, ids[at].tobytes(), vectors[at].tobytes()) for one in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names)

    return base.select("vec_id", "vector", "asked").mapInArrow(dealt, "block BIGINT, slice BIGINT, query BOOLEAN, ids BINARY, vectors BINARY")


class Best:
    """The best candidates of some queries so far, one per id and score."""

    def __init__(self, count: int, nearest: int):
        self.nearest = nearest
        self.query, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        # The score that another candidate has to reach.
        self.least = np.full(count, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(both) for both in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        query, ids, scores = query[new], ids[new], scores[new]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.nearest - 1
        self.least[query[last]] = scores[last]
        kept = place < self.nearest
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]


def solve(cells: Cells, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, nearest: int) -> Best:
    """The ``nearest`` largest products of each query with the vectors of other ids, ties to smaller ids."""
    best = Best(len(queries), nearest)
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    exact = lengths.max(initial=0) * cells.largest < EXACT
    kind = np.float64 if exact else np.int64
    lowest = -np.inf if exact else np.iinfo(np.int64).min
    apart = cells.distances(vectors, False)
    own = apart.argmin(axis=1)
    ring = apart[np.arange(len(own)), own]
    order = np.lexsort((ids, ring, own))
    own, ring, ids, vectors = own[order], ring[order], ids[order], vectors[order].astype(kind)
    held, begins = np.unique(own, return_index=True)
    ends = [*begins[1:].tolist(), len(own)]
    to_pivot = cells.distances(queries, True)
    home = to_pivot.argmin(axis=1)
    between = _apart(cells.pivots, cells.pivots)
    queries = queries.astype(kind)
    for cell in np.unique(home).tolist():
        asking = np.flatnonzero(home == cell)
        for place in np.argsort(between[cell, held], kind="stable").tolist():
            other, begin, end = int(held[place]), int(begins[place]), ends[place]
            # The distance at which a product would equal the least one wanted; for a query without length, any.
            with np.errstate(invalid="ignore"):
                squares = 2 * cells.largest**2 - 2 * best.least[asking].astype(np.float64) * (cells.largest / np.maximum(lengths[asking], 1e-300))
            reach = np.where((lengths[asking] > 0) & (best.least[asking] > np.iinfo(np.int64).min), np.sqrt(np.maximum(squares, 0)), np.inf) + cells.slack
            if other != cell and between[cell, other] > 0:
                plane = (to_pivot[asking, other] ** 2 - to_pivot[asking, cell] ** 2) / (2 * between[cell, other])
                near = plane <= reach
            else:
                near = np.ones(len(asking), bool)
            near &= (to_pivot[asking, other] - reach <= ring[end - 1]) & (to_pivot[asking, other] + reach >= ring[begin])
            chosen, reach = asking[near], reach[near]
            if not len(chosen):
                continue
            inner = int(np.searchsorted(ring[begin:end], (to_pivot[chosen, other] - reach).min())) + begin
            outer = int(np.searchsorted(ring[begin:end], (to_pivot[chosen, other] + reach).max(), "right")) + begin
            for low in range(inner, outer, 1 << 12):
                high = min(outer, low + (1 << 12))
                step = max(1, PRODUCTS // (high - low))
                for at in range(0, len(chosen), step):
                    some = chosen[at : at + step]
                    scores = queries[some].dot(vectors[low:high].T)
                    scores[query_ids[some][:, None] == ids[low:high]] = lowest
                    wanted = best.least[some].astype(kind)
                    if high - low > nearest:
                        wanted = np.maximum(wanted, np.partition(scores, high - low - nearest, axis=1)[:, high - low - nearest])
                    row, column = np.nonzero((scores >= wanted[:, None]) & (scores > lowest))
                    best.add(some[row], ids[low:high][column], scores[row, column].astype(np.int64))
    return best


def _solver(cells: Cells, nearest: int):
    kinds = [pa.int64()] * 4
    names = ["query_id", "query_hash", "vec_id", "score"]

    def solved(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy(zero_copy_only=False)

        def held(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = table.filter(pa.array(chosen))
            ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int64)
            data = b"".join(rows["vectors"].to_pylist())
            return ids, np.frombuffer(data, "<i4").reshape(len(ids), cells.dimensions)

        (query_ids, queries), (ids, vectors) = held(query), held(~query)
        if not len(query_ids) or not len(ids):
            return pa.table([pa.array([], kind) for kind in kinds], names)
        hashes = _spread(query_ids, queries).view(np.int64)
        own = np.unique(np.column_stack((query_ids, hashes)), axis=0, return_index=True)[1]
        query_ids, hashes, queries = query_ids[own], hashes[own], queries[own]
        kept = _first_copies(ids, vectors, nearest + 1)
        best = solve(cells, query_ids, queries, ids[kept], vectors[kept], nearest)
        return pa.table([pa.array(c, pa.int64()) for c in (query_ids[best.query], hashes[best.query], best.ids, best.scores)], names)

    return solved


def largest_products(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, pivots: int = PIVOTS, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``nearest`` largest integer inner products of each query, exactly.

    ``vectors`` has ``vec_id, embedding``; other columns are dropped. Components are floor(1024 * x), x as double. Queries are the
    rows with ``vec_id`` divisible by ``every``; candidates all rows with another id; where there are fewer, all are returned.
    Ties go to the smaller id. A vector takes no part if it or its id is null, if it holds null or non-finite components, if it is
    not of the commonest length (of several, the longest), or if its squared norm is 2**62 or more, as a product might not fit a
    long. Zero vectors take part. Repeated rows count once; rows with one id and other vectors are queries and
    candidates of their own, and one that gives a query the same score as another of its id counts once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = numbered(vectors).withColumn("asked", F.col("vec_id") % every == 0)
    base = written(base, "numbered")
    facts = base.groupBy("dimensions").agg(F.count("*").alias("n"), F.max("norm").alias("norm"))
    common = facts.orderBy(F.desc("n"), F.desc("dimensions")).first()
    if common is None:
        return _none(spark)
    base = base.filter(F.col("dimensions") == common.dimensions)
    cells = fit(base, float(np.sqrt(common.norm)), common.dimensions, pivots, seed)
    summarise(base, cells, nearest)
    slices = max(partitions(spark), -(-common.n // SLICE))
    found = deal(base, cells, slices, nearest).groupBy("block", "slice").applyInArrow(_solver(cells, nearest), FOUND)
    # Of each slice's best ones, one per id and score.
    merged = found.groupBy("query_id", "query_hash", "vec_id", "score").agg(F.lit(1).alias("one"))
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")
