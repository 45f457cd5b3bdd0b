"""A quality classifier: naive Bayes support vectors on n-gram indicators.

The features of a text say which n-grams it has: words, runs of three bytes, and runs of three word shapes.
Their counts over all labelled rows, by class, give log-count ratios. Every indicator is scaled by its ratio
and a linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of those rows. A logistic
curve, fitted on rows the model has not seen, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.hashing import Words, mixed, words_of
from tallyworks.llm.tasks import for_workers, written

# Places for each kind of n-gram.
BYTE_RUNS = 1 << 16
WORD_PLACES = 1 << 17
SHAPE_RUNS = 1 << 13
FEATURES = BYTE_RUNS + WORD_PLACES + SHAPE_RUNS
# The most labelled rows that the hinge-loss model is fitted on, and bytes of their features; the counts take in all of them.
SAMPLE = 8000
SAMPLE_BYTES = 256 << 20
# Sums of so many tasks are added first, then those sums.
LEVEL = 256
SLICES = 64
COST = 10.0
ROUNDS = 30
SMOOTHING = 1.0
SEED = 3

# Classes of bytes that make up the shape of a word.
_CLASSES = np.full(256, 4, np.uint64)
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[ord("."), ord(","), ord(";"), ord(":")]] = 3
_CLASSES[128:] = 5


def _shapes(words: Words) -> np.ndarray:
    """A number for first byte, second byte, last byte, length and likeness to the word before."""
    lengths = words.ends - words.starts
    first = _CLASSES[words.data[words.starts]]
    second = _CLASSES[words.data[np.minimum(words.starts + 1, words.ends - 1)]]
    last = _CLASSES[words.data[words.ends - 1]]
    size = np.searchsorted([2, 4, 8, 16], lengths).astype(np.uint64)
    again = np.zeros(len(lengths), np.uint64)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    shape = first
    for part in (second, last, size, again):
        shape = shape * np.uint64(7) + part
    return shape


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of every text, ascending."""
    seen = np.zeros(BYTE_RUNS, bool)
    for _, words in words_of(column, lower=False):
        data = words.data.astype(np.uint64)
        runs = np.empty(0, np.int64)
        if len(data) > 2:
            runs = (mixed((data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]) >> np.uint64(48)).astype(np.int64)
        places = (words.hashes >> np.uint64(47)).astype(np.int64) + BYTE_RUNS
        shape_runs = np.empty(0, np.int64)
        if len(words.starts) > 2:
            shapes = _shapes(words)
            joined = (shapes[:-2] << np.uint64(40)) ^ (shapes[1:-1] << np.uint64(20)) ^ shapes[2:]
            shape_runs = (mixed(joined) >> np.uint64(51)).astype(np.int64) + BYTE_RUNS + WORD_PLACES
        for text in range(len(words.offsets) - 1):
            begin, end = words.offsets[text], words.offsets[text + 1]
            own = runs[begin : max(begin, end - 2)]
            seen[own] = True
            of_bytes = np.flatnonzero(seen)
            seen[of_bytes] = False
            one, two = words.first[text], words.first[text + 1]
            yield np.concatenate((of_bytes, np.unique(places[one:two]), np.unique(shape_runs[one : max(one, two - 2)]))).astype(np.int32)


@dataclass
class Model:
    """Weights with the ratios in them, and the logistic curve; without weights, one score for all."""

    weights: np.ndarray | None
    ratios: np.ndarray | None
    slope: float
    shift: float

    def scores(self, found: Iterator[np.ndarray], count: int) -> np.ndarray:
        if self.weights is None:
            return np.full(count, self.shift)
        margins = np.fromiter((self.margin(own) for own in found), np.float64, count)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))

    def margin(self, own: np.ndarray) -> float:
        values = self.ratios[own]
        norm = np.sqrt((values * values).sum())
        return float((values * self.weights[own]).sum() / norm) + self.weights[-1] if norm > 0 else float(self.weights[-1])


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: float, rounds: int, seed: int) -> np.ndarray:
    """Weights, and a bias at the end, that minimise half the squared norm plus ``cost`` times the hinge losses.

    One dual variable is optimised at a time, in a new random order each round, until none moves. The
    rarer class weighs as much as the other in sum.
    """
    weights = np.zeros(size + 1)
    squares = np.array([(values * values).sum() + 1.0 for _, values in rows])
    positive = (labels > 0).mean()
    bound = np.where(labels > 0, 0.5 / positive, 0.5 / (1 - positive)) * cost
    dual = np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for at in draw.permutation(len(rows)).tolist():
            own, values = rows[at]
            slope = labels[at] * ((weights[own] * values).sum() + weights[-1]) - 1
            new = min(max(dual[at] - slope / squares[at], 0.0), bound[at])
            step = new - dual[at]
            if step:
                dual[at] = new
                weights[own] += step * labels[at] * values
                weights[-1] += step * labels[at]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, by Newton's method on smoothed labels."""
    positive, negative = (labels > 0).sum(), (labels <= 0).sum()
    wanted = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        told = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
        error, spread = told - wanted, told * (1 - told) + 1e-9
        gradient = np.array([(error * margins).sum() + 1e-3 * (slope - 1), error.sum() + 1e-6 * shift])
        hessian = np.array([[(spread * margins * margins).sum() + 1e-3, (spread * margins).sum()], [(spread * margins).sum(), spread.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _last_places(sizes: list[tuple[int, int, int]], most: int) -> dict[int, int | None]:
    """For each class, the last place of ``label, place, size`` whose rows are taken when all of them have more than ``most`` bytes.

    A class has its share of the bytes; it is null where the rows of its first place, copies of one text, are more than that.
    """
    total = sum(size for _, _, size in sizes)
    if total <= most:
        return {}
    last: dict[int, int | None] = {}
    for kind in {kind for kind, _, _ in sizes}:
        held: dict[int, int] = {}
        for place, size in ((place, size) for label, place, size in sizes if label == kind):
            held[place] = held.get(place, 0) + size
        places = sorted(held)
        sums = np.cumsum([held[place] for place in places])
        taken = int((sums <= most * (sums[-1] / total)).sum())
        last[kind] = places[taken - 1] if taken else None
    return last


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = SEED, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """Fit on all given labels: counts over every row, the hinge-loss model on at most about ``sample`` of them.

    Where the features of that sample take more than ``sample_bytes``, as of very long texts, a part of it is taken that does not, drawn by hash within
    each class; of a class that has rows in the sample, one is taken at least.
    An empty table, of documents or labels, is one without rows of both classes.

    Labels other than 0 and 1 and labels of no document are left out; a document that is labelled twice counts
    twice. Without rows of both classes the score of every text is the smoothed share of label 1.
    """
    for_workers(docs.sparkSession)
    usable = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    share = min(1.0, sample / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    # Labels grow with the documents, so they are joined by a shuffle at every size.
    texts = docs.select("doc_id", "text").join(usable.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "label", drawn.alias("drawn"), fold(F.col("_id")).alias("fold"))
    width = -(-FEATURES // SLICES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        level = TaskContext.get().partitionId() % LEVEL
        sums, rows = np.zeros((2, width * SLICES), np.int64), np.zeros(2, np.int64)
        names = ["slice", "fold", "label", "data"]
        for batch in batches:
            made = []
            told = zip(batch.column("label").to_pylist(), batch.column("drawn").to_pylist(), batch.column("fold").to_pylist())
            for (kind, chosen, number), own in zip(told, features(batch.column("text"))):
                sums[kind, own] += 1
                rows[kind] += 1
                if chosen:
                    made.append((-1, number, kind, own.tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)
        if rows.sum():
            made = [(-2, level, kind, rows[kind : kind + 1].tobytes()) for kind in (0, 1)]
            made += [(at, level, kind, sums[kind, at * width : (at + 1) * width].tobytes()) for at in range(SLICES) for kind in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)

    def added(table: pa.Table) -> pa.Table:
        if table["slice"][0].as_py() == -1:
            return table
        total = sum(np.frombuffer(data, np.int64) for data in table["data"].to_pylist())
        return pa.table([table["slice"][:1], table["fold"][:1], table["label"][:1], pa.array([total.tobytes()], pa.binary())], table.column_names)

    schema = "slice INT, fold BIGINT, label INT, data BINARY"
    # One column holds the fold of a row of the sample, and the level of a sum. Sums of one level are added, and written with the sample.
    first = F.when(F.col("slice") == -1, F.pmod(F.xxhash64("data"), F.lit(SLICES))).otherwise(F.col("fold"))
    gathered = texts.mapInArrow(counted, schema).withColumn("_group", first).groupBy("slice", "label", "_group").applyInArrow(
        lambda table: added(table.drop_columns(["_group"])), schema
    )
    gathered = written(gathered, "class_counts")
    chosen = gathered.filter("slice = -1")
    # What decides on a row of the sample is a number each; the features are read once it is known which are taken.
    place = F.pmod(F.xxhash64(F.lit(seed), "data"), F.lit(1 << 30))
    sizes = [(row.label, row.place, row.size) for row in chosen.select("label", place.alias("place"), F.octet_length("data").alias("size")).collect()]
    for kind, last in _last_places(sizes, sample_bytes).items():
        own, others = F.col("label") == kind, chosen.filter(F.col("label") != kind)
        # Of a rare class one row is taken at least.
        chosen = others.union(chosen.filter(own).orderBy(place, "fold").limit(1) if last is None else chosen.filter(own & (place <= last)))
    drawn_rows = [(row.fold, row.label, bytes(row.data)) for row in chosen.collect()]
    totals, counts = np.zeros((2, width * SLICES)), np.zeros(2)
    for row in gathered.filter("slice <> -1").groupBy("slice", "label").applyInArrow(added, schema).collect():
        if row.slice == -2:
            counts[row.label] = np.frombuffer(row.data, np.int64)[0]
        else:
            totals[row.label, row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.data, np.int64)
    drawn_rows.sort()
    held = [(number, 1.0 if kind else -1.0, np.frombuffer(data, np.int32)) for number, kind, data in drawn_rows]
    known = np.array([kind for _, kind, _ in held])
    if not counts.all() or not (known > 0).any() or not (known < 0).any():
        return Model(None, None, 0.0, float((counts[1] + 1) / (counts.sum() + 2)))
    smoothed = totals[:, :FEATURES] + SMOOTHING
    ratios = np.log(smoothed[1] / smoothed[1].sum()) - np.log(smoothed[0] / smoothed[0].sum())
    rows = []
    for _, _, own in held:
        values = ratios[own]
        norm = np.sqrt((values * values).sum())
        rows.append((own, values / norm if norm > 0 else values))
    # Every fifth row is for the curve; where a class would have none left for either use, all rows serve both.
    aside = np.arange(len(rows)) % 5 == 4
    if min((known[aside] > 0).sum(), (known[aside] < 0).sum(), (known[~aside] > 0).sum(), (known[~aside] < 0).sum()) == 0:
        aside = np.ones(len(rows), bool)
        fitted = np.arange(len(rows))
    else:
        fitted = np.flatnonzero(~aside)
    weights = descend([rows[at] for at in fitted], known[fitted], FEATURES, COST, ROUNDS, seed)
    model = Model(weights, ratios, 1.0, 0.0)
    margins = np.array([model.margin(held[at][2]) for at in np.flatnonzero(aside)])
    model.slope, model.shift = logistic(margins, known[aside])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row, 0 to 1, from the text alone; null text is empty, and an empty text has a score too."""
    for_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            scores = held.scores(features(batch.column("text")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scored, "doc_id BIGINT, score DOUBLE")
