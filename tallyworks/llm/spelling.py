"""Spelling variants: words one edit apart, found by comparing blocks of padded code-point matrices.

Two words are near when one inserted, deleted or replaced code point turns one into the other: the length of
their common prefix plus that of their common suffix reaches the longer length minus one. So either is at
least half of the longer word, and near words share their first or their last half. Words are dealt into tiles by
these halves; inside a tile the words of a half are compared all with all, as matrices of code points, a row of cells
per pair. A half that very many words share is split into blocks, and every pair of blocks is a tile. A tile gives
each word its number of near words and the best of them, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.tasks import for_workers, partitions, written

# Letters of a word, and the letters that are lowered; fixed values.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 6
LEAST_COUNT = 5
# How many times as often as a word its form is, at least.
TIMES = 5
# Words, and code points, of one block; code points of the words of a task; cells compared at a time.
BLOCK = 4096
BLOCK_POINTS = 1 << 22
TASK_POINTS = 1 << 23
CELLS = 1 << 22


def letter_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, run``: every maximal run of at least ``least`` letters, A-Z lowered. Null text has none."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words (column ``word``) that are long and frequent enough; counted per task before the shuffle."""
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """A row per half that a word may share: the side it is on, the lengths ``a`` and ``b`` of the two words compared, and the half.

    Words are compared with those of their own length and, as the shorter and as the longer one, with
    those that differ by one. The half is that of the longer word, rounded down.
    """
    length = F.length("word")

    def half(side: int, a: Column, b: Column, role: str) -> Column:
        size = F.floor(b / 2).cast("int")
        key = F.substring(F.col("word"), F.lit(1), size) if side == 0 else F.substring(F.col("word"), length - size + 1, size)
        return F.struct(F.lit(side).alias("side"), a.alias("a"), b.alias("b"), key.alias("key"), F.lit(role).alias("role"))

    shapes = [(length, length, "same"), (length, length + 1, "short"), (length - 1, length, "long")]
    halves = F.array(*[half(side, a, b, role) for side in (0, 1) for a, b, role in shapes])
    return words.select("word", "n", F.explode(halves).alias("half")).select("word", "n", "half.*").filter("a >= 0")


def _tiles(words: DataFrame, tasks: int, block: int) -> DataFrame:
    """The halves with the tile ``bucket, x, y`` to compare them in, and the block ``own`` that a word is of."""
    halves, key = _halves(words), ["side", "a", "b", "key"]
    capacity = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_POINTS) / F.greatest("b", F.lit(1))).cast("int")))
    sizes = halves.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > capacity)
    # Written: few halves are split, and adaptive execution sees how few.
    split = written(sizes.select(*key, F.ceil(F.col("size") / capacity).cast("int").alias("parts")), "split_halves")
    held = halves.join(split, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))

    def tile(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    own, every = F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)
    tiles = (
        F.when(F.col("role") == "short", F.transform(every, lambda other: tile(own, other)))
        .when(F.col("role") == "long", F.transform(every, lambda other: tile(other, own)))
        .otherwise(F.transform(every, lambda other: tile(F.least(own, other), F.greatest(own, other))))
    )
    bucket = F.pmod(F.xxhash64(*key), F.lit(tasks)).cast("int")
    return held.select("word", "n", *key, "role", "own", bucket.alias("bucket"), F.explode(tiles).alias("tile")).select(
        "word", "n", *key, "role", "own", "bucket", "tile.x", "tile.y"
    )


def code_points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as the rows of a matrix, in the narrowest type that holds them."""
    if not length:
        return np.zeros((len(words), 0), np.uint8)
    points = np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length)
    largest = points.max(initial=0)
    return points.astype(np.uint8 if largest < 1 << 8 else np.uint16 if largest < 1 << 16 else np.uint32)


def near_pairs(left: np.ndarray, right: np.ndarray, shared: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of two matrices that are one edit apart; rows of ``right`` are as long as those of ``left`` or one longer.

    Equal rows are no pair. With ``shared`` only pairs whose common prefix is shorter than that count.
    """
    a, b = left.shape[1], right.shape[1]
    step = max(1, CELLS // max(1, len(right) * max(a, 1)))
    rows, others = [], []
    for at in range(0, len(left), step):
        part = left[at : at + step, None, :]
        if a:
            unlike = part != right[None, :, :a]
            found = unlike.any(axis=2)
            prefix = np.where(found, unlike.argmax(axis=2), a)
            if b > a:
                unlike = part != right[None, :, b - a :]
            suffix = np.where(unlike.any(axis=2), unlike[:, :, ::-1].argmax(axis=2), a)
        else:
            prefix = suffix = np.zeros((part.shape[0], len(right)), np.int64)
        near = prefix + suffix >= b - 1
        if a == b:
            near &= prefix < a
        if shared is not None:
            near &= prefix < shared
        row, other = np.nonzero(near)
        rows.append(row + at)
        others.append(other)
    return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(others or [np.empty(0, np.int64)])


def _compared(table: pa.Table) -> pa.Table:
    """``word, near, best, best_n`` of the words of a tile that have near words there."""
    key = ["side", "a", "b", "key"]
    table = table.sort_by([(name, "ascending") for name in key]).combine_chunks()
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    # Numbers in the order in which forms are chosen: frequent ones first, then by code points.
    chosen = sorted(range(len(words)), key=lambda at: (-n[at], words[at]))
    rank = np.empty(len(words), np.int64)
    rank[chosen] = np.arange(len(words))
    new = np.zeros(max(0, len(words) - 1), bool)
    for name in key:
        column = table[name].combine_chunks()
        new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(words)]
    own, role = table["own"].to_numpy(), np.array(table["role"].to_pylist(), object)
    side, a, b = (table[name].to_pylist() for name in key[:3])
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for begin, end in zip(edges, edges[1:]):
        if end - begin < 2:
            continue
        rows = np.arange(begin, end)
        same = a[begin] == b[begin]
        left = rows[own[begin:end] == x] if same else rows[role[begin:end] == "short"]
        right = rows[own[begin:end] == y] if same else rows[role[begin:end] == "long"]
        if not len(left) or not len(right):
            continue
        one, two = code_points([words[at] for at in left], a[begin]), code_points([words[at] for at in right], b[begin])
        # What shares the first half was compared there.
        i, j = near_pairs(one, two, b[begin] // 2 if side[begin] else None)
        if same and x == y:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        for these, those in ((i, j), (j, i)):
            near += np.bincount(these, minlength=len(words))
            np.minimum.at(best, these, rank[those])
    at = np.flatnonzero(near)
    of = np.array(chosen, np.int64)[best[at]]
    return pa.table(
        {
            "word": pa.array([words[place] for place in at], pa.string()),
            "near": pa.array(near[at], pa.int64()),
            "best": pa.array([words[place] for place in of], pa.string()),
            "best_n": pa.array(n[of], pa.int64()),
        }
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: where the forms of forms end. Steps double each round, so few rounds are needed."""
    steps = written(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        on = steps.alias("s").join(steps.select(F.col("word").alias("via"), F.col("root").alias("next")), F.col("root") == F.col("via"), "left")
        after = written(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        steps = after.select("word", "root")


def spelling_variants(counts: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """Every word with its form, and the root its forms lead to: ``word, form, root, n, n_near, form_n``.

    ``counts`` has ``word, n``; other columns are dropped. ``n_near`` counts the words one edit away. The form is
    the one of these with the largest ``n``, ties going to the smaller in code-point order, if it is at least ``times`` (2 or
    more) times as frequent; else form and ``form_n`` are null and the root is the word. Rows of one word are
    added up. A null word, and a word without a positive count, is left out; the empty word is one. An empty table gives an empty one.
    """
    spark = counts.sparkSession
    for_workers(spark)
    if times < 2:
        raise ValueError("a form has to be more frequent than the word")
    words = counts.filter("word is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")).filter("n > 0")
    words = written(words, "words")
    points = words.agg(F.sum(6 * (F.length("word") + 8))).first()[0] or 0
    tasks = max(partitions(spark), -(-points // TASK_POINTS))
    schema = "word STRING, near BIGINT, best STRING, best_n BIGINT"
    found = _tiles(words, tasks, block).groupBy("bucket", "x", "y").applyInArrow(_compared, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best"))).alias("best")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    told = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.best").alias("best"), (-F.col("best.order")).alias("best_n")
    )
    frequent = F.col("best_n") >= times * F.col("n")
    told = written(told.select("word", "n", "n_near", F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")), "forms")
    last = roots(told.filter("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
