"""Mixing sources to target weights along a curriculum that changes over training time.

Every source has a schedule: its weight at some times of training, linear in between. The integral of a
schedule is the source's overall weight. Shares of the total by weight, capped at a number of
repeats of the source, are the targets. A source's documents, in a seeded order, are laid end to end
until the target is met, round after round if it is more than the source has. The place of a
document in that run is a share of the source's demand, and the time by which the schedule has
demanded that share is the document's training position. Documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.llm.tasks import WORD, named, partitions, written

Schedule = Sequence[tuple[float, float]]

# Schedules by the place of a source in order, repeating: steady, rising and falling, with integrals 1, 2 and 3.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 4.0), (1.0, 2.0)))
MOST_REPEATS = 3
SEED = 20
# Parts of each source within which documents are summed one after the other.
PARTS = 4096


def integral(schedule: Schedule) -> float:
    """The weight of a schedule over all of training. Knots ascend from time 0 to time 1; no weight is negative."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def position(schedule: Schedule, share: Column) -> Column:
    """The time at which a schedule has demanded a share of its integral."""
    whole, done = integral(schedule), 0.0
    found = F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        if area > 0:
            pieces.append((done + area, done, t0, w0, (w1 - w0) / (t1 - t0)))
        done += area
    for end, begin, t0, w0, slope in reversed(pieces):
        asked = F.greatest(F.least(share, F.lit(1.0)) * whole - begin, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * asked, F.lit(0.0)))
        # The stable form of the root of w0 * x + slope * x * x / 2 = asked.
        step = F.when(root + w0 > 0, 2 * asked / (root + w0)).otherwise(F.lit(0.0))
        found = F.when(share * whole <= end, F.lit(t0) + step).otherwise(found)
    return found


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``cycle`` and ``target`` to a table with one row per source and its ``source_size``.

    Sources are ordered by code point with null last; the place in that order, modulo the number of
    schedules, is ``cycle``. All sizes together are shared by weight. No target is above ``most`` times its
    source, and what that leaves is shared again among the others by weight. The level that
    does this is found by a few sums over the table of sources; only the sums reach the driver.
    """
    weights = [integral(schedule) for schedule in schedules]
    by = F.col("source").asc_nulls_last()
    # Places in order: numbers within range partitions, and the counts of the partitions before.
    ranged = sizes.repartitionByRange(partitions(sizes.sparkSession), by).withColumn("_task", F.spark_partition_id())
    ranged = written(ranged, "ranged_sources")
    counts = ranged.groupBy("_task").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("_task").orderBy(by)) - 1
    sizes = ranged.withColumn("_inside", inside).join(starts, "_task").withColumn("_place", F.col("_from") + F.col("_inside"))
    cycle = F.col("_place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(value)) for value in weights]), (F.col("cycle") + 1).cast("int"))
    placed = sizes.withColumn("cycle", cycle.cast("int")).withColumn("_weight", weight)
    placed = written(placed.drop("_task", "_inside", "_from", "_place"), "sources")
    ceiling = (most * F.col("source_size")).cast("double")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = 0.0, -1
    while True:
        capped = ceiling <= level * F.col("_weight")
        row = placed.agg(
            F.count_if(capped).alias("n"),
            F.sum(F.when(capped, ceiling)).alias("held"),
            F.sum(F.when(~capped, F.col("_weight"))).alias("weight"),
        ).first()
        if row.n == capped_before or not row.weight:
            break
        capped_before, level = row.n, (total - (row.held or 0.0)) / row.weight
    share = F.lit(level) * F.col("_weight")
    full = row.weight is None
    return placed.withColumn("target", ceiling if full else F.least(ceiling, share)).drop("_weight")


def _keyed(docs: DataFrame, parts: int, seed: int) -> DataFrame:
    """Adds a source that is never null, the size, the place in the seeded order and the part."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    held = docs.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_size", size)
    held = held.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "_size"))
    return held.withColumn("_part", F.pmod("_order", F.lit(parts)).cast("int"))


def _facts(sizes: DataFrame, schedules: Sequence[Schedule], most: int) -> DataFrame:
    """``_key, _part, _start, source_size, cycle, target``: what every part of a source has to know."""
    part_sizes = sizes.groupBy("_key", "_part").agg(F.first("source").alias("source"), F.sum("_size").alias("_part_size"))
    part_sizes = written(part_sizes, "part_sizes")
    totals = part_sizes.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_part_size").alias("source_size"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part_sizes.select("_key", "_part", F.coalesce(F.sum("_part_size").over(before), F.lit(0)).alias("_start"))
    return starts.join(targets(totals, schedules, most).drop("source"), "_key")


def _scheduled(rows: DataFrame, facts: DataFrame, schedules: Sequence[Schedule], most: int) -> DataFrame:
    """Adds ``source_size, target, copies, positions`` to rows that ``_keyed`` prepared."""
    inside = (
        Window.partitionBy("_key", "_part").orderBy("_order", F.col("doc_id").asc_nulls_last(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    )
    run = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = run.join(facts, ["_key", "_part"]).withColumn("_before", F.col("_start") + F.col("_inside"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    joined = joined.withColumn("_rounds", rounds.cast("int"))
    rest = F.col("target") - F.col("_rounds") * F.col("source_size")
    nearer = (rest > 0) & (F.col("_before") + F.col("_size") / 2 <= rest)
    joined = joined.withColumn("copies", F.least(F.col("_rounds") + nearer.cast("int"), F.lit(most)).cast("int"))
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))

    def at(number: Column) -> Column:
        share = F.when(F.col("target") > 0, (number * F.col("source_size") + F.col("_before")) / F.col("target")).otherwise(F.lit(0.0))
        found = F.lit(None).cast("double")
        for cycle, schedule in enumerate(schedules):
            found = F.when(F.col("cycle") == cycle, position(schedule, share)).otherwise(found)
        return found

    return joined.withColumn("positions", F.transform(numbers, at))


def mix(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST_REPEATS, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """Every document with how often the mix takes it and when, range-sorted by first position.

    Columns: ``doc_id, source, size, source_size, target, copies, taken, positions``; ``positions``
    has the training time, 0 to 1, of every copy. ``size`` is the number of words, none for null text. A
    document is taken whole; the last one of a source is taken if that comes nearer to the target.
    Documents without words are taken with their neighbours and add nothing. Null source is a source; a null
    ``doc_id`` is a document; of equal rows any may be the one that is taken. Same rows and seed,
    same mix. An empty table gives an empty one.

    Each source is cut into ``parts`` by a seeded hash, and within a part the order is the hash, so
    that no task has to sum a whole source.
    """
    sizes = written(_keyed(docs.select("doc_id", "source", "text"), parts, seed).drop("text"), "sizes")
    placed = _scheduled(sizes, _facts(sizes, schedules, most), schedules, most).select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("_size") * F.col("copies")).alias("taken"),
        "positions",
    )
    first = F.get("positions", F.lit(0))
    return placed.repartitionByRange(partitions(docs.sparkSession), first, "doc_id").sortWithinPartitions(first, "doc_id")


def stream(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST_REPEATS, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """The mix as training reads it: a row per copy, all columns of ``docs``, range-sorted by training position.

    Takes what ``mix`` takes. ``position`` is added, or replaced where ``docs`` has one.
    """
    own = F.struct(*named(docs.drop("position")))
    rows = _keyed(docs.select("doc_id", "source", "text", own.alias("_row")), parts, seed)
    sizes = written(rows.select("_key", "_part", "source", "_size"), "sizes")
    placed = _scheduled(rows.drop("text", "source"), _facts(sizes, schedules, most), schedules, most)
    copies = placed.select("doc_id", "_row", F.explode("positions").alias("position"))
    dealt = copies.repartitionByRange(partitions(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")
    return dealt.select("_row.*", "position")
