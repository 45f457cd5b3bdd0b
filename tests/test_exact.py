"""Sums of doubles that do not depend on order, against sums of fractions."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyworks.operators.exact import exact_total_by
from tallyworks.plans import jobs
from tallyworks.sources import read_csv


def rounded(values):
    total = sum(map(Fraction, values), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def bits(value):
    return struct.pack("d", value + 0.0)


def drawn(draw):
    kind = draw.randrange(6)
    if kind == 0:
        return draw.uniform(-1e6, 1e6)
    if kind == 1:
        return draw.gauss(0, 1) * 2.0 ** draw.randrange(-1060, 1000)
    if kind == 2:
        return float(draw.randrange(-5, 5))
    if kind == 3:
        return draw.choice([-1, 1]) * 2.0 ** draw.randrange(-1074, 1023)
    if kind == 4:
        return math.nextafter(2.0 ** (20 * draw.randrange(-50, 50)), draw.choice([0, math.inf]))
    return draw.choice([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 2.2250738585072014e-308])


def test_totals_are_the_nearest_doubles(spark):
    draw, values = random.Random(1), {}
    for key in range(300):
        one = [drawn(draw) for _ in range(draw.choice([1, 2, 3, 10, 100]))]
        # Some totals cancel down to one small value, or to nothing.
        values[key] = one + [-value for value in one[: draw.choice([0, 0, len(one) - 1, len(one)])]]
    rows = [(key, value) for key, held in values.items() for value in held]
    draw.shuffle(rows)
    found = exact_total_by(spark.createDataFrame(rows, "k int, v double").repartition(5), "k", "v", "t").collect()
    assert {row.k: bits(row.t) for row in found} == {key: bits(rounded(held)) for key, held in values.items()}


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (None, 2.0), (None, 0.5), (3, nan), (3, 1.0), (4, inf), (4, -inf), (5, inf), (5, 1.0), (6, None), (6, 3.5), (7, -0.0), (8, -inf), (8, -1.0)]
    frame = spark.createDataFrame(rows, "`k.e` int, `v v` double")
    found = {row[0]: row[1] for row in exact_total_by(frame, "k.e", "v v", "t").collect()}
    assert math.isnan(found.pop(3)) and math.isnan(found.pop(4))
    assert found == {1: None, None: 2.5, 5: inf, 6: 3.5, 7: 0.0, 8: -inf}
    assert exact_total_by(frame.limit(0), "k.e", "v v", "t").collect() == []


def test_a_million_doubles_in_any_order(spark):
    """Over thirty powers of two: the same bits for two orders and two partition counts, which plain sums don't give."""
    size = F.pow(F.lit(2.0), (F.xxhash64("id") % 30).cast("double"))
    rows = spark.range(1_000_000, numPartitions=8).select((F.col("id") % 3).alias("k"), (size * F.rand(7) * F.when(F.col("id") % 2 == 0, -1.7).otherwise(1.9)).alias("v"))
    rows = rows.cache()
    frames = [rows, rows.orderBy("v"), rows.repartition(3, F.xxhash64("v")), rows.orderBy(F.desc("v")).coalesce(2)]
    totals = [sorted((row.k, bits(row.t)) for row in exact_total_by(frame, "k", "v", "t").collect()) for frame in frames]
    assert all(found == totals[0] for found in totals)
    held = {}
    for row in rows.collect():
        held.setdefault(row.k, []).append(row.v)
    assert totals[0] == sorted((key, bits(math.fsum(values))) for key, values in held.items())
    rows.unpersist()


@pytest.mark.parametrize("parts", [1, 7])
def test_the_flag_at_the_limit_never_flips(spark, folder, tmp_path, parts):
    """Ten times 0.1 and what is missing to 1.0: exactly the limit, in any order."""
    draw = random.Random(parts)
    values = [0.1] * 10 + [-5.551115123125783e-17, 1e16, -1e16, 3.3, -3.3]
    for at in range(parts):
        draw.shuffle(values)
        lines = "".join(f"T{number},DESK,{value!r},EUR\n" for number, value in enumerate(values))
        source = folder(f"positions-{at}.csv", "trade_id,desk,notional,currency\n" + lines)
        target = str(tmp_path / f"out-{at}")
        jobs.exposure_check(spark, source, target, 1.0)
        assert [tuple(row) for row in read_csv(spark, target, jobs.EXPOSURE).collect()] == [("DESK", 1.0, False)]


def test_a_hot_key_sends_a_row_per_task_and_bin(spark):
    from test_scale import shuffled_rows

    rows = spark.range(60_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    assert shuffled_rows(exact_total_by(rows, "k", "v", "t")) <= 2 * 8 * 2 + 2 * 2
