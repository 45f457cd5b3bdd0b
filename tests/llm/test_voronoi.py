"""The exact search for inner products, against comparing all with all."""

import math
import random

import numpy as np
import pytest

from tallyworks.llm import voronoi

ROWS = "vec_id bigint, embedding array<double>, score string"


def by_comparing(rows, nearest, every):
    usable = {}
    for vec_id, values, *_ in rows:
        if vec_id is None or values is None or any(x is None or not math.isfinite(x) for x in values):
            continue
        whole = tuple(math.floor(1024 * x) for x in values)
        if sum(x * x for x in whole) < 2**62:
            usable.setdefault(len(whole), set()).add((vec_id, whole))
    counts = {}
    for vec_id, values, *_ in rows:
        if values is not None and any((vec_id, tuple(math.floor(1024 * x) for x in values)) in held for held in usable.values() if all(x is not None and math.isfinite(x) for x in values)):
            counts[len(values)] = counts.get(len(values), 0) + 1
    if not counts:
        return []
    held = usable[max(counts, key=lambda size: (counts[size], size))]
    found = []
    for query_id, query in held:
        if query_id % every == 0:
            scores = {(-sum(x * y for x, y in zip(query, other)), vec_id) for vec_id, other in held if vec_id != query_id}
            found += [(query_id, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(sorted(scores)[:nearest], 1)]
    return sorted(found)


def checked(spark, rows, nearest=4, every=10, **options):
    frame = spark.createDataFrame([(*row, "x") for row in rows], ROWS).repartition(5)
    found = sorted(map(tuple, voronoi.largest_products(frame, nearest, every, **options).collect()))
    assert found == by_comparing(rows, nearest, every)
    return found


@pytest.mark.parametrize("kind", ["even", "clustered", "small", "long"])
def test_against_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 8)
    monkeypatch.setattr(voronoi, "SLICE", 60)
    draw = np.random.default_rng(3)
    if kind == "even":
        points = draw.normal(size=(400, 16))
    elif kind == "clustered":
        points = draw.normal(size=(6, 8)).repeat(70, axis=0) * 5 + draw.normal(size=(420, 8)) * 0.05
    elif kind == "small":
        # Few unlike products, so that ties decide.
        points = draw.integers(-1, 2, size=(400, 3)) / 512
    else:
        # Products beyond what doubles hold exactly.
        points = draw.normal(size=(300, 4)) * 2.0**18
    found = checked(spark, [(i, list(map(float, row))) for i, row in enumerate(points)], pivots=12)
    assert len(found) == 4 * -(-len(points) // 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (10, [0.0, 0.0]), (20, None), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [None, 1.0]), (None, [9.0, 9.0])]
    rows += [(60, [1e300, 0.0]), (70, [1.0, 2.0, 3.0]), (80, []), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.0001, 7.0]), (-10, [5.0, 5.0])]
    found = checked(spark, rows)
    assert {row[0] for row in found} == {0, 10, -10}


def test_copies_of_one_vector(spark, monkeypatch):
    """A third of all rows are equal: the smallest ids among them are found, in blocks of bounded size."""
    monkeypatch.setattr(voronoi, "BLOCK", 4)
    draw = random.Random(1)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [draw.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    checked(spark, rows, nearest=7)


def test_few_and_no_vectors(spark):
    assert checked(spark, []) == []
    assert checked(spark, [(10, [1.0])]) == []
    assert checked(spark, [(10, [1.0]), (11, [2.0])]) == [(10, 1, 11, 1024 * 2048)]
    assert checked(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_only_what_is_needed_is_sent(spark):
    """With clusters far apart most vectors are sent to few blocks."""
    draw = np.random.default_rng(5)
    points = draw.normal(size=(8, 8)).repeat(100, axis=0) * 20 + draw.normal(size=(800, 8)) * 0.01
    frame = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(points)], "vec_id bigint, embedding array<double>")
    base = voronoi.numbered(frame).withColumn("asked", voronoi.F.col("vec_id") % 10 == 0).cache()
    largest = float(np.sqrt(base.agg(voronoi.F.max("norm")).first()[0]))
    cells = voronoi.fit(base, largest, 8, 24, 1)
    voronoi.summarise(base, cells, 4)
    cells.block, cells.blocks = np.arange(len(cells.pivots)), np.ones(len(cells.pivots), np.int64)
    sent = voronoi.deal(base, cells, 1, 4).filter("not query").selectExpr("sum(length(ids) / 8)").first()[0]
    blocks = int(np.isfinite(cells.low).sum())
    assert blocks >= 8 and 80 <= sent < 0.5 * blocks * 800
    base.unpersist()
