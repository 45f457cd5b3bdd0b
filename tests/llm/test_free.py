"""Mixing, sharding, archives, nearest neighbours and the classifier."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyworks.llm import mixing, nearest, quality_model, sharding, warc

DATA = "/root/testdata/sf0.001"


def water_filled(sizes, weights, most):
    """Targets by resharing the excess until none is above its ceiling."""
    total, full, targets = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[k] for k in full)
        open_weight = sum(weights[k] for k in sizes if k not in full)
        targets = {k: most * sizes[k] if k in full else rest * weights[k] / open_weight for k in sizes}
        over = {k for k in sizes if k not in full and targets[k] > most * sizes[k]}
        if not over:
            return targets
        full |= over


def test_targets_and_taken_words(spark, documents):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randrange(1, 40), draw.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)] + [(1000, "w " * 9, "zz")]
    plan = mixing.mix(documents(rows), parts=16)
    found = plan.collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {source: 1 + place % 3 for place, source in enumerate(order)}
    expected = water_filled(sizes, weights, 3)
    taken = defaultdict(int)
    for row in found:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(expected[row.source])
        assert row.taken == row.size * row.copies <= 3 * row.size and len(row.positions) == row.copies
        assert list(row.positions) == sorted(row.positions) and all(0 <= p <= 1 for p in row.positions)
        taken[row.source] += row.taken
    for source in sizes:
        assert abs(taken[source] - expected[source]) <= 20
    assert sorted(map(repr, mixing.mix(documents(rows[::-1]), parts=16).collect())) == sorted(map(repr, found))
    copies = mixing.stream(documents(rows), parts=16).collect()
    assert sorted((row.doc_id, round(row.position, 12)) for row in copies) == sorted((r.doc_id, round(p, 12)) for r in found for p in r.positions)
    assert [row.position for row in copies] == sorted(row.position for row in copies)


def test_places_of_many_sources(spark, monkeypatch):
    """Sources get their places in order without one task that sees them all."""
    names = [f"s{at:04}" for at in range(2000)] + [None]
    sizes = spark.createDataFrame([(name, 10) for name in names[::-1]], "source string, source_size bigint").repartition(5)
    plans, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda frame, label: plans.append(frame._jdf.queryExecution().analyzed().toString()) or write(frame, label))
    found = {row.source: row.cycle for row in mixing.targets(sizes).collect()}
    assert found == {name: at % 3 for at, name in enumerate(names)}
    assert plans and not any("windowspecdefinition(source" in plan for plan in plans)


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    schedule = ((0.0, 4.0), (0.25, 0.0), (0.5, 0.0), (1.0, 2.0))
    frame = spark.range(101).select((F.col("id") / 100.0).alias("y")).select("y", mixing.position(schedule, F.col("y")).alias("t"))
    for row in frame.collect():
        grid = np.linspace(0, row.t, 20_001)
        area = np.trapezoid(np.interp(grid, [t for t, _ in schedule], [w for _, w in schedule]), grid)
        assert area == pytest.approx(row.y * mixing.integral(schedule), abs=1e-4)


def test_mix_of_odd_rows(odd, odd_rows, nothing):
    assert len(mixing.mix(odd).collect()) == len(odd_rows) and mixing.mix(nothing).collect() == []
    assert all(row.copies <= 3 for row in mixing.mix(odd).collect())


def test_shards_hold_every_row_once(documents, odd_rows, tmp_path, spark):
    rows = odd_rows + [(i, f"text {i}", "a") for i in range(100, 300)]
    made = sharding.shuffle_into_shards(documents(rows), bucket_bytes=4000)
    found = made.collect()
    assert sorted(repr((r.doc_id, r.text)) for r in found) == sorted(repr((i, t)) for i, t, _ in rows)
    slots = defaultdict(list)
    for row in found:
        slots[row.shard].append(row.slot)
    counts = [len(slots.get(k, [])) for k in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(held) == list(range(len(held))) for held in slots.values())
    again = sharding.shuffle_into_shards(documents(rows[::-1]), bucket_bytes=4000).collect()
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in again} == {(r.doc_id, r.text, r.shard, r.slot) for r in found}
    ids = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.doc_id and r.doc_id >= 100]
    assert sum(a < b for a, b in zip(ids, ids[1:])) in range(70, 130)
    sharding.write_shards(made, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_copies_of_a_row_are_scattered(spark):
    """Rows that are alike in all columns, a null id among them, go to all buckets, and come back as often."""
    rows = [(None, "the same text " * 20, "x")] * 3000 + [(7, "another text " * 20, "x")] * 1500 + [(at, f"text {at} " * 20, "x") for at in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string").repartition(6)
    order = sharding._numbered(frame, 1).selectExpr("doc_id", "pmod(order, 20) as bucket").groupBy("doc_id", "bucket").count().collect()
    hot = [row["count"] for row in order if row.doc_id is None]
    assert len(hot) == 20 and max(hot) < 2 * 3000 / 20
    found = sharding.shuffle_into_shards(frame, shards=7, bucket_bytes=50_000).collect()
    assert sorted((row.doc_id or -1, row.text) for row in found) == sorted((i or -1, t) for i, t, _ in rows)
    assert len({(row.shard, row.slot) for row in found}) == 5000 and {row["a.b"] for row in found} == {"x"}


def test_shards_against_plain_python(spark, tmp_path):
    """The whole order by hand: buckets by hash, each shuffled by Fisher and Yates, end to end, cut into shards."""
    rows = [(at, f"text {at % 50} " * (at % 9)) for at in range(700)] + [(3, "again")] * 5 + [(None, None)] * 4
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    size, shards, seed = 2000, 5, 9
    total = sum(len((text or "").encode()) + 8 for _, text in rows)
    buckets = [[] for _ in range(-(-total // size))]
    for row in sharding._numbered(frame, seed).select("doc_id", "row.text", "order").collect():
        buckets[row.order % len(buckets)].append((row.order, row.doc_id, row.text))
    ranked = []
    for number, held in enumerate(buckets):
        if held:
            held.sort()
            order = list(range(len(held)))
            draw = np.random.default_rng([seed, number]).random(len(held))
            for place in range(len(held)):
                other = place + int(draw[place] * (len(held) - place))
                order[place], order[other] = order[other], order[place]
            ranked += [held[place] for place in order]
    expected, begin = [], 0
    for shard in range(shards):
        end = len(ranked) * (shard + 1) // shards
        expected += [(doc_id, text, shard, slot) for slot, (_, doc_id, text) in enumerate(ranked[begin:end])]
        begin = end
    made = sharding.shuffle_into_shards(frame, shards, seed, size)
    sharding.write_shards(made, str(tmp_path / "shards"))
    found = [(row.doc_id, row.text, row.shard, row.slot) for row in sharding.read_shards(spark, str(tmp_path / "shards")).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    runs = sharding.read_shards(spark, str(tmp_path / "shards")).selectExpr("shard", "slot", "_metadata.file_path as file", "_metadata.row_index as at").collect()
    by_file = defaultdict(list)
    for row in sorted(runs, key=lambda row: row["at"]):
        by_file[row.shard, row.file].append(row.slot)
    assert all(slots == sorted(slots) for slots in by_file.values())
    spans = sorted((shard, slots[0], slots[-1]) for (shard, _), slots in by_file.items())
    assert all(one[0] != two[0] or one[2] < two[1] for one, two in zip(spans, spans[1:]))


def test_few_and_no_shards(documents, nothing):
    assert sorted(r.slot for r in sharding.shuffle_into_shards(documents([(1, "a", "b"), (2, "c", "d")])).collect()) == [0, 0]
    assert sharding.shuffle_into_shards(nothing).collect() == []


def test_fisher_yates_is_uniform():
    counts = defaultdict(int)
    for seed in range(6000):
        counts[tuple(sharding.fisher_yates(3, seed).tolist())] += 1
    assert len(counts) == 6 and all(850 < n < 1150 for n in counts.values())


PAGES = "page_id bigint, url string, html string, digest string"


def test_pages_come_back_whole(spark, tmp_path):
    long, same = "\r\n\r\nWARC/1.1\r\né" * 9000, "equal " * 300
    rows = [(1, "http://a\r\nb%0A", long, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", same, "x"), (9, "u", same, "x"), (5, "u", same, "x")]
    rows += [(None, "u", same, "x"), (None, "v", "alone " * 300, "x"), (6, "u", "short", "x"), (7, "u", "short", "x"), (9, "u", same, "x")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, segment_bytes=700, chunk_bytes=300, file_bytes=20_000)
    assert spark.read.format("binaryFile").load(path).count() > 3
    found = warc.read_pages(spark, path).collect()
    expected = []
    for page_id, url, html, _ in rows:
        data = (html or "").encode()
        revisit = html == same and page_id != 9
        expected.append((page_id, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_archives_of_two_calls_are_read_together(spark, tmp_path):
    """Ids of one call are not those of another, and copies of a page all come back."""
    sets = [[(1, "u", "a" * 4000, "x")], [(2, "u", "b" * 5600, "x"), (1, "u", "a" * 4000, "x")] + [(3, None, "c" * 2500, "x")] * 5 + [(None, None, "short", "x")] * 3]
    paths = [str(tmp_path / name) for name in "vw"]
    for path, rows in zip(paths, sets):
        warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path, segment_bytes=1000, file_bytes=4000)
    found = warc.read_pages(spark, paths).collect()
    expected = [(1, 4000), (1, 4000), (2, 5600), *[(3, 2500)] * 5, *[(None, 5)] * 3]
    assert sorted([(r.page_id, r.payload_bytes) for r in found], key=str) == sorted(expected, key=str)
    assert {r.record_type for r in found} == {"response"}


def test_records_are_made_again_alike(spark, tmp_path):
    """A repeated task makes the same ids and places, and each record can be read by itself."""
    rows = [(page, "u", f"page {page // 2} " * 300, "x") for page in range(30)] * 2
    records = warc.record_rows(spark.createDataFrame(rows, PAGES).repartition(5), segment_bytes=500, packed=True)
    once, again = ({row.key: bytes(row.record) for row in records.repartition(count).collect()} for count in (3, 7))
    assert once == again and len(once) > 60
    assert all(len(list(warc.parsed(record))) == 1 for record in once.values())


def test_archives_stay_within_their_size(spark, tmp_path):
    rows = [(page, "u", f"page {page} " * 200, "x") for page in range(40)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, segment_bytes=700, archive_bytes=7000)
    records = warc.read_records(spark, path)
    files = spark.read.format("binaryFile").load(path)
    assert files.count() == -(-records.count() // 10)
    assert max(sum(len(one["block"]) for one in warc.parsed(bytes(row.content))) for row in files.collect()) <= 7000
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_pages(spark, path).collect()) == [(p, len(h)) for p, _, h, _ in rows]


def test_damaged_segments_are_told(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(1, "u", "abc " * 500, "x")], PAGES), path, segment_bytes=600)
    records = warc.read_records(spark, path)
    whole = lambda frame: [(r.record_type, r.complete) for r in warc.reassembled(frame).collect()]
    assert whole(records) == [("response", True)]
    assert whole(records.unionByName(records)) == [("response", True)]
    assert whole(records.filter("segment <> 2")) == [("response", False)]
    assert whole(records.filter("total_length is null")) == [("response", False)]
    assert whole(records.filter("segment <> 1")) == [("continuation", False)]


@pytest.mark.parametrize("body", [b"", b"5\r\nabc", b"x\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n\r\nz"])
def test_broken_framing(body):
    assert warc.dechunked(body) is None
    assert warc.dechunked(warc.chunked(body, 2)) == body


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).collect() == []


def test_hilbert_neighbours_touch():
    for bits, size in ((3, 2), (2, 3)):
        cells = np.array(np.meshgrid(*[np.arange(2**bits)] * size)).reshape(size, -1).T
        places = nearest.hilbert(cells, bits)
        assert sorted(places.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_recall_and_order(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = {row.vec_id: np.array(row.embedding, float) for row in frame.collect()}
    found = defaultdict(list)
    for row in nearest.nearest_neighbours(frame, block=64).collect():
        found[row.query_id].append((row.rank, row.vec_id, row.score))
    hits, asked = 0, [q for q in rows if q % 20 == 0]
    for query in asked:
        exact = sorted((-float(v @ rows[query]), k) for k, v in rows.items() if k != query)[:20]
        mine = sorted(found[query])
        assert [rank for rank, _, _ in mine] == list(range(1, 21))
        assert [(-s, k) for _, k, s in mine] == sorted((-s, k) for _, k, s in mine)
        assert all(s == pytest.approx(float(rows[k] @ rows[query]), abs=1e-12) for _, k, s in mine)
        hits += len({k for _, k in exact} & {k for _, k, _ in mine})
    assert set(found) == set(asked) and hits >= 0.9 * 20 * len(asked)


def test_recall_holds_where_the_windows_are_a_small_part_of_the_table(spark):
    """Evenly spread vectors, of which a window of one block to either side holds less than a tenth along each curve."""
    held = np.random.default_rng(3).normal(size=(4000, 32))
    held /= np.sqrt((held * held).sum(axis=1))[:, None]
    frame = spark.createDataFrame([(at, row) for at, row in enumerate(held.tolist())], "vec_id bigint, embedding array<double>")
    found = defaultdict(set)
    for row in nearest.nearest_neighbours(frame, curves=4, block=64).collect():
        found[row.query_id].add(row.vec_id)
    hits = 0
    for query in range(0, 4000, 20):
        scores = held.dot(held[query])
        scores[query] = -np.inf
        hits += len(found[query] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.95 * 20 * 200


@pytest.mark.parametrize("kind", ["float", "double"])
def test_windows_that_hold_all_true_neighbours_find_them(spark, kind):
    """With a recall of 1 and fewer queries than are tested, the result is that of comparing all; windows span many stretches."""
    held = np.random.default_rng(5).normal(size=(1500, 16)).astype("f4").astype("f8")
    held[700:760] = held[20]
    frame = spark.createDataFrame([(at, row) for at, row in enumerate(held.tolist())], f"vec_id bigint, embedding array<{kind}>")
    found = defaultdict(list)
    for row in nearest.nearest_neighbours(frame, nearest=5, curves=6, block=8, recall=1.0).collect():
        found[row.query_id].append((row.rank, row.vec_id))
    assert set(found) == set(range(0, 1500, 20))
    for query, mine in found.items():
        scores = held.dot(held[query])
        exact = sorted((-score, at) for at, score in enumerate(scores.tolist()) if at != query)[:5]
        assert [at for _, at in sorted(mine)] == [at for _, at in exact]


def test_the_cheapest_number_of_curves(spark):
    def plan(blocks, **options):
        """``blocks`` has the block of one query's only neighbour along each curve; the query is in block 100."""
        rows = [(1, curve, True, 100) for curve in range(len(blocks))] + [(2, curve, False, at) for curve, at in enumerate(blocks)]
        places = spark.createDataFrame(rows, "vector_id bigint, curve int, query boolean, block bigint")
        truth = spark.createDataFrame([(1, 2)], "vector_id bigint, other_id bigint")
        return nearest.search_plan(places, truth, 1.0, **options)

    assert plan([100] * 8, queries_per_block=100) == (4, 1)
    assert plan([0, 50, 90, 130, 99, 98], queries_per_block=100) == (5, 1)
    assert plan([0, 50, 97, 130, 99, 98], queries_per_block=1) == (4, 3)
    assert plan([90, 40], queries_per_block=100) == (2, 10)
    none = spark.createDataFrame([], "vector_id bigint, other_id bigint")
    places = spark.createDataFrame([(1, 0, True, 0)], "vector_id bigint, curve int, query boolean, block bigint")
    assert nearest.search_plan(places, none, 0.9, 100) == (1, 1)


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, rank string, score string"
    good = [(i, [1.0, 0.5], "x", "x") for i in range(60, 0, -1)] + [(0, [2.0, 0.0], "x", "x"), (0, [2.0, 0.0], "x", "x"), (70, [-1.0, 0.0], "x", "x")]
    bad = [(100, None, "x", "x"), (120, [0.0, 0.0], "x", "x"), (140, [None, 1.0], "x", "x"), (160, [float("nan"), 1.0], "x", "x"), (None, [1.0, 1.0], "x", "x"), (180, [1.0], "x", "x"), (200, [], "x", "x")]
    found = defaultdict(list)
    for row in nearest.nearest_neighbours(spark.createDataFrame(good + bad, schema)).collect():
        found[row.query_id].append((row.rank, row.vec_id, row.score))
    assert set(found) == {0, 20, 40, 60}
    assert [k for _, k, _ in sorted(found[0])] == list(range(1, 21))
    assert [k for _, k, _ in sorted(found[20])] == [0, *range(1, 20)]
    few = nearest.nearest_neighbours(spark.createDataFrame(good[-3:], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 70)]
    assert nearest.nearest_neighbours(spark.createDataFrame([], schema)).collect() == []


def test_features_of_texts_do_not_depend_on_the_batch():
    texts = ["One two Two two 3.", None, "", " x ", "é" * 50, "a b " * 400_000, "One two Two two 3."]
    together = list(quality_model.features(pa.array(texts, pa.string())))
    for text, own in zip(texts, together):
        (alone,) = quality_model.features(pa.array([text], pa.string()))
        assert np.array_equal(own, alone) and len(np.unique(own)) == len(own)


def test_the_fit_against_plain_counts(spark):
    """Ratios from counts by hand; the same model from any partitions; a sample of few bytes is still one."""
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    again = quality_model.train(docs.repartition(13), labels.repartition(2))
    assert (model.ratios == again.ratios).all() and np.allclose(model.weights, again.weights) and model.slope == pytest.approx(again.slope)
    counts = np.ones((2, quality_model.FEATURES))
    quality = {row.doc_id: row.quality for row in labels.collect()}
    held = [(row.text or "", quality[row.doc_id]) for row in docs.collect() if quality.get(row.doc_id) in (0, 1)]
    for (_, label), own in zip(held, quality_model.features(pa.array([text for text, _ in held], pa.string()))):
        counts[label, own] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.ratios, ratios)
    small = quality_model.train(docs, labels, sample_bytes=40_000)
    assert (small.ratios == model.ratios).all() and not np.allclose(small.weights, model.weights)


def test_a_rare_class_stays_in_a_sample_of_few_bytes(spark):
    """Classes have their shares of the bytes, and a row at least; copies of one text are not taken all for that."""
    sizes = [(1, place, 100) for place in range(10)] + [(0, 5, 100)] * 2
    assert quality_model._last_places(sizes, 1200) == {}
    assert quality_model._last_places(sizes, 600) == {1: 4, 0: None}
    docs = spark.createDataFrame([(at, f"word{at} " * 20 if at < 60 else "# rare") for at in range(62)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(at, int(at < 60)) for at in range(62)], "doc_id bigint, quality int")
    model = quality_model.train(docs, labels, sample_bytes=300)
    rare, other = (row.score for row in quality_model.score(docs.filter("doc_id in (1, 61)"), model).orderBy("doc_id", ascending=False).collect())
    assert rare < other


def test_held_out_quality(spark):
    data = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "labels"))
    model = quality_model.train(docs, labels.filter(quality_model.fold(labels.doc_id) != 0))
    scores = {row.doc_id: row.score for row in quality_model.score(docs, model).collect()}
    held = [(row.quality, scores[row.doc_id]) for row in labels.filter(quality_model.fold(labels.doc_id) == 0).collect()]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.7


def test_scores_without_both_classes(spark, odd, nothing):
    for labels in ([], [(4, 1, 0), (5, 1, 0), (None, 0, 0), (6, None, 0)]):
        model = quality_model.train(odd, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        scores = [row.score for row in quality_model.score(odd, model).collect()]
        assert len(scores) == 10 and len(set(scores)) == 1 and 0 < scores[0] < 1
        assert quality_model.score(nothing, model).collect() == []


def test_pages_of_a_hot_payload_are_split(eager_to_split):
    draw = random.Random(6)
    own = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(200))
    hot = own()
    pages = [(at, f"http://h/{at}", hot if at % 3 else own()) for at in range(1500)]
    records = warc.record_rows(eager_to_split.createDataFrame(pages, "page_id bigint, url string, html string").repartition(16))
    assert records.count() == 1500
    held = records.collect()
    assert sum(b"WARC-Type: revisit" in row.record for row in held) == 999
    assert "skew=true" in records._jdf.queryExecution().executedPlan().toString()
