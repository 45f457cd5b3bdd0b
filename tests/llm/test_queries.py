"""The registered queries against DuckDB, and a guard for the registry."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from test_free import water_filled
from test_native import repeated
from test_ngram_join import brute_force

import corpus_pipeline
from corpus_pipeline import STAGES
from tallyworks.llm import mixing, packing, queries, warc
from tallyworks.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        connection.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, oracle, name):
    result = QUERIES[name](spark, DATA)
    answer = oracle.execute(ORACLES[name])
    names = [column[0] for column in answer.description]
    assert sorted(result.columns) == sorted(names)
    assert sorted(map(repr, result.select(*names).collect())) == sorted(
        f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, row))})" for row in answer.fetchall()
    )


def test_segments_of_the_archive_query_lie_apart(spark, tmp_path, monkeypatch):
    """A page of many segments has them in several archives, and comes back whole."""
    pages = [(at, f"http://a/{at}", "".join(chr(97 + (at * k) % 26) for k in range(300_000))) for at in range(1, 9)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(queries, "FILE_BYTES", 1 << 19, raising=False)
    written, write = [], warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda frame, path, **options: written.append(path) or write(frame, path, **options))
    rows = QUERIES["op10_warc_reassembly"](spark, str(tmp_path)).collect()
    assert sorted((row.page_id, row.payload_bytes) for row in rows) == [(at, 300_000) for at in range(1, 9)]
    held = defaultdict(set)
    for name, content in spark.read.format("binaryFile").load(written[0]).select("path", "content").collect():
        for record in warc.parsed(bytes(content)):
            held[record["origin_id"] or record["record_id"]].add(name)
    assert len(held) == 8 and all(len(files) > 1 for files in held.values())


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_the_pipeline_keeps_what_its_stages_decide(spark, tmp_path):
    """Each stage against its own input: decisions take effect, nothing else is lost."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, ids = docs.columns, {row.doc_id for row in docs.collect()}
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names
        left = [row.doc_id for row in docs.collect()]
        assert set(left) <= ids
        if number < 3:
            assert len(left) == len(set(left)) > 0.6 * len(ids)
        ids = set(left)
    tokens = stage_tokens = 0
    packed = STAGES[-1][1](spark, docs, DATA).collect()
    stage_tokens = sum(row.length for row in packed)
    tokens = len({row.sequence_id for row in packed}) * 2048
    assert stage_tokens > 0.9 * tokens and {row.doc_id for row in packed} == ids


def test_the_pipeline_cuts_boilerplate_of_a_hot_host(spark, documents):
    """A line in 2 % of a host's texts goes, a line in fewer than ten texts stays, and so does every document."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    texts = {i: own(i) for i in range(1000)}
    rows = [(i, ("menu line of the site\n" if i < 20 else "a line of few\n" if i < 29 else "") + text, "hot") for i, text in texts.items()]
    found = {row.doc_id: row.text for row in corpus_pipeline.quality(spark, documents(rows), DATA).collect()}
    assert found == {i: "a line of few\n" + text if 20 <= i < 29 else text for i, text in texts.items()}


def test_the_pipeline_passes_odd_columns_through(spark, tmp_path):
    """Columns with dots, backticks, and names of what the stages make come out of every stage as they went in."""
    names = ["doc_id", "text", "source", "n_chars", "a.b", "c`d", "_node", "_text_hash", "_measures", "_at", "kept", "clean_text", "position", "node", "given", "size"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), f"s{i % 3}", None, *[f"{name} {i}" for name in names[4:]]) for i in range(30)]
    quoted = [f"`{name.replace('`', '``')}` string" for name in names[4:]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, " + ", ".join(quoted))
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == names
        found.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held = docs.collect()
        assert {row.doc_id for row in held} == set(range(30)) or name == "mixing"
        assert all(row[column] == f"{column} {row.doc_id}" for row in held for column in names[4:])
    assert {row.doc_id for row in STAGES[-1][1](spark, docs, DATA).collect()} <= set(range(30))


def test_the_pipeline_of_no_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = [(1, None, "en", None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, None, None, None, None)]
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).collect() == []


def test_sequences_ascend_in_training_time(spark, tmp_path):
    """Packing follows the order that mixing wrote: later sequences hold later documents, and copies are told apart."""
    draw = random.Random(9)
    rows = [(i, " ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(50, 900))), f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    mixing.stream(docs).write.parquet(str(tmp_path / "mixed"))
    held = spark.read.parquet(str(tmp_path / "mixed"))
    order = held.selectExpr("doc_id", "position", "_metadata.file_name as file", "_metadata.row_index as at").collect()
    order = sorted(order, key=lambda row: (row.file, row.at))
    assert [row.position for row in order] == sorted(row.position for row in order)
    pieces = corpus_pipeline.packed(spark, held, DATA).collect()
    places = sorted({row.place for row in pieces})
    assert len(places) == len(order)
    time = {place: row.position for place, row in zip(places, order)}
    doc = {place: row.doc_id for place, row in zip(places, order)}
    assert all(row.doc_id == doc[row.place] for row in pieces)
    ranges = defaultdict(list)
    for row in pieces:
        ranges[row.sequence_id >> 40].append(time[row.place])
    spans = [(min(held), max(held)) for _, held in sorted(ranges.items())]
    assert len(spans) > 3 and all(one[1] <= two[0] for one, two in zip(spans, spans[1:]))
    assert sum(row.length for row in pieces) > 0.85 * 2048 * len({row.sequence_id for row in pieces})


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    """Unlike texts that share an id stay; one of each group of copies stays, with or without ids."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [(1, text("a")), (1, text("b")), (1, text("a")), (2, text("c")), (None, text("c") + " more"), (3, text("b")), (None, text("d")), (None, text("d")), (None, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = [tuple(row) for row in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    expected = [(1, text("a")), (1, text("b")), (2, text("c")), (None, text("d")), (None, text("e"))]
    assert sorted(found, key=str) == sorted(expected, key=str)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return " ".join(WORD.findall(line.lower()))


def without(text, cut):
    """The text without its lines at some positions."""
    return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in cut)


def plain_quality(rows):
    texts = defaultdict(set)
    for _, text, source in rows:
        for line in text.split("\n"):
            texts[source, normal(line)].add(text)
    left = []
    for doc_id, text, source in rows:
        words = WORD.findall(text)
        lines = [normal(line) for line in text.split("\n")]
        cut = {at for at, line in enumerate(lines) if line and len(texts[source, line]) >= 10}
        lost = sum(len(lines[at].split()) for at in cut)
        if len(words) >= 20 and 100 * repeated(text) <= 30 * len(words) and 2 * (len(words) - lost) >= len(words):
            left.append((doc_id, without(text, cut), source))
    return left


def plain_lines(rows):
    sites, first = defaultdict(set), {}
    for doc_id, text, source in rows:
        for at, line in enumerate(map(normal, text.split("\n"))):
            if len(line.split()) >= 4:
                sites[line].add(source)
                place = (doc_id is None, doc_id or 0, at)
                first[line] = min(first.get(line, place), place)
    left = []
    for doc_id, text, source in rows:
        lines = enumerate(map(normal, text.split("\n")))
        cut = {at for at, line in lines if len(sites[line]) >= 10 and first[line] != (doc_id is None, doc_id or 0, at)}
        clean = without(text, cut)
        if not cut or WORD.search(clean):
            left.append((doc_id, clean, source))
    return left


def plain_near_duplicates(rows):
    rows = sorted(rows, key=lambda row: (row[0] is None, row[0] or 0, row[1]))
    return [rows[at] for at, _, component in brute_force(list(enumerate(row[1] for row in rows)), 5, 80) if at == component]


def test_the_pipeline_against_brute_force(spark, tmp_path):
    draw = random.Random(11)
    text = lambda: "\n".join(" ".join(f"w{draw.randrange(3000)}" for _ in range(draw.randrange(10, 20))) for _ in range(4))
    rows = [(i, text(), f"s{i % 12}") for i in range(120)]
    rows += [(200 + i, "Menu  of the site\n" + text(), "s0") for i in range(14)]
    rows += [(300 + i, text() + "\nall of these sites share this very same line", f"s{i}") for i in range(11)]
    rows += [(400 + i, re.sub(r"w\d+", "edited", rows[i][1], count=1), "s3") for i in range(20)]
    rows += [(500 + i, rows[30 + i][1], "s4") for i in range(10)]
    rows += [(600 + i, "too few words", "s5") for i in range(3)] + [(610, "a b c d e f g h " * 5, "s5")]
    rows += [(620, "menu of the site\n" + "x y z\n" + "menu of the site " * 8, "s0"), (None, rows[50][1], "s6"), (None, text(), "s6")]
    draw.shuffle(rows)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = [len(rows)]
    for stage in (plain_quality, plain_lines, plain_near_duplicates):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(row.doc_id for row in pieces)
    words = defaultdict(int)
    for _, held, source in rows:
        words[source] += len(WORD.findall(held))
    targets = water_filled(words, {source: 1 + at % 3 for at, source in enumerate(sorted(words))}, 3)
    taken = defaultdict(int)
    for doc_id, held, source in rows:
        rounds = int(targets[source] / words[source] + 1e-9)
        assert copies[doc_id] in (rounds, min(3, rounds + 1))
        taken[source] += copies[doc_id] * len(WORD.findall(held))
    largest = max(len(WORD.findall(held)) for _, held, _ in rows)
    assert all(abs(taken[source] - targets[source]) <= largest for source in words)
    assert set(copies) <= {doc_id for doc_id, _, _ in rows}
    alone = packing.pack_documents(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")).collect()
    lengths = {row.doc_id: row.length for row in alone}
    assert len(alone) == len(rows) and all(row.length == lengths[row.doc_id] for row in pieces)
