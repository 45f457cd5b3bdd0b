"""Grouping, selection, text functions, cells and listings against plain Python."""

import collections
import os
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException

from tallyworks.functions.strings import split_pair
from tallyworks.operators import cells, grouping, selection
from tallyworks.sinks import write_lines, write_tab_text
from tallyworks.sources import read_csv, read_lines, read_tab_text, table_files
from tallyworks.storage import Workspace

few = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def test_only_five_characters_separate_words(spark):
    text = "a\tb  c\n\rd\fe\vf g\n "
    counted = grouping.count_words(spark.createDataFrame([(text,), (None,), ("",), ("a",)], "value STRING"))
    assert {row.word: row.cnt for row in counted.collect()} == {"a": 2, "b": 1, "c": 1, "d": 1, "e\vf g": 1}


@few
@given(st.lists(st.text(alphabet="ab\"é \t\n\r\f\v,", max_size=30), max_size=20))
def test_words_match_plain_python(spark, texts):
    frame = spark.createDataFrame([(text,) for text in texts], "value STRING")
    expected = collections.Counter(w for text in texts for w in re.split("[ \t\n\r\f]+", text) if w)
    assert {row.word: row.cnt for row in grouping.count_words(frame).collect()} == expected


def test_count_by_skips_null_keys(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "k STRING, v INT")
    assert {tuple(row) for row in grouping.count_by(frame, "k").collect()} == {("a", 2), (None, 0)}


def test_totals_of_nulls_are_null_and_not_flagged(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", None), ("a", None)], "k STRING, v DOUBLE")
    flagged = grouping.flag_above(grouping.total_by(frame, "k", "v", "total"), "total", 0)
    assert {tuple(row) for row in flagged.collect()} == {("a", 1.0, True), ("b", None, None)}


def test_split_pair(spark):
    head, rest = split_pair("line")
    lines = spark.createDataFrame([("A,10,9",), ("B",), ("",), (",x",), ("C,",), (None,)], "line STRING")
    assert [tuple(row) for row in lines.select(head, rest).collect()] == [
        ("A", "10,9"), ("B", None), ("", None), ("", "x"), ("C", ""), (None, None),
    ]


def test_column_as_text(spark):
    frame = spark.createDataFrame([(1, True), (None, False)], "n INT, b BOOLEAN")
    assert [row.val for row in selection.column_as_text(frame).collect()] == ["1", None]
    assert [row.val for row in selection.column_as_text(frame, "b").collect()] == ["true", "false"]


def test_rows_with_and_has_value(spark):
    frame = spark.createDataFrame([("FR", 1), ("DE", 2), (None, 3)], "c STRING, n INT")
    assert [row.n for row in selection.rows_with(frame, "c", "FR").collect()] == [1]
    assert {row.n for row in selection.rows_with(frame, "c", "FR", "DE").collect()} == {1, 2}
    assert selection.has_value(frame, "c", "DE") is True
    assert selection.has_value(frame, "c", "IT") is False


def test_untyped_csv_is_all_strings(spark, folder):
    frame = read_csv(spark, folder("sales.csv", "country,amount\nFR,100\n"))
    assert frame.dtypes == [("country", "string"), ("amount", "string")]


def test_lines_round_trip(spark, tmp_path):
    target = str(tmp_path / "lines")
    for lines in (["old"], ["bonjour rest", "", 'a"b\tc']):
        write_lines(spark.createDataFrame([(line,) for line in lines], "value STRING"), target)
    assert sorted(row.value for row in read_lines(spark, target).collect()) == ["", 'a"b\tc', "bonjour rest"]


field = st.one_of(st.none(), st.text(alphabet='ab",\\ é', min_size=1, max_size=6))


@few
@given(st.lists(st.tuples(field, st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1))), max_size=15))
def test_tab_text_round_trip(spark, tmp_path_factory, pairs):
    target = str(tmp_path_factory.mktemp("tab") / "out")
    write_tab_text(spark.createDataFrame(pairs, "k STRING, n BIGINT"), target)
    back = [tuple(row) for row in read_tab_text(spark, target, "k STRING, n BIGINT").collect()]
    assert sorted(back, key=repr) == sorted(pairs, key=repr)


CELLS = "row_key STRING, family STRING, qualifier STRING, value STRING, ts BIGINT, seq BIGINT"


@pytest.fixture
def cell_table(spark):
    table = Workspace.of(spark).table("cells")
    assert cells.create_cell_table(spark, table, ["cf"], buckets=16) is True
    return table


@pytest.mark.parametrize("expected, buckets", [(0, 16), (10**9, 100), (10**12, 100_000)])
def test_folders_follow_the_size(expected, buckets):
    assert cells.buckets_for(expected) == buckets


def test_one_cell(spark, cell_table):
    put = lambda value, ts, seq: cells.put_cells(
        spark.createDataFrame([("row1", "cf", "field", value, ts, seq)], CELLS), cell_table
    )
    put("hello-cells", 1, 0)
    assert cells.get_value(spark, cell_table, "row1", "cf", "field").first().value == b"hello-cells"
    put("second", 1, 1)
    put("late arrival of an old version", 0, 9)
    assert [tuple(row) for row in cells.text_values(cells.get_row(spark, cell_table, "row1")).collect()] == [
        ("row1", "cf", "field", "second")
    ]
    assert cells.get_row(spark, cell_table, "row2").count() == 0


def test_creating_a_cell_table_again_keeps_it(spark, cell_table):
    cells.put_cells(spark.createDataFrame([("r", "cf", "q", "v", 1, 0)], CELLS), cell_table)
    assert cells.create_cell_table(spark, cell_table, ["other"], buckets=3) is False
    assert cells.get_row(spark, cell_table, "r").first().value == b"v"


def test_bytes_come_back_as_they_were(spark, cell_table):
    held = bytes([0xFF, 0xFE, 0x00, 0x81])
    frame = spark.createDataFrame([("r", "cf", "q", held, 1, 0), ("r", "cf", "none", None, 1, 0)], CELLS.replace("value STRING", "value BINARY"))
    cells.put_cells(frame, cell_table)
    assert {row.qualifier: row.value for row in cells.get_row(spark, cell_table, "r").collect()} == {"q": held, "none": None}


@pytest.mark.parametrize("part", range(3))
def test_a_cell_without_its_key_fails_the_write(spark, cell_table, part):
    key = [None if place == part else "cf" for place in range(3)]
    with pytest.raises(PySparkException, match=f"a cell without {cells.CELL_KEY[part]}"):
        cells.put_cells(spark.createDataFrame([(*key, "v", 1, 0)], CELLS), cell_table)


def test_families_with_commas_and_quotes(spark):
    table = Workspace.of(spark).table("cells")
    cells.create_cell_table(spark, table, ["a,b", "it's", "c\\d"], buckets=2)
    rows = [("r", family, "q", family, 0, 0) for family in ("a,b", "it's", "c\\d")]
    cells.put_cells(spark.createDataFrame(rows, CELLS), table)
    assert {row.family for row in cells.get_row(spark, table, "r").collect()} == {"a,b", "it's", "c\\d"}
    with pytest.raises(PySparkException, match="unknown column family: a"):
        cells.put_cells(spark.createDataFrame([("r", "a", "q", "v", 0, 0)], CELLS), table)


def test_an_unknown_family_fails_the_write(spark, cell_table):
    frame = spark.createDataFrame([("r", "other", "q", "v", 1, 0)], CELLS)
    with pytest.raises(PySparkException, match="unknown column family: other"):
        cells.put_cells(frame, cell_table)


def test_a_get_opens_one_folder(spark, cell_table):
    rows = [(f"r{i}", "cf", "q", f"v{i}", 0, 0) for i in range(200)]
    cells.put_cells(spark.createDataFrame(rows, CELLS), cell_table)
    assert spark.sql(f"SHOW PARTITIONS {cell_table}").count() == 16
    got = cells.get_row(spark, cell_table, "r7")
    assert [row.value for row in got.collect()] == [b"v7"]
    assert all(cells.get_row(spark, cell_table, f"r{i}").count() == 1 for i in (0, 99, 199))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(row_bucket#\d+\), \(row_bucket#\d+ = \d+\)\]", plan)
    assert re.search(r"Location: \w*FileIndex\s*\(1 paths\)", plan)


versions = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from("xy"), st.integers(0, 3)), max_size=25
)


@few
@given(versions)
def test_latest_cells_match_plain_python(spark, writes):
    rows = [(key, "cf", qualifier, f"v{seq}", ts, seq) for seq, (key, qualifier, ts) in enumerate(writes)]
    expected = {}
    for key, family, qualifier, value, ts, seq in sorted(rows, key=lambda row: (row[4], row[5])):
        expected[key, family, qualifier] = value
    latest = cells.latest_cells(spark.createDataFrame(rows, CELLS)).collect()
    assert {(row.row_key, row.family, row.qualifier): row.value for row in latest} == expected


def test_files_of_a_table(spark, tmp_path):
    spark.range(90).selectExpr("id", "id % 3 as k").repartition(4).write.partitionBy("k").parquet(str(tmp_path / "table"))
    found = table_files(spark.read.parquet(str(tmp_path / "table"))).collect()
    assert sum(row.rows for row in found) == 90 and len(found) > 3
    assert all(row.len == os.path.getsize("/" + row.path.removeprefix("file:").lstrip("/")) for row in found)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["b\tx", "c\td\t5", "b", "", "b\t99999999999999999999"])
def test_a_bad_tab_line_fails_or_is_skipped(spark, folder, ansi, line):
    path, before = folder("tab.txt", f"a\t1\n{line}\n\t\n"), spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="not a line"):
            read_tab_text(spark, path, "k STRING, n BIGINT").collect()
        lenient = read_tab_text(spark, path, "k STRING, n BIGINT", skip_bad=True).collect()
        assert sorted(map(tuple, lenient), key=str) == [("a", 1), (None, None)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("value", ["a\tb", "a\nb", "a\rb"])
def test_a_separator_in_a_value_is_not_written(spark, tmp_path, value):
    with pytest.raises(PySparkException, match="tab or line end"):
        write_tab_text(spark.createDataFrame([(value, 1)], "k STRING, n INT"), str(tmp_path / "out"))


def test_a_null_has_no_line(spark, tmp_path):
    target = str(tmp_path / "lines")
    write_lines(spark.createDataFrame([("a",), (None,), ("",)], "value STRING"), target)
    assert sorted(row.value for row in read_lines(spark, target).collect()) == ["", "a"]


def test_totals_of_cents_do_not_depend_on_the_order(spark):
    frame = spark.range(200_000).selectExpr("1 as k", "cast(round(rand(1) * 500000, 2) as decimal(18,2)) as v")
    totals = {grouping.total_by(frame.repartition(parts), "k", "v", "t").first().t for parts in (1, 3, 7)}
    assert len(totals) == 1
