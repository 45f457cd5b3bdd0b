"""Catalog tables, SQL functions and ad-hoc SQL."""

import pytest

from tallyworks.functions.strings import register_to_upper, store_to_upper
from tallyworks.operators import tables
from tallyworks.plans import adhoc, jobs
from tallyworks.sinks import write_csv
from tallyworks.storage import Workspace


@pytest.fixture
def work(spark):
    return Workspace.of(spark)


@pytest.fixture
def three_rows(spark):
    return spark.sql("SELECT stack(3, 1, 'x', 2, 'y', 3, 'z') AS (i, s)")


def test_managed_table_and_its_parquet_copy(spark, work, tmp_path):
    table = work.table("test_table")
    assert tables.ensure_table(spark, table, "i INT, s STRING") is True
    spark.sql(f"INSERT INTO {table} VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    copied = jobs.table_to_parquet(spark, table, str(tmp_path / "copy"))
    assert spark.table(table).count() == copied.count() == 3
    assert sorted(map(tuple, copied.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_table_is_created_once(spark, work):
    table = work.table("once")
    assert tables.ensure_table(spark, table, "i INT") is True
    spark.sql(f"INSERT INTO {table} VALUES (1)")
    assert tables.ensure_table(spark, table, "i INT") is False
    assert spark.table(table).count() == 1
    tables.drop_table(spark, table)
    tables.drop_table(spark, table)
    assert not spark.catalog.tableExists(table)


def test_header_lines_are_rows_of_a_table_without_header(spark, work, three_rows, tmp_path):
    location, table = str(tmp_path / "csv"), work.table("ext_csv")
    write_csv(three_rows.coalesce(1), location)
    tables.create_csv_table(spark, table, "i INT, s STRING", location)
    assert spark.table(table).count() == 4
    assert sorted(map(tuple, spark.table(table).collect()), key=str) == [(1, "x"), (2, "y"), (3, "z"), (None, "s")]


def test_one_header_line_per_file(spark, work, tmp_path):
    location, table = str(tmp_path / "csv"), work.table("ext_csv")
    write_csv(spark.range(40).repartition(5), location)
    tables.create_csv_table(spark, table, "id BIGINT", location)
    assert spark.table(table).count() == 45


@pytest.mark.parametrize("header", [True, False])
def test_csv_table_matching_its_files(spark, work, three_rows, tmp_path, header):
    location, table = str(tmp_path / "csv"), work.table("ext_csv")
    write_csv(three_rows, location, header=header)
    tables.create_csv_table(spark, table, "i INT, s STRING", location, header=header)
    assert spark.table(table).count() == 3


def test_dropping_an_external_table_keeps_its_files(spark, work, three_rows, tmp_path):
    location, table = str(tmp_path / "csv"), work.table("ext_csv")
    write_csv(three_rows, location)
    tables.create_csv_table(spark, table, "i INT, s STRING", location, header=True)
    tables.drop_table(spark, table)
    assert spark.read.option("header", True).csv(location).count() == 3


def test_sample_people_are_appended_by_every_call(spark, work):
    table = work.table("people")
    assert tables.load_people(spark, table).first().rowcount == 3
    assert tables.load_people(spark, table).first().rowcount == 6
    assert {tuple(row) for row in spark.table(table).collect()} == {(1, "Alice"), (2, "Bob"), (3, "Charlie")}


def test_loading_people_leaves_the_current_database(spark, work):
    before = spark.catalog.currentDatabase()
    tables.load_people(spark, work.table("people"))
    assert spark.catalog.currentDatabase() == before


def test_to_upper(spark):
    register_to_upper(spark)
    assert spark.sql("SELECT to_upper('france') AS val").first().val == "FRANCE"
    assert spark.sql("SELECT to_upper(CAST(NULL AS STRING)) AS val").first().val is None


def test_stored_to_upper(spark, work):
    function = store_to_upper(spark, work.table("any").split(".")[0])
    store_to_upper(spark, function.split(".")[0])
    assert spark.newSession().sql(f"SELECT {function}('france') AS val").first().val == "FRANCE"


def test_preview(spark):
    register_to_upper(spark)
    shown = adhoc.preview(spark, "SELECT to_upper('france') AS val, 1 AS ok")
    assert (shown.columns, shown.count, shown.data) == (["val", "ok"], 1, [["FRANCE", 1]])


def test_a_preview_is_capped_and_the_result_is_not(spark):
    assert adhoc.preview(spark, "SELECT id FROM range(250)").count == 100
    assert adhoc.run_sql(spark, "SELECT id FROM range(250)").count() == 250


@pytest.mark.parametrize("sql", ["", "  \n", None])
def test_blank_sql_is_refused(spark, sql):
    with pytest.raises(ValueError):
        adhoc.run_sql(spark, sql)


def test_sql_over_given_frames(spark, three_rows):
    result = adhoc.run_sql(spark, "SELECT s FROM {letters} WHERE i > 1 ORDER BY i", letters=three_rows)
    assert [list(row) for row in result.collect()] == [["y"], ["z"]]


def test_a_cast_without_value_is_null(spark):
    assert adhoc.preview(spark, "SELECT CAST('abc' AS INT) AS n, element_at(array(1), 2) AS e").data == [[None, None]]
