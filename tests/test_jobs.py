"""The jobs from input files to output files, on hand-written rows."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException

from tallyworks.operators import grouping
from tallyworks.plans import jobs
from tallyworks.plans.contract import read_contract
from tallyworks.sources import read_csv, read_lines, read_tab_text

SALES = "country,amount\nFR,100\nFR,40\nDE,50\n"
POSITIONS = "trade_id,desk,notional,currency\nT1,EQUITIES,100.0,EUR\nT2,EQUITIES,20.0,EUR\nT3,CREDIT,50.0,USD\n"


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def exposure(spark, source, tmp_path, limit=100.0, **options):
    target = str(tmp_path / "exposure")
    jobs.exposure_check(spark, source, target, limit, **options)
    return rows(read_csv(spark, target, jobs.EXPOSURE))


def test_sales_totals(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    jobs.sales_totals(spark, folder("sales.csv", SALES), target)
    assert rows(read_csv(spark, target, jobs.SALES_TOTALS)) == [("DE", 50.0), ("FR", 140.0)]


def test_sales_totals_replace_an_earlier_run(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    jobs.sales_totals(spark, folder("a.csv", SALES), target)
    jobs.sales_totals(spark, folder("b.csv", "country,amount\nIT,1\n"), target)
    assert rows(read_csv(spark, target, jobs.SALES_TOTALS)) == [("IT", 1.0)]


def test_sales_without_rows(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    jobs.sales_totals(spark, folder("sales.csv", "country,amount\n"), target)
    assert rows(read_csv(spark, target, jobs.SALES_TOTALS)) == []


def test_exposure(spark, folder, tmp_path):
    assert exposure(spark, folder("positions.csv", POSITIONS), tmp_path) == [
        ("CREDIT", 50.0, False),
        ("EQUITIES", 120.0, True),
    ]


def test_a_total_at_the_limit_is_no_breach(spark, folder, tmp_path):
    source = folder("positions.csv", POSITIONS + "T4,RATES,60,EUR\nT5,RATES,40,EUR\n")
    assert ("RATES", 100.0, False) in exposure(spark, source, tmp_path)


def test_unreadable_amounts_and_missing_desks(spark, folder, tmp_path):
    source = folder("positions.csv", POSITIONS + "T4,RATES,abc,USD\nT5,,5,USD\n")
    assert exposure(spark, source, tmp_path) == [
        (None, 5.0, False),
        ("CREDIT", 50.0, False),
        ("EQUITIES", 120.0, True),
        ("RATES", None, None),
    ]


def test_word_count(spark, folder, tmp_path):
    source, target = folder("in/data.txt", "hello hello world"), str(tmp_path / "out")
    assert jobs.word_count(spark, source, target) is True
    assert sorted(rows(read_lines(spark, target))) == [("hello\t2",), ("world\t1",)]
    assert rows(read_tab_text(spark, target, jobs.WORD_COUNTS)) == [("hello", 2), ("world", 1)]


def test_word_count_reads_a_folder_and_keeps_the_order(spark, folder, tmp_path):
    folder("in/a.txt", "pear apple\n\n fig")
    folder("in/b.txt", "fig\tapple  apple\n")
    target = str(tmp_path / "out")
    jobs.word_count(spark, str(tmp_path / "in"), target)
    assert rows(read_tab_text(spark, target, jobs.WORD_COUNTS)) == [("apple", 3), ("fig", 2), ("pear", 1)]


def test_word_count_refuses_an_existing_target(spark, folder, tmp_path):
    source, target = folder("in/data.txt", "a"), str(tmp_path / "out")
    jobs.word_count(spark, source, target)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        jobs.word_count(spark, source, target)


def test_quotes_in_words_survive_the_text_sink(spark, folder, tmp_path):
    source, target = folder("in/data.txt", 'a"b "c" \\ "'), str(tmp_path / "out")
    jobs.word_count(spark, source, target)
    assert sorted(rows(read_tab_text(spark, target, jobs.WORD_COUNTS))) == [('"', 1), ('"c"', 1), ("\\", 1), ('a"b', 1)]


def test_key_count(spark, folder, tmp_path):
    source, target = folder("data.csv", "A,10\nA,20\nB,5\nA,7\nB,3\n"), str(tmp_path / "out")
    jobs.key_count(spark, source, target)
    assert sorted(rows(read_lines(spark, target))) == [("A\t3",), ("B\t2",)]


def test_key_count_of_missing_keys_is_zero(spark, folder, tmp_path):
    source, target = folder("data.csv", "A,10\n,20\n,30\n"), str(tmp_path / "out")
    jobs.key_count(spark, source, target)
    assert sorted(rows(read_lines(spark, target))) == [("\t0",), ("A\t1",)]
    assert sorted(rows(read_tab_text(spark, target, jobs.KEY_COUNTS)), key=str) == [("A", 1), (None, 0)]


def test_line_key_count(spark, folder, tmp_path):
    source, target = folder("data.csv", "A,10\nA,20,9\nB\nA,7\nB,3\n"), str(tmp_path / "out")
    jobs.line_key_count(spark, source, target)
    assert sorted(rows(read_tab_text(spark, target, jobs.KEY_COUNTS))) == [("A", 3), ("B", 2)]


def test_csv_to_parquet_keeps_rows_as_strings(spark, folder, tmp_path):
    source = folder("sales.csv", SALES)
    copied = jobs.csv_to_parquet(spark, source, str(tmp_path / "parquet"))
    assert copied.dtypes == [("country", "string"), ("amount", "string")]
    assert sorted(rows(copied)) == sorted(rows(read_csv(spark, source))) == [("DE", "50"), ("FR", "100"), ("FR", "40")]


SWAPPED = "desk,trade_id,notional,currency\nEQUITIES,T1,100.0,EUR\n"


def test_a_swapped_header_passes_without_a_contract(spark, folder, tmp_path):
    assert exposure(spark, folder("positions.csv", SWAPPED), tmp_path) == [("T1", 100.0, False)]


def test_a_swapped_header_breaks_the_contract(spark, folder, tmp_path):
    with pytest.raises(Py4JJavaError, match="CSV header does not conform"):
        exposure(spark, folder("positions.csv", SWAPPED), tmp_path, under_contract=True)


def test_a_renamed_column_no_query_uses_breaks_the_contract(spark, folder):
    source = folder("positions.csv", POSITIONS.replace("currency", "ccy"))
    frame = read_contract(spark, source, jobs.POSITIONS)
    with pytest.raises(Py4JJavaError, match="CSV header does not conform"):
        frame.select("desk").collect()
    with pytest.raises(Py4JJavaError, match="CSV header does not conform"):
        grouping.count_rows(frame).collect()


@pytest.mark.parametrize("extra", ["desk,trade_id", "trade_id,desk,notional,currency,book"])
def test_missing_or_added_columns_break_the_contract(spark, folder, extra):
    source = folder("positions.csv", f"{extra}\n" + ",".join("1" for _ in extra.split(",")) + "\n")
    with pytest.raises(Py4JJavaError, match="CSV header"):
        read_contract(spark, source, jobs.POSITIONS).collect()


def test_one_drifted_file_of_many_breaks_the_contract(spark, folder, tmp_path):
    folder("in/a.csv", POSITIONS)
    folder("in/b.csv", SWAPPED)
    with pytest.raises(Py4JJavaError, match="CSV header does not conform"):
        exposure(spark, str(tmp_path / "in"), tmp_path, under_contract=True)


@pytest.mark.parametrize("sensitive", ["true", "false"])
def test_a_header_in_other_case_breaks_the_contract(spark, folder, tmp_path, sensitive):
    folder("in/a.csv", POSITIONS)
    folder("in/b.csv", POSITIONS.replace("trade_id,desk", "TRADE_ID,Desk"))
    spark.conf.set("spark.sql.caseSensitive", sensitive)
    try:
        with pytest.raises(Py4JJavaError, match="CSV header does not conform"):
            exposure(spark, str(tmp_path / "in"), tmp_path, under_contract=True)
        assert spark.conf.get("spark.sql.caseSensitive") == sensitive
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_a_file_without_header_breaks_the_contract(spark, folder, tmp_path):
    folder("in/a.csv", POSITIONS)
    folder("in/b.csv", "")
    with pytest.raises(ValueError, match="1 of 2 files under contract have no header"):
        read_contract(spark, str(tmp_path / "in"), jobs.POSITIONS)


def test_a_bad_value_breaks_the_contract_in_any_column(spark, folder, tmp_path):
    source = folder("trades.csv", "desk,notional,lots\nRATES,1.0,7\nRATES,2.0,many\n")
    schema = "desk STRING, notional DOUBLE, lots INT"
    assert len(read_contract(spark, source, schema).select("desk").collect()) == 2
    with pytest.raises(Py4JJavaError, match="MALFORMED_RECORD"):
        read_contract(spark, source, schema, strict_values=True).select("desk").collect()
    with pytest.raises(Py4JJavaError, match="MALFORMED_RECORD"):
        grouping.count_rows(read_contract(spark, source, schema, strict_values=True)).collect()


def test_the_contract_holds_for_good_files(spark, folder, tmp_path):
    assert exposure(spark, folder("positions.csv", POSITIONS), tmp_path, under_contract=True) == [
        ("CREDIT", 50.0, False),
        ("EQUITIES", 120.0, True),
    ]


def test_two_contracts_in_one_query(spark, folder):
    one = read_contract(spark, folder("a.csv", POSITIONS), jobs.POSITIONS, strict_values=True)
    two = read_contract(spark, folder("b.csv", POSITIONS), jobs.POSITIONS, strict_values=True)
    assert one.unionByName(two).count() == one.unionByName(one).count() == 6
