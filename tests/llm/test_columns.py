"""Columns that operators pass through: names in other letter case, with dots and with backticks."""

import pytest

from tallyworks.llm import line_dedup, mixing, quality_rules, sharding


@pytest.fixture
def named(spark):
    rows = [(1, "a line of words to count\nanother", "a", "x", "y", "z"), (2, None, None, "x", "y", "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, Clean_Text string, `a.b` string, `c``d` string")


@pytest.mark.parametrize("operator", [quality_rules.quality_rules, line_dedup.line_dedup])
def test_line_operators_replace_names_in_any_case(named, operator, tmp_path):
    operator(named).write.parquet(str(tmp_path / "out"))
    found = {row.doc_id: row.asDict() for row in named.sparkSession.read.parquet(str(tmp_path / "out")).collect()}
    assert found[1]["clean_text"] == "a line of words to count\nanother" and found[2]["clean_text"] is None
    assert all(row["a.b"] == "y" and row["c`d"] == "z" and "Clean_Text" not in row for row in found.values())


def test_shards_and_streams_pass_odd_names_through(named):
    sharded = sharding.shuffle_into_shards(named.withColumnRenamed("Clean_Text", "Shard"), shards=2).collect()
    assert sorted((row.shard, row.slot) for row in sharded) == [(0, 0), (1, 0)]
    streamed = mixing.stream(named.withColumnRenamed("Clean_Text", "Position")).collect()
    assert all(row["a.b"] == "y" and row["c`d"] == "z" for row in [*sharded, *streamed])
    assert all(0 <= row.position <= 1 for row in streamed)
