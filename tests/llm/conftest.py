import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture
def documents(spark):
    """Documents from rows ``(doc_id, text, source)``, with columns whose names clash with those the operators make."""
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            StructField("source", StringType()),
            StructField("size", StringType()),
            StructField("component_id", StringType()),
            StructField("position", StringType()),
            StructField("shard", StringType()),
            StructField("kept", StringType()),
            StructField("clean_text", StringType()),
            StructField("sequence_id", StringType()),
        ]
    )

    def make(rows):
        held = [(*row, *["x"] * 7) for row in rows]
        return spark.createDataFrame(held, schema).repartition(3)

    return make


# Rows every operator on documents must bear: nulls, empty and odd texts, repeated rows, ties, one very long text.
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\n\x0b ", None),
    (4, "one two three four five six", "a"),
    (4, "one two three four five six", "a"),
    (None, "one two three four five six", "b"),
    (5, "ONE two  three\nfour five six", None),
    (6, "word " * 60_000, "c"),
    (7, "é　漢字  x <|end|> \\l| \\", "c"),
    (8, "x" * 200_000, "c"),
]


@pytest.fixture
def odd_rows():
    return ODD


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def nothing(documents):
    return documents([])


@pytest.fixture
def eager_to_split(spark):
    """A session that splits the partitions of even small joins, and broadcasts nothing."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
