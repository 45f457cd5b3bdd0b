import pytest

from tallyworks.session import GIBIBYTE, MEBIBYTE, settings_for

SHUFFLE = "spark.sql.shuffle.partitions"
SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.mark.parametrize(
    "input_bytes, cores, partitions, split",
    [
        (0, 8, 16, 128 * MEBIBYTE),
        (10 * GIBIBYTE, 8, 40, 128 * MEBIBYTE),
        (1_000 * GIBIBYTE, 64, 4_000, 500 * MEBIBYTE),
        (102_400 * GIBIBYTE, 4_000, 409_600, 102_400 * GIBIBYTE // 128_000),
        (10**15, 4_000, -(-(10**15) // (256 * MEBIBYTE)), GIBIBYTE),
    ],
)
def test_partitions_follow_the_input(input_bytes, cores, partitions, split):
    assert settings_for(input_bytes, cores) == {SHUFFLE: str(partitions), SPLIT: str(split)}


def test_partitions_follow_what_is_shuffled():
    assert settings_for(102_400 * GIBIBYTE, 4_000, shuffle_bytes=GIBIBYTE)[SHUFFLE] == "8000"
    assert settings_for(0, 8, shuffle_bytes=100 * GIBIBYTE)[SHUFFLE] == "400"


def test_the_session_is_adaptive_and_in_utc(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.ansi.enabled") == "false"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.sql("SELECT to_upper('a') AS val").first().val == "A"
