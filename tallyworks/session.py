"""Building a session with the settings the jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyworks.functions.strings import register_to_upper

# ANSI mode is off: SQL written for Spark 3 expects null where a cast has no value.
DEFAULTS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


MEBIBYTE = 1024**2
GIBIBYTE = 1024**3


def settings_for(input_bytes: int, cores: int, shuffle_bytes: int | None = None) -> dict[str, str]:
    """Partition settings for an input of a given size on a number of cores.

    A scan task reads what makes 32 tasks per core, but 128 MiB at least and 1 GiB at
    most. A shuffle starts with a partition per 256 MiB of what the job is expected to shuffle,
    and two per core at least; adaptive execution then joins the small ones. Unless
    ``shuffle_bytes`` says otherwise, that is the whole input, as for work that does not aggregate first.
    """
    split = min(max(input_bytes // (32 * cores), 128 * MEBIBYTE), GIBIBYTE)
    expected = input_bytes if shuffle_bytes is None else shuffle_bytes
    partitions = max(-(-expected // (256 * MEBIBYTE)), 2 * cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def build_session(
    app_name: str = "tallyworks", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """Get or create a session and register the SQL functions the jobs use.

    The master is left to spark-submit unless it is given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in (DEFAULTS | (settings or {})).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    register_to_upper(spark)
    return spark
