"""Reading a provider's files under a contract on their columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

DRIFT = "STRUCT<file: STRING, line: STRING, reason: STRING>"


def read_contract(spark: SparkSession, path: str, schema: str, strict_values: bool = False) -> DataFrame:
    """Headed CSV whose header must name the schema's columns in their order, letter case included.

    A file with another header fails the read, whichever columns the query uses: column
    pruning inside the CSV parser is off, as it would skip the check for pruned columns. A file
    without any byte, and so without a header, is refused at once; no content is read for that.
    With ``strict_values`` a value that does not parse fails the read too; the counts
    observed on the way keep every column in the scan, so that none goes unchecked.

    The frame belongs to a session of its own, with the caller's settings but for case-sensitive names, by
    which the CSV source compares headers. The caller's session stays as it is.
    """
    own = _case_sensitive(spark)
    _refuse_empty_files(own, path)
    reader = (
        own.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
    )
    if not strict_values:
        return reader.csv(path)
    frame = reader.option("mode", "FAILFAST").csv(path)
    return frame.observe(f"contract_{uuid.uuid4().hex[:12]}", *[F.count(name).alias(name) for name in frame.columns])


def _case_sensitive(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.caseSensitive", "true")
    return own


def _refuse_empty_files(spark: SparkSession, path: str) -> None:
    """A scan passes over files without a byte; the list of its files does not."""
    files = spark.read.format("binaryFile").load(path).select("path")
    # The names stay in the JVM; only their number is asked for.
    listed, scanned = len(files._jdf.inputFiles()), files.count()
    if scanned < listed:
        raise ValueError(f"{listed - scanned} of {listed} files under contract have no header, being empty: {path}")


def contract_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line of headed CSV under a contract: the schema's columns, and ``drift``, which is null for a good row.

    For any other line the columns are null and ``drift`` holds its ``file``, the ``line`` itself and a ``reason``: another number of fields, or the
    first column whose value does not parse. A file whose header does not name the columns in their order, letter case included, has no good
    rows: its header and all its lines drift. The read does not fail, but for a file without a byte. Blank lines are passed over, and values hold no line ends.
    Rows are split in one scan, which checks every column; another one finds the first line of every file, a row per file and task.
    """
    _refuse_empty_files(spark, path)
    fields = StructType.fromDDL(schema).fields
    names = [_quoted(field.name) for field in fields]
    texts = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    numbered = texts.withColumn("at", F.monotonically_increasing_id())
    heads = numbered.filter("split = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("at"))
    wrong = heads.filter(~_names(F.col("head"), [field.name for field in fields])).select("file", "head")

    held = StructType([*fields]).add("_line", StringType())
    options = {"header": True, "columnNameOfCorruptRecord": "_line", "columnPruning": False}
    scan = spark.read.schema(held).options(**options).csv(path)
    rows = scan.select(*names, "_line", F.col("_metadata.file_path").alias("file")).join(wrong.select("file"), "file", "left_anti")
    good = F.col("_line").isNull()
    reason = F.when(~good, _reason(F.col("_line"), fields))
    # A scan checks the columns that are used. This uses all of them, whatever is selected later; the length of a line is never below zero.
    faulty = F.length("_line") >= 0
    for name in names:
        faulty = faulty | F.col(name).isNull()
    faulty = ~good & faulty
    drift = F.when(faulty, F.struct("file", F.col("_line").alias("line"), reason.alias("reason"))).cast(DRIFT).alias("drift")
    checked = rows.select(*[F.when(~faulty, F.col(name)).alias(field.name) for name, field in zip(names, fields)], drift)

    lines = texts.filter("trim(value) <> ''").join(wrong, "file")
    told = F.when(F.col("value") == F.col("head"), F.lit("another header")).otherwise(F.lit("under another header"))
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in fields]
    drifted = lines.select(*nothing, F.struct("file", F.col("value").alias("line"), told.alias("reason")).cast(DRIFT).alias("drift"))
    return checked.unionByName(drifted)


def split_contract(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of ``contract_rows``, and what drifted: ``file, line, reason``."""
    rows = contract_rows(spark, path, schema)
    return rows.filter("drift is null").drop("drift"), rows.filter("drift is not null").select("drift.*")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _strings(line: Column, count: int) -> Column:
    """The fields of a line as texts."""
    return F.from_csv(line, ", ".join(f"f{at} STRING" for at in range(count)), {"mode": "PERMISSIVE"})


def _field_count(line: Column) -> Column:
    """The number of fields: one more than there are commas outside of quotes."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _names(head: Column, names: list[str]) -> Column:
    """Whether a header line has these names, in this order, and no others."""
    held = _strings(head, len(names))
    found = _field_count(head) == len(names)
    for at, name in enumerate(names):
        found = found & held[f"f{at}"].eqNullSafe(F.lit(name))
    return found


def _reason(line: Column, fields: list) -> Column:
    count, held = _field_count(line), _strings(line, len(fields))
    found = F.when(count != len(fields), F.concat(count.cast("string"), F.lit(f" fields instead of {len(fields)}")))
    for at, field in enumerate(fields):
        value = held[f"f{at}"]
        if not isinstance(field.dataType, StringType):
            kind = field.dataType.simpleString().upper()
            found = found.when(value.isNotNull() & value.try_cast(field.dataType).isNull(), F.lit(f"{field.name} is no {kind}"))
    return found.otherwise(F.lit("a value does not parse"))
