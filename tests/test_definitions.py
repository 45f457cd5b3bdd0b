"""Definitions that outlive their application, compaction, and filters of keys."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tallyworks.operators import cells, definitions
from tallyworks.storage import Workspace

ROOT = str(Path(__file__).resolve().parents[1])

SECOND = """
import sys
sys.path.insert(0, {root!r})
from tallyworks.operators import definitions
from tallyworks.session import build_session
spark = build_session("second", "local[2]", {{"spark.sql.warehouse.dir": {warehouse!r}, "spark.ui.enabled": "false"}})
print(definitions.replay(spark, {kept!r}), definitions.replay(spark, {kept!r}))
print(sorted(map(tuple, spark.sql("SELECT name, kept_db.doubled(n) AS d, day FROM kept_db.amounts").collect())))
spark.sql("DROP TABLE kept_db.amounts")
"""


def test_a_second_application_reads_the_first_ones_table(spark, tmp_path):
    kept, place = str(tmp_path / "shared"), str(tmp_path / "shared" / "db")
    spark.sql(f"CREATE DATABASE kept_db LOCATION '{place}'")
    spark.sql("CREATE TABLE kept_db.amounts (name STRING, n INT, day STRING) USING parquet OPTIONS ('compression' 'gzip') PARTITIONED BY (day) TBLPROPERTIES ('of' = 'it''s')")
    try:
        definitions.keep_table(spark, kept, "kept_db.amounts")
        definitions.keep_function(spark, kept, "kept_db.doubled", "n INT", "INT", "n + n + n")
        definitions.keep_function(spark, kept, "kept_db.doubled", "n INT", "INT", "2 * n")
        # Rows, and a partition, that come after the definition was kept.
        spark.sql("INSERT INTO kept_db.amounts VALUES ('a', 1, 'mon'), ('b', NULL, 'tue')")
        before = sorted(str(path) for path in tmp_path.rglob("*.parquet"))
        code = SECOND.format(root=ROOT, warehouse=str(tmp_path / "other"), kept=kept)
        told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        assert told.returncode == 0, told.stderr
        names, found = told.stdout.strip().splitlines()[-2:]
        assert names == "['kept_db.amounts', 'kept_db.doubled'] ['kept_db.amounts', 'kept_db.doubled']"
        assert found == "[('a', 2, 'mon'), ('b', None, 'tue')]"
        # The second application dropped its table; the files are the first one's.
        assert sorted(str(path) for path in tmp_path.rglob("*.parquet")) == before and spark.table("kept_db.amounts").count() == 2
    finally:
        spark.sql("DROP DATABASE kept_db CASCADE")


def test_nothing_kept_is_nothing_replayed(spark, tmp_path):
    assert definitions.replay(spark, str(tmp_path)) == [] and definitions.kept(spark, str(tmp_path)).collect() == []


def scanned(frame):
    """The result, and the rows that its scan read from row groups."""
    result, read, nodes = frame.collect(), 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif kind == "FileSourceScanExec":
            read += node.metrics().apply("numOutputRows").value()
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return result, read


def put(spark, table, rows):
    cells.put_cells(spark.createDataFrame(rows, "row_key string, family string, qualifier string, value string, ts long, seq long"), table)


def test_an_absent_key_reads_no_row_group(spark):
    table = Workspace.of(spark).table("cells")
    cells.create_cell_table(spark, table, ["cf"], buckets=4)
    some = spark.range(20_000).selectExpr("concat('k', 2 * id) as row_key", "'cf' as family", "'q' as qualifier", "cast(id as string) as value", "1 as ts", "0 as seq")
    cells.put_cells(some, table)
    least, most = spark.table(table).agg(F.min("row_key"), F.max("row_key")).first()
    absent = [f"k{2 * number + 1}" for number in range(100, 4000, 97)]
    assert all(least < key < most for key in absent)
    reads = [scanned(cells.get_row(spark, table, key)) for key in absent]
    # A filter may take a key for one it has; it does so for one in a hundred.
    assert all(result == [] for result, _ in reads) and sum(read > 0 for _, read in reads) <= 2
    result, read = scanned(cells.get_row(spark, table, "k400"))
    assert [bytes(row.value) for row in result] == [b"200"] and read > 0


def test_compaction_keeps_what_reads_give(spark):
    table = Workspace.of(spark).table("cells")
    cells.create_cell_table(spark, table, ["cf"], buckets=8)
    put(spark, table, [(f"r{number}", "cf", "q", f"v{number}", 1, 0) for number in range(400)])
    put(spark, table, [("r7", "cf", "q", "new", 2, 0), ("r7", "cf", "q", "newer", 2, 1), ("r9", "cf", "q", None, 5, 0)])
    read = lambda: sorted(map(tuple, cells.text_values(cells.latest_cells(spark.table(table))).collect()))
    files = lambda: {row.path: row.at for row in spark.table(table).selectExpr("_metadata.file_path as path", "_metadata.file_modification_time as at").distinct().collect()}
    before, held = read(), files()
    touched = {row.row_bucket for row in spark.table(table).filter("row_key in ('r7', 'r9')").select("row_bucket").distinct().collect()}
    assert cells.compact_cells(spark, table) == len(touched)
    left = files()
    assert read() == before and spark.table(table).count() == 400
    others = {path: at for path, at in held.items() if not any(f"row_bucket={bucket}/" in path for bucket in touched)}
    assert others and all(left[path] == at for path, at in others.items())
    assert not any(path in left for path in held if path not in others)
    assert cells.compact_cells(spark, table) == 0 and files() == left
    put(spark, table, [("r7", "cf", "q", "again", 3, 0)])
    assert cells.text_values(cells.get_value(spark, table, "r7", "cf", "q")).first().value == "again"


def test_an_empty_table_needs_no_compaction(spark):
    table = Workspace.of(spark).table("cells")
    cells.create_cell_table(spark, table, ["cf"], buckets=4)
    assert cells.compact_cells(spark, table) == 0
