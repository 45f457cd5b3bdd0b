"""What must hold on large and skewed tables: plan shapes, hot keys, where files go."""

import json
import os
import re
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tallyworks import storage
from tallyworks.operators import cells, grouping
from tallyworks.plans.queries import QUERIES
from tallyworks.storage import Workspace

DATA = "/root/testdata/sf0.001"
PYTHON_NODES = ("EvalPython", "InPandas", "InArrow", "ExistingRDD")
# Queries that need a table of files or splits beside the rows: a row per file with another header, and a row per split.
JOINED = ("contract_drift", "csv_records")
JOIN_NODES = ("CartesianProduct", "NestedLoopJoin", "BroadcastExchange", "MergeJoin", "HashJoin")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def executions(spark):
    """The numbers and plans of all statements that ran, those inside a query's own writes too."""
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {e.executionId(): e.physicalPlanDescription() for e in (ran.apply(i) for i in range(ran.size()))}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_jvm_and_spread(spark, name):
    before = executions(spark)
    result = registry.queries()[name](spark, DATA)
    result.write.format("noop").mode("overwrite").save()
    ran = [text for number, text in executions(spark).items() if number not in before]
    assert ran
    refused = PYTHON_NODES + (("CartesianProduct", "NestedLoopJoin") if name in JOINED else JOIN_NODES)
    for text in [*ran, plan(result)]:
        assert not any(node in text for node in refused), text
        # One task may only finish a keyless aggregate or a limit, over what each task left.
        for line, below in zip(text.splitlines(), text.splitlines()[1:]):
            if "Exchange SinglePartition" in line:
                assert "partial_" in below or "LocalLimit" in below, text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("sales_aggregation", "struct<o_totalprice:double,o_orderpriority:string>"),
        ("exposure_limit", "struct<c_acctbal:double,c_mktsegment:string>"),
        ("word_count", "struct<text:string>"),
        ("group_count", "struct<event_type:string>"),
        ("split_group_count", "struct<p_name:string>"),
        ("row_count", "struct<>"),
        ("column_as_string", "struct<o_orderkey:bigint>"),
        ("last_put_wins", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>"),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    assert f"ReadSchema: {columns}" in plan(registry.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["sales_aggregation", "word_count", "group_count", "split_group_count", "sql_rows"])
def test_groups_are_aggregated_before_the_shuffle(spark, name):
    text = plan(registry.queries()[name](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange hashpartitioning.*\n.*functions=\[partial_", text)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan(registry.queries()["total_for_key"](spark, DATA))
    before = executions(spark)
    text = plan(registry.queries()["contains_value"](spark, DATA))
    assert set(executions(spark)) == set(before)
    assert "EqualTo(p_name,red widget)" in text and "LocalLimit 1" in text


def test_versions_are_cut_before_the_shuffle(spark):
    text = plan(registry.queries()["last_put_wins"](spark, DATA))
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit.*Partial", text)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """60,000 rows of which every third has the key 'hot', spread over eight files."""
    path = str(tmp_path_factory.mktemp("skewed") / "rows")
    rows = spark.range(60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        F.col("id").cast("double").alias("v"),
        F.col("id"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def shuffled_rows(frame):
    """The rows the frame's shuffles wrote, from the metrics of a finished run."""
    frame.collect()
    written, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind == "ShuffleQueryStageExec":
            nodes.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                written += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return written


def test_a_hot_key_shuffles_one_row_per_task(spark, skewed):
    hot_and_few = skewed.select(F.when(F.col("k") == "hot", "hot").otherwise("rest").alias("k"), "v", "id")
    for frame in (
        grouping.total_by(hot_and_few, "k", "v", "total"),
        grouping.count_by(hot_and_few, "k"),
        cells.latest_by(hot_and_few, ["k"], ["v", "id"]),
    ):
        assert shuffled_rows(frame) <= 2 * skewed.rdd.getNumPartitions()


def test_a_hot_word_shuffles_one_row_per_task(spark, skewed):
    texts = skewed.select(F.concat_ws(" ", F.lit("the the"), "k", F.lit("the")).alias("value"))
    counted = grouping.count_words(texts)
    tasks, others = skewed.rdd.getNumPartitions(), 40_000
    assert shuffled_rows(counted) <= others + 2 * tasks
    assert {row.word: row.cnt for row in counted.collect() if row.cnt > 1} == {"the": 180_000, "hot": 20_000}


def test_skewed_results_are_whole(spark, skewed):
    ids = range(60_000)
    counts = {row.k: row.cnt for row in grouping.count_by(skewed, "k").collect()}
    totals = {row.k: row.total for row in grouping.total_by(skewed, "k", "v", "total").collect()}
    latest = {row.k: row.id for row in cells.latest_by(skewed, ["k"], ["id"]).collect()}
    assert len(counts) == len(totals) == len(latest) == 40_001
    assert counts["hot"] == 20_000
    assert totals["hot"] == sum(i for i in ids if i % 3 == 0)
    assert latest["hot"] == max(i for i in ids if i % 3 == 0)
    assert all(latest[f"k{i}"] == i and counts[f"k{i}"] == 1 for i in ids if i % 3)


def test_a_hot_row_is_written_by_several_tasks(spark, skewed):
    table = Workspace.of(spark).table("cells")
    cells.create_cell_table(spark, table, ["cf"], buckets=4)
    option = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(option)
    spark.conf.set(option, "64KB")
    try:
        wide = skewed.selectExpr(
            "k as row_key", "'cf' as family", "cast(id as string) as qualifier", "sha2(k || id, 256) as value",
            "id as ts", "0 as seq",
        )
        cells.put_cells(wide, table)
    finally:
        spark.conf.set(option, before)
    hot = spark.table(table).filter("row_key = 'hot'").select("_metadata.file_path").distinct()
    assert hot.count() > 1
    assert cells.get_row(spark, table, "hot").count() == 20_000
    assert cells.latest_cells(spark.table(table)).count() == 60_000


def test_files_go_to_the_shared_folder(spark):
    work = Workspace.of(spark)
    assert work.path("x").startswith(storage.shared_folder(spark) + "/")
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", storage.shared_folder(spark))
    assert work.path("x") != work.path("x")
    table = work.table("t")
    spark.sql(f"CREATE TABLE {table} (i INT) USING parquet")
    place = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Location'").first().data_type
    assert place.startswith(storage.qualified_path(spark, work.root))


class Unset:
    """A session that names no shared folder."""

    def __init__(self, spark, master):
        self.sparkContext = self
        self.conf = self
        self.master = self.applicationId = master

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return None


def test_a_cluster_must_name_the_shared_folder(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Unset(spark, "spark://host:7077"))
    local = Unset(spark, "local[4]")
    assert storage.shared_folder(local) == storage.shared_folder(local)


class OnCluster:
    """A session of a cluster that names a folder of the machines' own."""

    def __init__(self, spark, **settings):
        self.sparkContext = self
        self.conf = self
        self.master, self.applicationId = "spark://host:7077", "application"
        self._jvm, self._jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        self.settings = {"spark.checkpoint.dir": "/tmp/shared"} | settings

    def get(self, name, default):
        return self.settings.get(name, default)


def test_a_cluster_must_share_the_folder(spark):
    with pytest.raises(RuntimeError, match="do not share /tmp/shared"):
        storage.shared_folder(OnCluster(spark))
    assert storage.shared_folder(OnCluster(spark, **{"spark.tallyworks.mounted": "true"})) == "/tmp/shared"


class Sharing(OnCluster):
    """A cluster whose executors write where ``session`` does."""

    defaultParallelism = 4

    def __init__(self, session, **settings):
        super().__init__(session, **settings)
        self.range, self.read = session.range, session.read

    def getCheckpointDir(self):
        return None


def test_a_cluster_may_share_a_file_folder(spark, tmp_path):
    """It is told by what tasks write there, not by its name; the trial leaves nothing."""
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        assert storage.shared_folder(Sharing(spark, **{"spark.checkpoint.dir": folder})) == folder
    warehouse = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": f"file:{tmp_path}"}
    assert storage.shared_folder(Sharing(spark, **warehouse)) == f"file:{tmp_path}"
    assert not list(tmp_path.iterdir())


def test_files_that_only_their_writers_see_are_not_shared(spark, tmp_path):
    apart = Sharing(spark, **{"spark.checkpoint.dir": str(tmp_path)})
    apart.range = lambda start, end, step, tasks: spark.range(start, end - 1, step, tasks - 1)
    with pytest.raises(RuntimeError, match="do not share"):
        storage.shared_folder(apart)
    assert not list(tmp_path.iterdir())


def test_a_cluster_takes_the_warehouse_if_it_does_not_share_the_named_folder(spark, tmp_path):
    named = {"spark.checkpoint.dir": "/proc/apart", "spark.sql.warehouse.dir": str(tmp_path)}
    assert storage.shared_folder(Sharing(spark, **named)) == str(tmp_path)
    assert not list(tmp_path.iterdir())
    with pytest.raises(RuntimeError, match="do not share /proc/apart"):
        storage.shared_folder(Sharing(spark, **named | {"spark.sql.warehouse.dir": "/proc/apart_too"}))


def test_processes_on_one_machine_are_a_cluster(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Unset(spark, "local-cluster[2,1,1024]"))


CUSTOMERS = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
PARTS = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
LINES = "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"
ROWS = {
    "customer": (CUSTOMERS, [(key, f"n{key}", 1, 1.5, "SEG") for key in range(40, 50)]),
    "part": (PARTS, [(key, "red bolt", "b", "t", key % 2, 2.5) for key in range(4)]),
    "orders": ("o_orderkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING", [(1, 1.25, "a"), (2, 2.5, "a"), (3, 4.0, "b")]),
    "lineitem": (LINES, [(1, 1, 2.0, "A", "F", datetime(1995, 1, 1)), (1, 2, 3.0, "N", "O", datetime(1996, 1, 1))]),
    "events": ("event_id BIGINT, event_type STRING", [(1, "view"), (2, "view"), (3, "buy")]),
    "documents": ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT", [(1, "a\nb", "en", "s", 3), (2, None, "en", "s", 0)]),
}
# Queries that write files or tables on the way, with their numbers of rows.
ON_THE_WAY = {
    "cell_get": 1, "cell_table": 30, "compacted_cells": 30, "contract_check": 10, "contract_drift": 10, "csv_records": 2, "csv_parquet_roundtrip": 4,
    "exposure_contract_job": 1, "exposure_job": 1, "external_csv_header": 1, "external_csv_raw": 1, "external_csv_headerless": 4,
    "file_inventory": 2, "folder_listing": 2, "folder_tree": 8, "kept_definitions": 4, "headerless_csv_scan": 4, "key_count_job": 2,
    "line_key_count_job": 2, "managed_table_count": 1, "sales_job": 2, "point_get": 3, "sample_bootstrap": 1, "table_exists": 1,
}


@pytest.fixture(scope="module")
def few_rows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("few")
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ON_THE_WAY)
def test_queries_run_on_a_cluster_that_mounts_one_folder(spark, few_rows, tmp_path, monkeypatch, name):
    context = spark.sparkContext
    monkeypatch.setattr(context, "master", "spark://host:7077")
    monkeypatch.setattr(context, "getCheckpointDir", lambda: f"file://{tmp_path}")
    monkeypatch.setattr(Workspace, "_open", {})
    assert QUERIES[name](spark, few_rows).count() == ON_THE_WAY[name]
    work = Workspace.of(spark)
    assert storage.qualified_path(spark, work.root).startswith("file:") and storage.path_exists(spark, work.root)
    work.close()
    assert not storage.path_exists(spark, work.root)


# What executors find below /proc/self/cwd is their own, as a machine's temporary folder is.
IN_PROCESSES = """
import json, sys
from pyspark.sql import SparkSession
from tallyworks.plans.queries import QUERIES
from tallyworks.storage import Workspace
tables, warehouse, named, *names = sys.argv[1:]
conf = {"spark.sql.warehouse.dir": warehouse, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.executor.memory": "700m"}
conf |= {"spark.checkpoint.dir": named} if named else {}
spark = SparkSession.builder.master("local-cluster[2,2,1024]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
told = {}
for name in names:
    try:
        rows = QUERIES[name](spark, tables).collect()
        told[name] = [len(rows), list(rows[0]) if len(rows) == 1 else None]
    except Exception as failed:
        told[name] = [f"{type(failed).__name__}: {failed}"[:300], None]
Workspace.of(spark).close()
print(json.dumps(told))
spark.stop()
"""
# The only row of those queries that give a single number.
COUNTS = {"external_csv_header": [4], "external_csv_raw": [4, True], "managed_table_count": [10], "sample_bootstrap": [10], "table_exists": [False, True, 10]}


@pytest.fixture(scope="module", params=["", "/proc/self/cwd/named"], ids=["none named", "the named one apart"])
def in_processes(few_rows, tmp_path_factory, request):
    """What the queries give on executors that are processes and share the warehouse alone."""
    root = tmp_path_factory.mktemp("processes")
    for folder in ("conf", "home/work", "cwd", "local", "warehouse"):
        (root / folder).mkdir(parents=True)
    for part in Path(pyspark.__file__).parent.iterdir():
        if part.name != "work":
            (root / "home" / part.name).symlink_to(part)
    env = {
        "SPARK_CONF_DIR": f"{root}/conf", "SPARK_HOME": f"{root}/home", "SPARK_LOCAL_DIRS": f"{root}/local", "SPARK_SCALA_VERSION": "2.13",
        "TMPDIR": "/proc/self/cwd", "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "SPARK_LOCAL_IP": "127.0.0.1", "TZ": "UTC",
        "PYSPARK_SUBMIT_ARGS": f"--driver-memory 1g --driver-java-options -Djava.io.tmpdir={root}/local pyspark-shell",
    }
    command = [sys.executable, "-c", IN_PROCESSES, few_rows, f"{root}/warehouse", request.param, *ON_THE_WAY]
    ran = subprocess.run(command, env=os.environ | env, cwd=root / "cwd", capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert not list((root / "warehouse").iterdir())
    return json.loads(ran.stdout.splitlines()[-1])


@pytest.mark.parametrize("name", ON_THE_WAY)
def test_queries_run_in_processes_that_share_the_warehouse(in_processes, name):
    rows, only = in_processes[name]
    assert rows == ON_THE_WAY[name]
    assert only == COUNTS.get(name, only)


def test_closing_a_workspace_removes_what_it_wrote(spark):
    work, shared = Workspace(spark), Workspace.of(spark)
    path, table = work.path("x"), work.table("t")
    spark.range(3).write.parquet(path)
    spark.sql(f"CREATE TABLE {table} (i INT) USING parquet")
    assert storage.path_exists(spark, work.root)
    work.close()
    assert not storage.path_exists(spark, work.root)
    assert not spark.catalog.databaseExists(work.name)
    assert Workspace.of(spark) is shared
