"""The registered queries: every operator run over the given tables, with its SQL.

A query takes ``(spark, sf_dir)`` and returns a DataFrame. Those that exercise a sink,
a file source or a catalog table first write a whole table to the run's workspace.
The SQL beside each query is what DuckDB runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyworks.functions.strings import register_to_upper, split_pair, store_to_upper
from tallyworks.operators import cells, definitions, fingerprint, grouping, selection, tables
from tallyworks.plans import adhoc, contract, jobs
from tallyworks.sinks import write_csv, write_lines, write_records, write_tab_text
from tallyworks.sources import list_tree, read_csv, read_lines, read_records, read_tab_text, table_files
from tallyworks.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The exposure at which a market segment is flagged; a fixed parameter of the queries.
EXPOSURE_LIMIT = 1_350_000.0

CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
PART = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL it must agree with."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Grouped totals and counts. Amounts are summed as decimals, so that a total does not depend on the order of its rows.


def cents(frame: DataFrame, amount: str) -> DataFrame:
    return frame.withColumn(amount, F.col(amount).cast("decimal(18,2)"))


@query(
    """select o_orderpriority, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total_amount
       from orders group by o_orderpriority"""
)
def sales_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = cents(load(spark, sf_dir, "orders"), "o_totalprice")
    totals = grouping.total_by(orders, "o_orderpriority", "o_totalprice", "total")
    return totals.select("o_orderpriority", F.col("total").cast("double").alias("total_amount")).orderBy("o_orderpriority")


@query(
    f"""select c_mktsegment, total_notional, total_notional > {EXPOSURE_LIMIT} as limit_breached
        from (select c_mktsegment, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as total_notional
              from customer group by c_mktsegment)"""
)
def exposure_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = cents(load(spark, sf_dir, "customer"), "c_acctbal")
    totals = grouping.total_by(customers, "c_mktsegment", "c_acctbal", "total")
    amounts = totals.select("c_mktsegment", F.col("total").cast("double").alias("total_notional"))
    return grouping.flag_above(amounts, "total_notional", EXPOSURE_LIMIT).orderBy("c_mktsegment")


@query(
    r"""select word, count(*) as cnt
        from (select unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) as word from documents)
        where word <> '' group by word"""
)
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.count_words(load(spark, sf_dir, "documents"), "text").orderBy("word")


@query("select event_type, count(event_type) as cnt from events group by event_type")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.count_by(load(spark, sf_dir, "events"), "event_type")


@query("select split_part(p_name, ' ', 1) as k, count(*) as cnt from part group by 1")
def split_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, rest = split_pair("p_name", " ")
    return grouping.count_by(load(spark, sf_dir, "part").select(key.alias("k"), rest.alias("v")), "k")


@query("select count(*) as c from lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.count_rows(load(spark, sf_dir, "lineitem"))


# Jobs from files to files


def exact_sum_sql(key: str, value: str, table: str) -> str:
    """SQL for ``key, total``: doubles between 2**-7 and 2**40 in size added as whole numbers of units, and rounded once, ties to even."""
    return f"""
        (with units as (select {key} as key, sum(cast({value} * pow(2.0, 60) as hugeint)) as held from {table} group by 1),
              sized as (select key, held, abs(held) as size, greatest(0, cast(floor(log2(greatest(cast(abs(held) as double), 1.0))) as integer) - 60) as cut from units),
              cut_off as (select key, held, cut, (size >> cut) | (case when ((size >> cut) << cut) <> size then 1 else 0 end) as kept from sized)
         select key, (case when held < 0 then -1 else 1 end) * cast(cast(kept as bigint) as double) * pow(2.0, cut - 60) as total from cut_off)"""


@query(f"select key as country, total as total_amount from {exact_sum_sql('o_orderpriority', 'o_totalprice', 'orders')}")
def sales_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace.of(spark)
    source, target = work.path("sales"), work.path("sales_totals")
    write_csv(load(spark, sf_dir, "orders").selectExpr("o_orderpriority as country", "o_totalprice as amount"), source)
    jobs.sales_totals(spark, source, target)
    return read_csv(spark, target, jobs.SALES_TOTALS)


def _publish_positions(spark: SparkSession, sf_dir: str) -> str:
    source = Workspace.of(spark).path("positions")
    positions = load(spark, sf_dir, "customer").selectExpr(
        "c_name as trade_id", "c_mktsegment as desk", "c_acctbal as notional", "cast(c_nationkey as string) as currency"
    )
    write_csv(positions, source)
    return source


EXPOSURE_SQL = f"""select key as desk, total as total_notional, total > {EXPOSURE_LIMIT} as limit_breached
                   from {exact_sum_sql('c_mktsegment', 'c_acctbal', 'customer')}"""


@query(EXPOSURE_SQL)
def exposure_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _publish_positions(spark, sf_dir), Workspace.of(spark).path("exposure")
    jobs.exposure_check(spark, source, target, EXPOSURE_LIMIT)
    return read_csv(spark, target, jobs.EXPOSURE)


@query(EXPOSURE_SQL)
def exposure_contract_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _publish_positions(spark, sf_dir), Workspace.of(spark).path("exposure")
    jobs.exposure_check(spark, source, target, EXPOSURE_LIMIT, under_contract=True)
    return read_csv(spark, target, jobs.EXPOSURE)


@query("select * from customer")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Workspace.of(spark).path("customer")
    write_csv(load(spark, sf_dir, "customer"), source)
    return contract.read_contract(spark, source, CUSTOMER, strict_values=True)


CUSTOMER_HEADER = "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment"


def _lines_under(header: str, lines: DataFrame, path: str) -> None:
    """Add files whose first line is the header to a folder; lines are written as they are."""
    options = {"header": True, "sep": "\x01", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.toDF(header).write.mode("append").options(**options).csv(path)


@query(
    """with told as (
         select *, cast(c_custkey as varchar) || ',' || c_name || ',' || cast(c_nationkey as varchar) as begin, c_custkey % 10 as fault from customer),
       lines as (
         select *, case fault when 3 then begin || ',n/a,' || c_mktsegment when 5 then begin || ',' || cast(c_acctbal as varchar)
                              when 7 then begin || ',' || cast(c_acctbal as varchar) || ',' || c_mktsegment || ',more'
                              else c_name || ',' || cast(c_custkey as varchar) end as line from told)
       select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, cast(null as varchar) as line, cast(null as varchar) as reason
       from lines where fault not in (3, 5, 7, 9)
       union all
       select null, null, null, null, null, line,
              case fault when 3 then 'c_acctbal is no DOUBLE' when 5 then '4 fields instead of 5' when 7 then '6 fields instead of 5' else 'under another header' end
       from lines where fault in (3, 5, 7, 9)"""
)
def contract_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in files of lines, four in ten of which drifted in one of four ways."""
    source, customer = Workspace.of(spark).path("customer"), load(spark, sf_dir, "customer").withColumn("fault", F.expr("c_custkey % 10"))
    begin, balance = ["c_custkey", "c_name", "c_nationkey"], F.when(F.col("fault") == 3, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    segment = F.when(F.col("fault") != 5, F.col("c_mktsegment"))
    more = F.when(F.col("fault") == 7, "more")
    _lines_under(CUSTOMER_HEADER, customer.filter("fault <> 9").select(F.concat_ws(",", *begin, balance, segment, more)), source)
    _lines_under("c_name,c_custkey", customer.filter("fault = 9").select(F.concat_ws(",", "c_name", "c_custkey")), source)
    rows = contract.contract_rows(spark, source, CUSTOMER)
    told = rows.withColumn("line", F.col("drift.line")).withColumn("reason", F.col("drift.reason")).drop("drift")
    # One header for each file that has another one, of which there are as many as tasks wrote.
    return told.filter("reason is null or reason <> 'another header'")


@query(
    r"""select word, count(*) as cnt
        from (select unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) as word from conversations)
        where word <> '' group by word"""
)
def word_count_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace.of(spark)
    source, target = work.path("texts"), work.path("word_counts")
    write_lines(load(spark, sf_dir, "conversations").select("text"), source)
    jobs.word_count(spark, source, target)
    return read_tab_text(spark, target, jobs.WORD_COUNTS)


@query("select l_returnflag as k, count(*) as cnt from lineitem group by l_returnflag")
def key_count_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace.of(spark)
    source, target = work.path("key_values"), work.path("key_counts")
    write_csv(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), source, header=False)
    jobs.key_count(spark, source, target)
    return read_tab_text(spark, target, jobs.KEY_COUNTS)


@query("select l_linestatus as k, count(*) as cnt from lineitem group by l_linestatus")
def line_key_count_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace.of(spark)
    source, target = work.path("key_values"), work.path("key_counts")
    lines = load(spark, sf_dir, "lineitem").select(F.concat_ws(",", "l_linestatus", "l_linenumber", "l_quantity"))
    write_lines(lines, source)
    jobs.line_key_count(spark, source, target)
    return read_tab_text(spark, target, jobs.KEY_COUNTS)


# Sources and sinks


@query("select doc_id, text, lang, source, n_chars from documents")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV, their line ends inside quoted values, read back whole."""
    path = Workspace.of(spark).path("documents")
    write_records(load(spark, sf_dir, "documents"), path)
    return read_records(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query("select * from customer")
def typed_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Workspace.of(spark).path("customer")
    write_csv(load(spark, sf_dir, "customer"), source)
    return read_csv(spark, source, CUSTOMER)


@query("select * from part")
def headerless_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Workspace.of(spark).path("part")
    write_csv(load(spark, sf_dir, "part"), source, header=False)
    return read_csv(spark, source, PART, header=False)


@query(
    """select cast(p_partkey as varchar) as p_partkey, p_name, p_brand, p_type,
              cast(p_size as varchar) as p_size, cast(p_retailprice as varchar) as p_retailprice
       from part"""
)
def csv_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace.of(spark)
    source = work.path("part_csv")
    write_csv(load(spark, sf_dir, "part"), source)
    return jobs.csv_to_parquet(spark, source, work.path("part_parquet"))


@query(r"select unnest(regexp_split_to_array(text, '\r\n|\n|\r')) as value from documents")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Workspace.of(spark).path("texts")
    write_lines(load(spark, sf_dir, "documents").select("text"), source)
    return read_lines(spark, source)


@query("select event_type, count(event_type) as cnt from events group by event_type")
def tsv_sink_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = Workspace.of(spark).path("event_counts")
    write_tab_text(grouping.count_by(load(spark, sf_dir, "events"), "event_type"), target)
    return read_tab_text(spark, target, "event_type STRING, cnt BIGINT")


@query(
    """select 'name' as field, c_name as val from customer
       union all select 'segment', c_mktsegment from customer
       union all select 'key', cast(c_custkey as varchar) from customer"""
)
def stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(
        "stack(3, 'name', c_name, 'segment', c_mktsegment, 'key', cast(c_custkey as string)) as (field, val)"
    )


@query("select o_orderkey, 1 as ok, upper('france') as val from orders")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_to_upper(spark)
    orders = load(spark, sf_dir, "orders")
    return adhoc.run_sql(spark, "SELECT o_orderkey, 1 AS ok, to_upper('france') AS val FROM {orders}", orders=orders)


@query("select count(*) as n, count(*) - 1 as last_id from lineitem")
def range_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").count()
    return spark.range(rows).agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def _events_in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``events`` partitioned by type, with the folder each lies in."""
    root = Workspace.of(spark).path("events")
    load(spark, sf_dir, "events").write.partitionBy("event_type").parquet(root)
    return table_files(spark.read.parquet(root)).withColumn("folder", F.regexp_extract("path", "([^/]*)/[^/]*$", 1))


@query(
    """select 'event_type=' || event_type as folder, count(*) as n_rows, true as has_files, true as has_bytes
       from events group by event_type"""
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events_in_folders(spark, sf_dir)
        .groupBy("folder")
        .agg(F.sum("rows").alias("n_rows"), (F.count("*") > 0).alias("has_files"), (F.min("len") > 0).alias("has_bytes"))
    )


@query("select distinct 'event_type=' || event_type as path, true as is_dir, cast(0 as bigint) as len from events")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _events_in_folders(spark, sf_dir).select("folder").distinct()
    return folders.select(F.col("folder").alias("path"), F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("len"))


@query(
    """with lines as (
         select 'l_returnflag=' || l_returnflag || '/' as one, 'l_linestatus=' || l_linestatus || '/' as two,
                'year=' || cast(year(l_shipdate) as varchar) || '/' as three,
                strlen(cast(l_orderkey as varchar) || ' ' || cast(l_linenumber as varchar)) + 1 as len from lineitem),
       nodes as (
         select one as path, 1 as depth, true as is_dir, len from lines union all select one || two, 2, true, len from lines
         union all select one || two || three, 3, true, len from lines
         union all select one || two || three || 'part', 4, false, len from lines)
       select path, depth, is_dir, cast(sum(len) as bigint) as len, count(*) as n_rows, true as has_files, true as in_order
       from nodes group by path, depth, is_dir"""
)
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text in folders of three levels: bytes and rows of all folders, and of the files of each."""
    root = Workspace.of(spark).path("tree")
    lines = load(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "year(l_shipdate) as year", "concat(l_orderkey, ' ', l_linenumber) as value"
    )
    lines.write.partitionBy("l_returnflag", "l_linestatus", "year").text(root)
    tree = list_tree(spark, root)
    # Files have names of their own for every task that wrote some; here they are added up under one name.
    return (
        tree.withColumn("path", F.regexp_replace("path", "/part-[^/]*$", "/part"))
        .withColumn("in_order", F.col("is_dir") == F.endswith("path", F.lit("/")))
        .groupBy("path", "depth", "is_dir")
        .agg(F.sum("len").alias("len"), F.sum("rows").alias("n_rows"), (F.min("files") > 0).alias("has_files"), F.bool_and("in_order").alias("in_order"))
    )


# Tables


@query("select count(*) as c from customer")
def managed_table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Workspace.of(spark).table("customer")
    tables.ensure_table(spark, table, CUSTOMER)
    tables.insert_rows(load(spark, sf_dir, "customer"), table)
    return spark.sql(f"SELECT count(*) AS c FROM {table}")


@query("select * from customer")
def table_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace.of(spark)
    table = work.table("customer")
    tables.ensure_table(spark, table, CUSTOMER)
    tables.insert_rows(load(spark, sf_dir, "customer"), table)
    return jobs.table_to_parquet(spark, table, work.path("customer"))


def _part_csv_table(spark: SparkSession, sf_dir: str, write_header: bool, read_header: bool) -> str:
    work = Workspace.of(spark)
    location, table = work.path("part"), work.table("part")
    write_csv(load(spark, sf_dir, "part"), location, header=write_header)
    tables.create_csv_table(spark, table, PART, location, header=read_header)
    return table


@query("select count(*) as data_rows, true as one_more_row_per_file from part")
def external_csv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _part_csv_table(spark, sf_dir, write_header=True, read_header=False)
    counts = spark.table(table).agg(
        F.count("*").alias("lines"),
        F.count("p_partkey").alias("data_rows"),
        F.count_distinct("_metadata.file_path").alias("files"),
    )
    return counts.selectExpr("data_rows", "lines = data_rows + files as one_more_row_per_file")


@query("select count(*) as n from part")
def external_csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _part_csv_table(spark, sf_dir, write_header=True, read_header=True)
    return spark.sql(f"SELECT count(*) AS n FROM {table}")


@query("select * from part")
def external_csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_part_csv_table(spark, sf_dir, write_header=False, read_header=False))


@query("select false as before_create, true as after_create, count(*) as n_rows from customer")
def table_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Workspace.of(spark).table("customer")
    before = spark.catalog.tableExists(table)
    tables.ensure_table(spark, table, CUSTOMER)
    tables.insert_rows(load(spark, sf_dir, "customer"), table)
    after = spark.catalog.tableExists(table)
    return spark.table(table).agg(
        F.lit(before).alias("before_create"), F.lit(after).alias("after_create"), F.count("*").alias("n_rows")
    )


@query("select count(*) as rowcount from customer")
def sample_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Workspace.of(spark).table("people")
    people = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tables.drop_table(spark, table)
    return tables.load_people(spark, table, people)


@query("select p_partkey, upper(p_name) as val, p_size from part")
def kept_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table and a function that the catalog forgets, and that their kept definitions bring back."""
    work = Workspace.of(spark)
    root, table = work.path("kept"), work.table("part")
    spark.sql(f"CREATE TABLE {table} (p_partkey BIGINT, p_name STRING, p_size INT) USING parquet PARTITIONED BY (p_size) LOCATION '{root}/part'")
    definitions.keep_table(spark, root, table)
    function = f"{table.split('.')[0]}.shout_{table.rsplit('_', 1)[1]}"
    definitions.keep_function(spark, root, function, "s STRING", "STRING", "upper(s)")
    load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.insertInto(table)
    tables.drop_table(spark, table)
    spark.sql(f"DROP FUNCTION {function}")
    definitions.replay(spark, root)
    return spark.sql(f"SELECT p_partkey, {function}(p_name) AS val, p_size FROM {table}")


@query(
    """select count(*) as n_rows, true as same, false as same_without_one, false as same_with_one_twice, false as same_with_values_swapped
       from lineitem"""
)
def verified_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that is checked, and what the check says of it without a row, with a row twice, and with two values in each other's rows."""
    source = load(spark, sf_dir, "lineitem")
    copy = jobs.copied(source, Workspace.of(spark).path("lineitem"), verified=True)
    names = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    ends = source.agg(F.min(F.struct(*names)).alias("least"), F.max(F.struct(*names)).alias("most")).first()
    one, two = ((F.col(names[0]) == row[0]) & (F.col(names[1]) == row[1]) & (F.col(names[2]) == row[2]) for row in (ends.least, ends.most))
    swapped = F.when(one, ends.most.l_extendedprice).when(two, ends.least.l_extendedprice).otherwise(F.col("l_extendedprice"))
    frames = {
        "same": copy,
        "same_without_one": copy.filter(~one),
        "same_with_one_twice": copy.unionByName(copy.filter(one)),
        "same_with_values_swapped": copy.withColumn("l_extendedprice", swapped),
    }
    wanted = fingerprint.fingerprint(source).first()
    told = {name: fingerprint.fingerprint(frame).first() == wanted for name, frame in frames.items()}
    return copy.agg(F.count("*").alias("n_rows"), *[F.lit(same).alias(name) for name, same in told.items()])


# Functions, projections and selections


@query("select p_partkey, upper(p_name) as val from part")
def to_upper_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_to_upper(spark)
    part = load(spark, sf_dir, "part")
    return adhoc.run_sql(spark, "SELECT p_partkey, to_upper(p_name) AS val FROM {part}", part=part)


@query("select p_partkey, upper(p_type) as val from part")
def to_upper_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = Workspace.of(spark).table("functions").split(".")[0]
    function = store_to_upper(spark, database)
    part = load(spark, sf_dir, "part")
    return adhoc.run_sql(spark, f"SELECT p_partkey, {function}(p_type) AS val FROM {{part}}", part=part)


@query(
    r"""select p_partkey, split_part(p_name, ' ', 1) as head,
               case when contains(p_name, ' ') then substr(p_name, strpos(p_name, ' ') + 1) end as rest
        from part"""
)
def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, rest = split_pair("p_name", " ")
    return load(spark, sf_dir, "part").select("p_partkey", head.alias("head"), rest.alias("rest"))


@query("select cast(o_orderkey as varchar) as val from orders")
def column_as_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.column_as_text(load(spark, sf_dir, "orders"), "o_orderkey")


@query("select cast(l_orderkey as varchar) as val from lineitem")
def first_column_as_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.column_as_text(load(spark, sf_dir, "lineitem"))


@query(
    """select o_orderpriority, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total_amount
       from orders where o_orderpriority = '1-URGENT' group by o_orderpriority"""
)
def total_for_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = grouping.total_by(cents(load(spark, sf_dir, "orders"), "o_totalprice"), "o_orderpriority", "o_totalprice", "total")
    chosen = selection.rows_with(totals, "o_orderpriority", "1-URGENT")
    return chosen.select("o_orderpriority", F.col("total").cast("double").alias("total_amount"))


@query("select count(*) > 0 as found from part where p_name = 'red widget'")
def contains_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.rows_with(load(spark, sf_dir, "part"), "p_name", "red widget")
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


# Keyed cells


def _put_customers(spark: SparkSession, sf_dir: str) -> str:
    """Each customer as one row of three cells, and its segment written a second time."""
    table, customer = Workspace.of(spark).table("cells"), load(spark, sf_dir, "customer")
    cells.create_cell_table(spark, table, families=["cf"], buckets=cells.buckets_for(4 * customer.count()))
    first = customer.selectExpr(
        "c_custkey as row_key",
        "'cf' as family",
        "stack(3, 'name', c_name, 'nation', cast(c_nationkey as string), 'segment', c_mktsegment)"
        " as (qualifier, value)",
        "1 as ts",
        "0 as seq",
    )
    second = customer.selectExpr(
        "c_custkey as row_key", "'cf' as family", "'segment' as qualifier", "lower(c_mktsegment) as value", "2 as ts", "0 as seq"
    )
    cells.put_cells(first, table)
    cells.put_cells(second, table)
    return table


CUSTOMER_CELLS_SQL = """
    select cast(c_custkey as varchar) as row_key, 'cf' as family, 'name' as qualifier, c_name as value from customer
    union all select cast(c_custkey as varchar), 'cf', 'nation', cast(c_nationkey as varchar) from customer
    union all select cast(c_custkey as varchar), 'cf', 'segment', lower(c_mktsegment) from customer"""


@query(f"select * from ({CUSTOMER_CELLS_SQL}) where row_key = '42'")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.text_values(cells.get_row(spark, _put_customers(spark, sf_dir), "42"))


@query("select lower(c_mktsegment) as value from customer where c_custkey = 42")
def cell_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cells.get_value(spark, _put_customers(spark, sf_dir), "42", "cf", "segment")
    return cells.text_values(got).select("value")


@query(CUSTOMER_CELLS_SQL)
def cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.text_values(cells.latest_cells(spark.table(_put_customers(spark, sf_dir))))


@query(f"select *, count(*) over () as versions from ({CUSTOMER_CELLS_SQL})")
def compacted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads give after superseded versions were dropped, and how many versions there are then."""
    table = _put_customers(spark, sf_dir)
    cells.compact_cells(spark, table)
    left = spark.table(table).count()
    return cells.text_values(cells.latest_cells(spark.table(table))).withColumn("versions", F.lit(left).cast("bigint"))


@query(
    """select user_id, event_type, value from events
       qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"""
)
def last_put_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return cells.latest_by(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts", "event_id")


# Ad-hoc SQL


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey limit 100")
def sql_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adhoc.preview_rows(
        spark,
        "SELECT o_orderkey, o_orderstatus FROM {orders} ORDER BY o_orderkey",
        orders=load(spark, sf_dir, "orders"),
    )


@query("select l_returnflag, l_linestatus, count(*) as c from lineitem group by l_returnflag, l_linestatus")
def sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adhoc.run_sql(
        spark,
        "SELECT l_returnflag, l_linestatus, count(*) AS c FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
        lineitem=load(spark, sf_dir, "lineitem"),
    )


@query(
    """select l_orderkey as first, l_quantity as second, case when l_linenumber > 3 then l_returnflag end as third,
              l_partkey as in_struct, l_suppkey as in_array, 5 as n_values, l_linenumber > 3 as third_is_known
       from lineitem"""
)
def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of values by position, two of one name, with nulls, a struct and an array; taken apart again."""
    rows = adhoc.positional_rows(
        spark,
        """SELECT l_orderkey AS v, l_quantity AS v, if(l_linenumber > 3, l_returnflag, NULL) AS flag,
                  named_struct('part', l_partkey, 'more', array(l_suppkey, NULL)) AS held, l_linenumber > 3 AS known
           FROM {lineitem}""",
        lineitem=load(spark, sf_dir, "lineitem"),
    )
    return rows.selectExpr(
        "variant_get(row[0], '$', 'bigint') as first",
        "variant_get(row[1], '$', 'double') as second",
        "variant_get(row[2], '$', 'string') as third",
        "variant_get(row[3], '$.part', 'bigint') as in_struct",
        "variant_get(row[3], '$.more[0]', 'bigint') as in_array",
        "size(row) as n_values",
        "variant_get(row[4], '$', 'boolean') as third_is_known",
    )
