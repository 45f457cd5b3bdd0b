"""Definitions of tables and functions that outlive a session, kept as files in a shared folder.

A session's catalog ends with its application unless there is a metastore. Kept definitions are statements that can be
repeated without harm; replaying them makes the same names known to another application. The files of a table stay where they are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyworks.operators.tables import create_database, quoted
from tallyworks.storage import path_exists

# Kinds of definitions, in the order in which they are replayed.
KINDS = ("database", "table", "function")
DEFINITIONS = "kind STRING, name STRING, version BIGINT, body STRING"


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/definitions"


def _keep(spark: SparkSession, root: str, kind: str, name: str, body: dict) -> None:
    """Add a definition; a later one of the same name counts. It is a file of its own, written as a whole or not at all."""
    version = kept(spark, root).filter((F.col("kind") == kind) & (F.col("name") == name)).agg(F.max("version")).first()[0] or 0
    row = spark.range(1).select(
        F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(version + 1).cast("bigint").alias("version"), F.lit(json.dumps(body)).alias("body")
    )
    row.write.mode("append").json(_folder(root))


def kept(spark: SparkSession, root: str) -> DataFrame:
    """Every definition ever kept below a root: ``kind, name, version, body``; none where nothing was kept."""
    if not path_exists(spark, _folder(root)):
        columns = [column.split(" ") for column in DEFINITIONS.split(", ")]
        return spark.range(0).selectExpr(*[f"cast(null as {kind}) as {name}" for name, kind in columns])
    return spark.read.schema(DEFINITIONS).json(_folder(root))


def keep_table(spark: SparkSession, root: str, name: str) -> None:
    """Keep the definition of a table in the catalog: its columns, source, options, properties, partitioning and place."""
    database, table = name.split(".")
    if database != "default":
        place = spark.sql(f"DESCRIBE DATABASE {database}").filter("info_name = 'Location'").first().info_value
        _keep(spark, root, "database", database, {"location": place})
    told = {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if row.col_name in ("Location", "Provider")}
    held = spark.table(name)
    catalog = spark._jsparkSession.sessionState().catalog()
    found = catalog.getTableMetadata(spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier(table, spark._jvm.scala.Option.apply(database)))
    columns = found.partitionColumnNames()
    partitions = [columns.apply(at) for at in range(columns.size())]
    options = {row[0]: row[1] for row in _pairs(found.storage().properties()) if row[0] not in ("path", "serialization.format")}
    properties = {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    body = {
        "columns": held.schema.toDDL(),
        "source": told["Provider"],
        "location": told["Location"],
        "partitions": partitions,
        "options": options,
        "properties": properties,
    }
    _keep(spark, root, "table", name, body)


def _pairs(scala_map) -> list[tuple[str, str]]:
    held, found = scala_map.iterator(), []
    while held.hasNext():
        one = held.next()
        found.append((one._1(), one._2()))
    return found


def keep_function(spark: SparkSession, root: str, name: str, parameters: str, returns: str, body: str) -> None:
    """Create a SQL function ``name(parameters)`` in this session's catalog, replacing one of that name, and keep its definition."""
    _create_function(spark, name, parameters, returns, body)
    _keep(spark, root, "function", name, {"parameters": parameters, "returns": returns, "body": body})


def _create_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def replay(spark: SparkSession, root: str) -> list[str]:
    """Make the kept definitions known to this session, and give the names of the tables and functions.

    What the catalog has is left as it is, but for functions, which take their last body; no file is written, moved or removed.
    Tables are external here, so dropping one leaves its files; partitions that were added since are recovered from its folders. A
    second call changes nothing. The definitions, not the data, reach the driver.
    """
    rows = kept(spark, root).groupBy("kind", "name").agg(F.max_by("body", "version").alias("body")).collect()
    names = []
    for kind in KINDS:
        for row in sorted((row for row in rows if row.kind == kind), key=lambda row: row.name):
            body = json.loads(row.body)
            if kind == "database":
                create_database(spark, row.name, body["location"])
                continue
            names.append(row.name)
            if kind == "function":
                if "." in row.name:
                    create_database(spark, row.name.split(".")[0])
                _create_function(spark, row.name, body["parameters"], body["returns"], body["body"])
            elif not spark.catalog.tableExists(row.name):
                _create_table(spark, row.name, body)
            if kind == "table" and body["partitions"]:
                spark.sql(f"MSCK REPAIR TABLE {row.name}")
    return names


def _create_table(spark: SparkSession, name: str, body: dict) -> None:
    def pairs(held: dict[str, str], between: str) -> str:
        return ", ".join(f"{quoted(key)} {between} {quoted(value)}" for key, value in held.items())

    parts = [f"CREATE TABLE IF NOT EXISTS {name} ({body['columns']}) USING {body['source']}"]
    if body["options"]:
        parts.append(f"OPTIONS ({pairs(body['options'], '')})")
    if body["partitions"]:
        parts.append("PARTITIONED BY (" + ", ".join(f"`{column}`" for column in body["partitions"]) + ")")
    parts.append(f"LOCATION {quoted(body['location'])}")
    if body["properties"]:
        parts.append(f"TBLPROPERTIES ({pairs(body['properties'], '=')})")
    spark.sql(" ".join(parts))
