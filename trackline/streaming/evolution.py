"""Schema state of the ingest: stored schemas, new columns, table definitions."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from trackline.sources.readers import header_names
from trackline.streaming.rescue import RESCUED, inferred

# Columns a table of delimited files is made with; values under further names are kept as JSON beside them.
MAX_COLUMNS = 1_000


def merge_types(stored: DataType, seen: DataType) -> DataType:
    """Stored type widened by new struct fields; on conflict the stored type stays."""
    if isinstance(stored, StructType) and isinstance(seen, StructType):
        by_name = {f.name: f for f in seen}
        fields = [
            StructField(f.name, merge_types(f.dataType, by_name[f.name].dataType)) if f.name in by_name else f
            for f in stored
        ]
        return StructType(fields + [f for f in seen if f.name not in stored.fieldNames()])
    if isinstance(stored, ArrayType) and isinstance(seen, ArrayType):
        return ArrayType(merge_types(stored.elementType, seen.elementType))
    return stored


def stored_schema(spark: SparkSession, state: str, table: str) -> StructType | None:
    """The newest schema kept for a table."""
    try:
        entries = spark.read.text(f"{state}/schemas/{table}").collect()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    entry = max((json.loads(r.value) for r in entries), key=lambda e: e["version"])
    return StructType.fromJson(entry["schema"])


def store_schema(spark: SparkSession, state: str, table: str, schema: StructType) -> None:
    entry = json.dumps({"version": time.time_ns(), "schema": schema.jsonValue()})
    spark.range(1, numPartitions=1).select(F.lit(entry).alias("value")).write.mode("append").text(f"{state}/schemas/{table}")


def header_schema(spark: SparkSession, state: str, table: str, headers: DataFrame) -> StructType:
    """Text columns of the headers of the first batch, in file order; names that come later are rescued.

    So are those beyond ``MAX_COLUMNS``, of which the names that most files have become columns: no value is lost.
    """
    stored = stored_schema(spark, state, table)
    if stored:
        return stored
    names = header_names(headers, MAX_COLUMNS)
    schema = StructType([StructField(n, StringType()) for n in [*names, RESCUED]])
    store_schema(spark, state, table, schema)
    return schema


def document_schema(
    spark: SparkSession, state: str, table: str, seen: DataType, declared: StructType | None = None
) -> StructType:
    """The stored or declared schema, widened by the new fields of the type ``seen`` in a batch.

    Where ``declared`` has a field its type wins, which also covers arrays that came empty.
    """
    stored = stored_schema(spark, state, table)
    known = stored or declared or StructType()
    fields = inferred(seen) if isinstance(seen, StructType) else None
    schema = merge_types(known, fields) if fields else known
    if schema != stored:
        store_schema(spark, state, table, schema)
    return schema


def database_path(spark: SparkSession, database: str) -> str:
    return spark.sql(f"DESCRIBE SCHEMA {database}").filter("info_name = 'Location'").first().info_value.rstrip("/")


def sync_table(spark: SparkSession, table: str, schema: StructType, path: str | None = None) -> str:
    """Create the table, in ``path`` or its database's folder, or give it the new fields of ``schema``; where it lies.

    The files of a table lie in one folder per batch, read as one. New columns are added in place. Only new fields
    inside a column make the definition anew, over the same files; should that fail, the old definition is put back.
    Files written before a field existed read it as null.
    """
    database, name = table.rsplit(".", 1)

    def create(path: str, kind: StructType) -> str:
        spark.catalog.createTable(table, path=path, source="parquet", schema=kind, recursiveFileLookup="true")
        return path

    if not spark.catalog.tableExists(table):
        return create(path or f"{database_path(spark, database)}/{name}", schema)
    current = spark.table(table).schema
    path = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first().data_type
    merged = merge_types(current, schema)
    kept = StructType(merged.fields[: len(current)])
    if kept.simpleString() != current.simpleString():
        # The table is external, so dropping the definition keeps its files.
        spark.sql(f"DROP TABLE {table}")
        try:
            create(path, merged)
        except Exception:
            create(path, current)
            raise
    elif len(merged) > len(current):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.fields[len(current) :])
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    return path
