"""Incremental ingest of raw files into bronze tables.

One stream per table, with its own checkpoint, run to the end of what is there (``availableNow``). The stream carries
the paths of new files only; each micro-batch reads, infers and writes its own files, so the cost of a run follows what
is new. A batch writes a folder named after its number and overwrites what an interrupted attempt left there, so every
file is loaded once. The streams of a run overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trackline import schemas
from trackline.functions import sanitize_name, sanitize_names
from trackline.session import checkpointed, discard, many_files
from trackline.sources.inventory import Spec, build_specs, hidden_files, list_files, spec_table, uncovered_files
from trackline.sources.readers import (
    BINARY_SCHEMA, CSV_OPTIONS, SCHEDULE_OPTIONS, alike, data_lines, escaped, exact_glob, file_headers, lines_by_header,
)
from trackline.sources.tables import ensure_database
from trackline.streaming.evolution import document_schema, header_schema, sync_table
from trackline.streaming.rescue import RESCUED, covers, parse_objects, read_objects, seen_schema

# The column that carries a row's file until its lineage is added.
FILE = "_file"

# Feeds some of whose fields are declared; all others are inferred.
DECLARED = {
    "bronze_json_trip_updates": schemas.TRIP_FEED,
    "bronze_json_trip_updates_ld": schemas.TRIP_FEED,
    "bronze_json_vehicle_positions": schemas.VEHICLE_FEED,
    "bronze_json_alerts": schemas.ALERT_FEED,
}


def with_lineage(df: DataFrame, pattern: str, source_format: str) -> DataFrame:
    """Add ingest time, file path, source pattern and source format."""
    return df.withColumns(
        {
            "_ingest_ts": F.current_timestamp(),
            "_source_file_path": F.col(FILE),
            "_source_pattern": F.lit(pattern),
            "_source_format": F.lit(source_format),
        }
    )


def file_stream(
    spark: SparkSession, path: str, names: str, checkpoint: str, load: Callable[[list[str], int], None],
    max_files: int = 10_000, recursive: bool = False,
) -> StreamingQuery:
    """Start a stream over the files of ``path`` called like ``names`` that ends with what is there now.

    ``load`` gets the paths of each micro-batch, at most ``max_files``, and its number; a batch that was interrupted comes
    again with the same number and paths. Nothing of the files is read by the stream itself.
    """
    options = {"maxFilesPerTrigger": max_files, "pathGlobFilter": names, "recursiveFileLookup": recursive}
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).options(**options).load(path).select("path")

    def run(batch: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in batch.collect())
        if paths:
            load(paths, number)

    writer = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(run).start()


def delimited_rows(spark: SparkSession, state: str, spec: Spec, paths: list[str]) -> DataFrame:
    """The lines of some files as text columns, each value under the name that its own file's header gives it."""
    options = CSV_OPTIONS if spec.layout == "csv" else SCHEDULE_OPTIONS
    headers = checkpointed(file_headers(spark, paths, options))
    schema = header_schema(spark, state, spec.table, headers)
    names = [n for n in schema.fieldNames() if n != RESCUED]
    if alike(headers, names):
        rows = spark.read.options(**options, columnNameOfCorruptRecord=RESCUED).schema(schema).csv(paths)
        return rows.select(*schema.fieldNames(), F.col("_metadata.file_path").alias(FILE))
    rows = lines_by_header(data_lines(spark, paths, options), headers, options, names, RESCUED)
    return rows.withColumnRenamed("_path", FILE)


def document_rows(
    spark: SparkSession, state: str, spec: Spec, paths: list[str], declared: StructType | None
) -> DataFrame:
    """The objects of some JSON files. They are parsed once; new fields widen the schema before they are read."""
    texts = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias(FILE))
    objects = checkpointed(parse_objects(texts))
    seen = seen_schema(objects)
    schema = document_schema(spark, state, spec.table, seen, declared)
    rows = read_objects(objects, schema, clean=covers(schema, seen))
    return rows.select(*schema.fieldNames(), RESCUED, FILE)


def batch_rows(
    spark: SparkSession, state: str, spec: Spec, paths: list[str], declared: dict[str, StructType] = DECLARED
) -> DataFrame:
    """The rows of some files of one source, with sanitised names and lineage."""
    exact = [escaped(p) for p in paths]
    if spec.layout == "binary":
        rows = spark.read.format("binaryFile").load(exact).select("*", F.col("_metadata.file_path").alias(FILE))
    elif spec.layout == "json":
        rows = document_rows(spark, state, spec, exact, declared.get(spec.table))
    else:
        rows = delimited_rows(many_files(spark), state, spec, exact)
    names = [n for n in rows.columns if n != FILE]
    rows = rows.toDF(*sanitize_names(names), FILE)
    return with_lineage(rows, spec.dataset, spec.source_format).drop(FILE)


def write_batch(spark: SparkSession, table: str, rows: DataFrame, number: int, path: str | None = None) -> None:
    """Bring the table's columns up to date and write the batch's folder; a repeated number replaces it."""
    path = sync_table(spark, table, rows.schema, path)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch-{number:09d}")
    spark.catalog.refreshTable(table)


def start_stream(
    spark: SparkSession,
    base: str,
    state: str,
    database: str,
    spec: Spec,
    declared: dict[str, StructType] = DECLARED,
    max_files: int = 10_000,
) -> StreamingQuery:
    """Start the stream of one source into its table."""
    table = f"{database}.{sanitize_name(spec.table)}"

    def load(paths: list[str], number: int) -> None:
        rows = batch_rows(spark, state, spec, paths, declared)
        write_batch(spark, table, rows, number)
        # The objects of a batch take up to three times their room in the table, and nothing reads them again.
        discard(rows)

    checkpoint = f"{state}/checkpoints/{spec.table}"
    return file_stream(spark, exact_glob(base, spec.dataset), spec.file_names, checkpoint, load, max_files)


def ingest(
    spark: SparkSession,
    base: str,
    state: str,
    database: str,
    location: str | None = None,
    declared: dict[str, StructType] = DECLARED,
    concurrent: int = 8,
    max_files: int = 10_000,
) -> list[Spec]:
    """Load every covered file below ``base`` into its bronze table.

    Up to ``concurrent`` streams run at a time, each in batches of ``max_files``.

    ``state`` holds checkpoints and schemas, in a folder all executors reach; the same
    holds for ``location``, where the tables of a new database are kept.
    """
    ensure_database(spark, database, location)
    specs = build_specs(spark, base)
    if not specs:
        raise ValueError(f"no supported files under {base}")

    def load(spec: Spec) -> None:
        start_stream(spark, base, state, database, spec, declared, max_files).awaitTermination()

    with ThreadPoolExecutor(concurrent) as pool:
        list(pool.map(load, specs))
    return specs


def coverage(spark: SparkSession, base: str) -> DataFrame:
    """Files below ``base`` that ``ingest`` leaves alone, hidden ones included, sorted."""
    files = checkpointed(list_files(spark, base))
    hidden = spark.createDataFrame([(p,) for p in hidden_files(spark, base, files)], "rel_path string")
    return uncovered_files(files, spec_table(files)).unionAll(hidden).orderBy("rel_path")


def audit(spark: SparkSession, database: str, specs: list[Spec]) -> DataFrame:
    """Rows per source in the loaded tables, counted in one pass."""
    rows = [
        spark.table(f"{database}.{spec.table}").select(F.lit(spec.table).alias("table_name"), "_source_pattern")
        for spec in specs
    ]
    return reduce(DataFrame.unionAll, rows).groupBy("table_name", "_source_pattern").agg(F.count(F.lit(1)).alias("rows"))
