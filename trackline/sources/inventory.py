"""Which files exist, which table each belongs to, which are left over."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackline.functions import sanitized
from trackline.session import in_session, many_files

# Folders whose .txt files are schedule tables.
SCHEDULE_FOLDERS = ["google_transit", "fomento_transit", "horarios-feve"]
# Which names belong to which layout; extensions in any case.
LAYOUTS = {
    "json": r"(?i)[^/]\.json$",
    "csv": r"(?i)[^/]\.csv$",
    "schedule": f"^({'|'.join(SCHEDULE_FOLDERS)})/[^/]+\\.(?i:txt)$",
    "binary": r"(?i)[^/]\.(pb|xlsx)$",
}
FORMATS = {"json": "json", "csv": "csv", "schedule": "csv", "binary": "binaryFile"}
# A folder named like a file holds the parts of one logical file, directly inside: files of its own extension, or
# part files as a distributed writer names them.
_PART = r"^((?:[^/]+/)*[^/]+\.(?i:(json|csv|txt|pb|xlsx)))/(?:part-[^/]*|[^/]+\.(?i:\2))$"


@dataclass(frozen=True)
class Spec:
    """One target table and the source it is fed from."""

    table: str
    dataset: str
    layout: str
    source_format: str
    # Newest modification, in epoch seconds.
    latest: int

    @property
    def file_names(self) -> str:
        """Pattern of the file names that belong to the source."""
        ending = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in self.dataset.rsplit(".", 1)[1])
        return f"{{part-*,*.{ending}}}"


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """Every visible file below ``base``: relative path, size, modification time.

    Only names and attributes are read.
    """
    prefix = urlparse(base).path.rstrip("/") + "/"
    files = many_files(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return in_session(files, spark).select(
        F.substring("path", F.locate(prefix, F.col("path")) + len(prefix), F.length("path")).alias("rel_path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def hidden_files(spark: SparkSession, base: str, files: DataFrame | None = None) -> list[str]:
    """Relative paths below ``base`` whose names Spark's readers pass over: they start with ``_`` or ``.``.

    Folders are searched one by one; only hidden names come to the driver. ``files`` is the ``list_files`` of ``base``,
    where that is known.
    """
    jvm = spark._jvm
    prefix = urlparse(base).path.rstrip("/") + "/"
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files = list_files(spark, base) if files is None else files
    folders = files.select(F.regexp_extract("rel_path", "^((?:[^/]+/)*)", 1).alias("folder"))
    found = []
    parents = {""} | {r.folder for r in folders.distinct().collect()}
    parents |= {"/".join(p.split("/")[:i]) + "/" for p in parents for i in range(1, p.count("/"))}
    for folder in sorted(parents):
        escaped = "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in prefix + folder)
        for entry in fs.globStatus(jvm.org.apache.hadoop.fs.Path(escaped + "[_.]*")) or []:
            inside = fs.listFiles(entry.getPath(), True)
            while inside.hasNext():
                found.append(inside.next().getPath().toUri().getPath()[len(prefix) :])
    return sorted(found)


def route_files(files: DataFrame) -> DataFrame:
    """Add the logical file, target table, layout and source format; null when no rule covers it."""
    dataset = F.col("dataset")
    layout = F.lit(None).cast("string")
    for name, pattern in reversed(LAYOUTS.items()):
        layout = F.when(dataset.rlike(pattern), name).otherwise(layout)
    folder = sanitized(F.regexp_extract("dataset", "^(.*)/[^/]*$", 1))
    source_format = F.lit(None).cast("string")
    for name, kind in FORMATS.items():
        source_format = F.when(F.col("layout") == name, kind).otherwise(source_format)
    family = F.when(F.col("layout") == "schedule", folder).otherwise(F.col("layout"))
    stem = sanitized(F.regexp_extract("dataset", r"([^/]+)\.[^./]*$", 1))
    return (
        files.withColumn("dataset", F.regexp_replace("rel_path", _PART, "$1"))
        .withColumn("layout", layout)
        .withColumn("source_format", source_format)
        .withColumn("table_name", F.concat(F.lit("bronze_"), family, F.lit("_"), stem))
    )


def uncovered_files(files: DataFrame, specs: DataFrame) -> DataFrame:
    """Files no spec covers, sorted."""
    datasets = route_files(files).select("rel_path", "dataset")
    covered = specs.select("dataset").distinct()
    return datasets.join(covered, "dataset", "left_anti").select("rel_path").orderBy("rel_path")


def spec_table(files: DataFrame) -> DataFrame:
    """One row per covered logical file."""
    covered = route_files(files).filter(F.col("table_name").isNotNull())
    return covered.groupBy("table_name", "dataset", "layout", "source_format").agg(F.max(F.unix_seconds("modified")).alias("latest"))


def build_specs(spark: SparkSession, base: str) -> list[Spec]:
    """The specs of a folder. Two logical files with one target table are an error."""
    rows = sorted(spec_table(list_files(spark, base)).collect(), key=lambda r: r.dataset)
    shared = [table for table, n in Counter(r.table_name for r in rows).items() if n > 1]
    if shared:
        raise ValueError(f"several files would share a table: {', '.join(sorted(shared))}")
    return [Spec(r.table_name, r.dataset, r.layout, r.source_format, r.latest) for r in rows]
