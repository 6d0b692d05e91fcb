"""Batch readers for the raw file kinds."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trackline.operators.columns import clean_columns
from trackline.session import checkpointed

# The delimited layouts.
CSV_OPTIONS = {"header": "true", "sep": ";", "quote": '"', "escape": '"', "encoding": "ISO-8859-1"}
SCHEDULE_OPTIONS = {"header": "true", "sep": ",", "quote": '"', "escape": '"'}
BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

_OVERFLOW, _RAW, _PATH, _UTF8 = "_overflow", "_raw_line", "_path", "_utf8"
# Put behind a header line while it is parsed, to see where it ends.
_END = "\x01end\x01"
# No separator of text: lines read under it stay whole.
_NEVER = "\x01"


def escaped(path: str) -> str:
    """Path pattern matching just ``path``, whatever characters it holds."""
    return "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in path)


def exact_glob(base: str, rel_path: str) -> str:
    """Path pattern matching just ``rel_path``: file streams accept patterns, not files."""
    last = rel_path[-1]
    start = f"{base.rstrip('/')}/{escaped(rel_path[:-1])}"
    return f"{start}[{last}]" if last.isalnum() else f"{start}{last}"


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def sniff_separator(spark: SparkSession, path: str, sep: str) -> str:
    """``sep``, or ``;`` when the header has no ``sep`` but does have ``;``."""
    first = spark.read.text(path).limit(1).first()
    header = first.value if first else ""
    return ";" if sep not in header and ";" in header else sep


def file_headers(
    spark: SparkSession, path: str | list[str], options: dict[str, str], files: DataFrame | None = None, mixed: bool = False
) -> DataFrame:
    """(file, header) for the delimited files of ``path``, with the names that Spark's own reader gives the columns.

    Only the start of each file counts, and all headers are parsed in one pass, however many differ. ``files`` (``_path``,
    ``utf8``) limits the answer to some of them; with ``mixed`` a header is read as UTF-8 where its file is marked so.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").where(F.col("value").rlike(r"[^\x00-\x20]"))
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    firsts = lines.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    encoding = options.get("encoding", "UTF-8")
    line = F.col("line") if encoding == "UTF-8" else F.decode(F.col("line").cast("binary"), encoding)
    if files is not None:
        firsts = firsts.join(files.select(F.col(_PATH).alias("file"), "utf8"), "file")
        line = F.when(F.col("utf8"), F.col("line")).otherwise(line) if mixed else line
    firsts = checkpointed(firsts.select("file", line.alias("line")))
    if options.get("multiLine"):
        return _headers_over_lines(spark, firsts, options, files, mixed)
    sep = options["sep"]
    width = firsts.agg(F.max(F.size(F.split("line", re.escape(sep))))).first()[0] or 1
    kinds = ",".join(f"f{i} string" for i in range(width + 1))
    parsed = F.from_csv(F.concat("line", F.lit(f"{sep}{_END}")), kinds, {k: options[k] for k in ("sep", "quote", "escape")})
    values = firsts.select("file", parsed.alias("f")).select("file", F.array(*[f"f.f{i}" for i in range(width + 1)]).alias("v"))
    count = F.array_position("v", F.lit(_END)).cast("int")
    # A quote that is never closed takes the mark into its name.
    unclosed = F.transform(F.filter("v", lambda v: v.isNotNull()), lambda v: F.replace(v, F.lit(f"{sep}{_END}"), F.lit("")))
    given = F.when(count > 0, F.slice("v", 1, count - 1)).otherwise(unclosed)
    values = values.select("file", given.alias("v"), F.transform(given, F.lower).alias("low"))

    def safe(name: Column, at: Column) -> Column:
        again = F.size(F.filter("low", lambda other: other == F.lower(name))) > 1
        place = at.cast("string")
        return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("_c"), place)).when(again, F.concat(name, place)).otherwise(name)

    return values.select("file", F.transform("v", safe).alias("header"))


def _headers_over_lines(
    spark: SparkSession, firsts: DataFrame, options: dict[str, str], files: DataFrame | None, mixed: bool
) -> DataFrame:
    """``file_headers`` where a quoted name may go on in the next line: a file per different first line is opened by name."""
    utf8 = files.select(F.col(_PATH).alias("file"), "utf8") if mixed else firsts.select("file", F.lit(False).alias("utf8"))
    marked = firsts.join(utf8, "file")
    known = []
    for kind in marked.groupBy("line", "utf8").agg(F.min("file").alias("sample")).collect():
        encoding = {"encoding": "UTF-8"} if kind.utf8 and mixed else {}
        sample = exact_glob(*unquote(kind.sample).rsplit("/", 1))
        known.append((kind.line, kind.utf8, spark.read.options(**options | encoding).csv(sample).columns))
    table = spark.createDataFrame(known, "line string, utf8 boolean, header array<string>")
    return marked.join(F.broadcast(table), ["line", "utf8"]).select("file", "header")


def header_names(headers: DataFrame, most: int | None = None) -> list[str]:
    """The names of ``file_headers`` by the first file that has each; of more than ``most`` those that most files have."""
    places = headers.select("file", F.posexplode("header").alias("at", "name"))
    names = places.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("file", "at")).alias("first"))
    if most is not None:
        names = names.orderBy(F.desc("files"), "first").limit(most)
    return [r.name for r in sorted(names.collect(), key=lambda r: r.first)]


def alike(headers: DataFrame, names: list[str]) -> bool:
    """Whether every file has just these names in this order."""
    return headers.filter(F.col("header") != F.array(*map(F.lit, names)).cast("array<string>")).isEmpty()


def data_lines(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """The lines of delimited files below their headers, unparsed, as ``value``, and ``_path``.

    Spark's reader of wide files compares every field with every other anew for each file it opens. Here it sees no fields.
    """
    kinds = StructType([StructField(n, StringType()) for n in ("_one", "_two", _RAW)])
    plain = options | {"sep": _NEVER, "quote": "", "escape": ""}
    lines = spark.read.options(**plain, columnNameOfCorruptRecord=_RAW).schema(kinds).csv(paths)
    # A line without two fields is a corrupt record, kept as it is.
    two = F.concat(F.coalesce("_one", F.lit("")), F.lit(_NEVER), F.coalesce("_two", F.lit("")))
    return lines.select(F.coalesce(_RAW, two).alias("value"), F.col("_metadata.file_path").alias(_PATH))


def by_header(rows: DataFrame, columns: list[str], headers: DataFrame) -> DataFrame:
    """Rows read by position under ``columns``, with each value under the name its own file's header gives it.

    ``rows`` carries its file as ``_path``. Values under names that ``columns`` lacks are left out.
    """
    # Columns of their own: every name below looks into them.
    rows = rows.withColumn("_values", F.array(*[F.col(f"`{c}`") for c in columns])).drop(*columns)
    others = [c for c in rows.columns if c != "_values"]
    rows = _under_header(rows, headers, columns).withColumn("_picked", _picked(columns))
    return rows.selectExpr(*map(_quoted, others), *_unpacked(columns))


def lines_by_header(lines: DataFrame, headers: DataFrame, options: dict[str, str], names: list[str], rescued: str) -> DataFrame:
    """The ``data_lines`` of files as text columns ``names``, with each value under the name its own file's header gives it.

    Values under other names go to ``rescued`` as JSON. A line that is too short or too long for its own header, or whose
    header is longer than ``names``, is kept there as it is. ``_path`` stays.
    """
    # With a field more than any header has, every line counts as too short and keeps its text.
    width = max(len(names), headers.agg(F.max(F.size("header"))).first()[0]) + 1
    fields = [f"f{i}" for i in range(width)]
    parsed = {k: options[k] for k in ("sep", "quote", "escape")} | {"columnNameOfCorruptRecord": _RAW}
    kinds = ",".join(f"{f} string" for f in [*fields, _RAW])
    rows = lines.select(_PATH, F.from_csv("value", kinds, parsed).alias("_fields"))
    rows = rows.select(_PATH, F.expr(f"array({','.join(f'_fields.{f}' for f in fields)})").alias("_values"), f"_fields.{_RAW}")
    # One row per file of the batch.
    rows = _under_header(rows, F.broadcast(headers), names)
    values, header = F.col("_values"), F.col("_header")
    pairs = F.filter(F.arrays_zip(header.alias("name"), values.alias("value")), lambda p: p["value"].isNotNull())
    other = F.filter(pairs, lambda p: p["name"].isNotNull() & ~F.array_contains(_texts(names), p["name"]))
    other = F.map_from_entries(F.transform(other, lambda p: F.struct(p["name"], p["value"])))
    own = F.size(header)
    surplus = F.exists(F.slice(values, own + 1, F.lit(width)), lambda x: x.isNotNull())
    fits = (own < width) & (own <= len(names)) & (F.size(F.split(_RAW, re.escape(options["sep"]))) >= own) & ~surplus
    line = F.when(~F.coalesce(fits, F.lit(False)), F.col(_RAW))
    kept = F.coalesce(line, F.nullif(F.to_json(other), F.lit("{}")))
    rows = rows.select(_PATH, kept.alias("_rescued"), _picked(names).alias("_picked"))
    return rows.selectExpr(*_unpacked(names), f"_rescued AS {_quoted(rescued)}", _PATH)


def _texts(values: list[str]) -> Column:
    """A constant list: one expression however long it is."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _under_header(rows: DataFrame, headers: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with their file's header as ``_header``; ``names`` where that has none."""
    rows = rows.join(headers.select(F.col("file").alias(_PATH), F.col("header").alias("_header")), _PATH, "left")
    return rows.withColumn("_header", F.coalesce("_header", _texts(names)))


def _picked(names: list[str]) -> Column:
    """The values of ``_values`` that ``_header`` gives ``names``, as a list."""
    return F.transform(_texts(names), lambda n: F.get("_values", F.array_position("_header", n).cast("int") - 1))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _unpacked(names: list[str]) -> list[str]:
    return [f"_picked[{i}] AS {_quoted(n)}" for i, n in enumerate(names)]


def files_by_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(path, utf8, binary) per file: whether every line is valid UTF-8, and whether any holds a zero byte, as no text does."""
    return (
        spark.read.text(path)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(F.contains("value", F.lit("\0"))).alias("binary"))
    )


def _delimited(
    spark: SparkSession,
    path: str,
    sep: str,
    encoding: str,
    skip_long: bool,
    multi_line: bool = False,
    files: DataFrame | None = None,
    mixed: bool = False,
) -> DataFrame:
    """Delimited text as text columns; files with headers of their own are lined up by name.

    ``files`` (``_path``, ``utf8``) limits it to some; with ``mixed`` those marked so are UTF-8 within a Latin-1 read.
    """
    options = {"header": "true", "sep": sep, "quote": '"', "escape": '"', "encoding": encoding, "multiLine": multi_line}
    headers = file_headers(spark, path, options, files, mixed)
    columns = header_names(headers)
    if not columns:
        columns = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*columns, _OVERFLOW, _RAW]])
    # Without every column parsed, the number of fields in a line would go unnoticed.
    rows = spark.read.options(**options, columnNameOfCorruptRecord=_RAW, columnPruning=False).schema(schema).csv(path)
    rows = rows.withColumn(_PATH, F.col("_metadata.file_path"))
    if files is not None:
        rows = rows.join(files.withColumnRenamed("utf8", _UTF8), _PATH)
    if skip_long:
        # The schema has one field too many, so a full line counts as too short.
        rows = rows.filter(F.col(_OVERFLOW).isNull() & F.col(_RAW).isNotNull())
    if not alike(headers, columns):
        headers = checkpointed(headers)
        if skip_long:
            fields = F.array(*[F.col(f"`{c}`") for c in columns])
            widths = headers.select(F.col("file").alias(_PATH), F.size("header").alias("_width"))
            surplus = F.exists(F.slice(fields, F.col("_width") + 1, F.lit(len(columns))), lambda x: x.isNotNull())
            rows = rows.join(widths, _PATH).filter(~surplus).drop("_width")
        rows = by_header(rows, columns, headers)
    values = [F.col(f"`{c}`") for c in columns]
    if mixed:
        values = [F.when(F.col(_UTF8), _as_utf8(v)).otherwise(v).alias(c) for c, v in zip(columns, values)]
    return clean_columns(rows.select(*values))


def _as_utf8(text: Column) -> Column:
    """Text that was read as Latin-1, decoded as the UTF-8 it is."""
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ";",
    encoding: str = "UTF-8",
    skip_long: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text, all columns text. Short lines are padded.

    Lines with too many fields are skipped; ``skip_long=False`` keeps them without the
    surplus. With ``multi_line`` quoted values may hold line breaks; a file is then read by
    one task.
    """
    return _delimited(spark, path, sep, encoding, skip_long, multi_line)


def read_csv_flexible(spark: SparkSession, path: str, sep: str = ";", multi_line: bool = False) -> DataFrame:
    """Delimited text in UTF-8 or, file by file, Latin-1; falls back to ``;``. Files that are no text are left out.

    One pass for the flags, of which one row reaches the driver, and one for the rows: where encodings differ, all files
    are read as Latin-1, which keeps every byte, and the values of UTF-8 files are decoded after that.
    """
    kinds = checkpointed(files_by_encoding(spark, path))
    seen = kinds.agg(
        F.bool_or(F.col("utf8") & ~F.col("binary")).alias("utf8"),
        F.bool_or(~F.col("utf8") & ~F.col("binary")).alias("latin"),
        F.bool_or("binary").alias("binary"),
    ).first()
    if not seen.utf8 and not seen.latin:
        return spark.createDataFrame([], StructType())
    chosen = sniff_separator(spark, path, sep)
    mixed = seen.utf8 and seen.latin
    files = kinds.filter(~F.col("binary")).select(F.col("path").alias(_PATH), "utf8") if mixed or seen.binary else None
    return _delimited(spark, path, chosen, "UTF-8" if not seen.latin else "ISO-8859-1", True, multi_line, files, mixed)


def read_if_exists(spark: SparkSession, path: str, reader, schema: StructType) -> DataFrame:
    """``reader(path)``, or a typed empty frame when there is no such file."""
    return reader(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return clean_columns(spark.read.options(**SCHEDULE_OPTIONS).csv(path))


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Whole-file JSON: an object is one row, an array one row per element; a file that is no JSON gives none."""
    broken = "_broken_document"
    read = spark.read.schema(StructType([*schema, StructField(broken, StringType())]))
    rows = read.option("multiLine", True).option("columnNameOfCorruptRecord", broken).json(path)
    return rows.filter(F.col(broken).isNull()).drop(broken)


def broken_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, reason) per file of a source that no reader can use: ``no text`` or ``no JSON``."""
    file = F.col("_metadata.file_path").alias("file")
    if kind == "json":
        texts = spark.read.text(path, wholetext=True).select(file, "value")
        return texts.filter(F.try_parse_json("value").isNull()).select("file", F.lit("no JSON").alias("reason"))
    return files_by_encoding(spark, path).filter("binary").select(F.col("path").alias("file"), F.lit("no text").alias("reason"))


def read_array_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Whole-file JSON that must be an array of objects; anything else gives no rows."""
    text = spark.read.text(path, wholetext=True).filter(F.ltrim("value", F.lit(" \t\r\n")).startswith("["))
    row = F.explode(F.from_json("value", f"array<{schema.simpleString()}>"))
    return text.select(row.alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Raw bytes with path, size and time; never decoded."""
    return spark.read.format("binaryFile").load(path)
