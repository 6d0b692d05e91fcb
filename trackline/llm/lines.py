"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines picks the cuts, so a run of lines is cut alike wherever it
stands, whatever comes before it. A line of ``LONG_LINE`` characters or more is a passage by itself and a chunk of its
own; chunks of shorter lines hold two or more. A short line alone between long ones is compared together with the line
before it, or after it at the start of a text. Of the chunks that occur again anywhere, with the same bytes, all but
the first occurrence go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import fenced, free_name, reshuffled, row_key
from trackline.session import checkpointed

# Fixed values of the rolling hash: line hashes modulo a prime, weight of the line before, prime of the sum.
LINE_PRIME, WEIGHT, ROLL_PRIME = 268435399, 31, 1000003
LONG_LINE = 60  # characters of a line that is a chunk of its own


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long") % LINE_PRIME


def with_cuts(df: DataFrame, text: str, lines: str, ends: str) -> DataFrame:
    """``lines``: the text parted at line feeds. ``ends``: positions of the last lines of its chunks.

    A chunk ends after the last line, before and after a long line, and among shorter lines after line i where the
    rolling hash over lines i-1 and i is a local minimum. The two lines on either side of such a cut are short, so it
    leaves no single line.
    """
    hashes, roll = free_name(df, "line_hashes"), free_name(df, "roll")
    df = df.withColumn(lines, F.split(F.coalesce(text, F.lit("")), "\n", -1))
    df = df.withColumn(hashes, F.transform(lines, line_hash))
    df = df.withColumn(
        roll,
        F.transform(
            hashes,
            lambda h, i: (F.when(i > 0, F.get(hashes, i - 1) * WEIGHT).otherwise(0) + h) % ROLL_PRIME,
        ),
    )
    last = F.size(lines) - 1
    long = lambda i: F.coalesce(is_long(F.get(lines, i)), F.lit(False))
    is_end = lambda i: (i == last) | long(i) | long(i + 1) | (
        (i > 0)
        & (i < last - 1)
        & ~long(i - 1)
        & ~long(i + 2)
        & (F.get(roll, i) < F.get(roll, i - 1))
        & (F.get(roll, i) <= F.get(roll, i + 1))
    )
    return df.withColumn(ends, F.filter(F.sequence(F.lit(0), last), is_end)).drop(hashes, roll)


def is_long(line: Column) -> Column:
    return F.length(line) >= LONG_LINE


def first_line(ends: Column, number: Column) -> Column:
    return F.when(number == 0, 0).otherwise(F.get(ends, number - 1) + 1)


def chunk_text(lines: Column, ends: Column, number: Column) -> Column:
    start = first_line(ends, number)
    return F.array_join(F.slice(lines, start + 1, F.get(ends, number) - start + 1), "\n")


def compared(lines: Column, ends: Column, number: Column) -> Column:
    """The bytes that tell whether a chunk occurs again; null for a text of a single short line."""
    start, end = first_line(ends, number), F.get(ends, number)
    alone = (start == end) & ~is_long(F.get(lines, end))
    pair = F.when(start > 0, F.array_join(F.slice(lines, start, 2), "\n"))
    pair = pair.when(end < F.size(lines) - 1, F.array_join(F.slice(lines, start + 1, 2), "\n"))
    return F.when(alone, pair).otherwise(chunk_text(lines, ends, number))


def cut_rows(df: DataFrame, identity: str, text: str) -> DataFrame:
    own = df.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return with_cuts(own.withColumn("key", row_key(F.col("id"), F.col("text"))), "text", "lines", "ends")


def line_chunks(df: DataFrame, identity: str, text: str) -> DataFrame:
    """(key, id, number, digest): every chunk but the texts of one short line."""
    cut = cut_rows(df, identity, text)
    chunk = lambda i: F.md5(compared(F.col("lines"), F.col("ends"), i))
    digests = F.transform(F.sequence(F.lit(0), F.size("ends") - 1), chunk)
    return cut.select("key", "id", F.posexplode_outer(digests).alias("number", "digest")).where("digest IS NOT NULL")


def chunk_bytes(df: DataFrame, identity: str, text: str, marks: DataFrame) -> DataFrame:
    """The chunks that ``marks`` (key, number, digest) names, with their texts."""
    wanted = marks.groupBy("key").agg(F.collect_set(F.struct("number", "digest")).alias("wanted"))
    rows = cut_rows(df, identity, text).join(reshuffled(wanted, "key"), "key")
    texts = F.transform(
        "wanted",
        lambda x: F.struct(
            x.number.alias("number"),
            x.digest.alias("digest"),
            compared(F.col("lines"), F.col("ends"), x.number).alias("chunk"),
        ),
    )
    return rows.select("key", "id", F.explode_outer(texts).alias("c")).select("key", "id", "c.*")


def repeated_chunks(df: DataFrame, identity: str, text: str) -> DataFrame:
    """(key, gone): the numbers of the chunks to remove from the rows of each key.

    Digests find the chunks that may repeat, then their bytes are compared: only distinct (digest, bytes) are
    shuffled. The first occurrence is the one with the smallest (id, key, number), a null id first. Should a digest
    stand for several byte sequences, its chunks are told apart by their bytes.
    """
    chunks = checkpointed(line_chunks(df, identity, text))
    place = F.struct("id", "key", "number")
    again = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    marks = chunks.join(reshuffled(again, "digest"), "digest")
    is_first = lambda: (F.col("key") == F.col("first.key")) & (F.col("number") == F.col("first.number"))
    marks = checkpointed(marks.select("key", "id", "number", "digest", is_first().alias("is_first")))
    later = marks.where(~F.col("is_first")).select("key", "number")
    kinds = chunk_bytes(df, identity, text, marks).select("digest", "chunk").distinct()
    mixed = checkpointed(kinds.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if not mixed.isEmpty():
        pure = marks.join(mixed, "digest", "left_anti")
        found = chunk_bytes(df, identity, text, marks.join(mixed, "digest", "left_semi"))
        firsts = checkpointed(found.groupBy("chunk").agg(F.min(place).alias("first")))
        told = found.join(reshuffled(firsts, "chunk"), "chunk").where(~is_first())
        later = pure.where(~F.col("is_first")).select("key", "number").union(told.select("key", "number"))
    return later.groupBy("key").agg(F.collect_set("number").alias("gone"))


def drop_repeated_lines(df: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated chunks of lines cut out of ``text``, and n_lines, n_removed_lines, n_removed_chunks.

    The lines left are joined by line feeds again. A null text stays null, with no lines; an empty text has one
    empty line. Rows equal in id and text are one occurrence and get the same result. A text all of whose
    chunks go becomes empty; no row is dropped. An empty table gives an empty result, and columns called like one
    of the three are replaced.
    """
    key, lines, ends, gone, kept = (free_name(df, n) for n in ("row_key", "lines", "ends", "gone", "kept"))
    marks = repeated_chunks(df, identity, text).select(F.col("key").alias(key), F.col("gone").alias(gone))
    rows = df.withColumn(key, row_key(F.col(identity), F.col(text))).join(reshuffled(marks, key), key, "left")
    some = F.size(F.coalesce(gone, F.array().cast("array<int>")))
    cut = with_cuts(rows.withColumn(gone, F.coalesce(gone, F.array().cast("array<int>"))), text, lines, ends)
    stays = F.filter(
        F.sequence(F.lit(0), F.size(ends) - 1), lambda i: ~F.array_contains(F.col(gone), i)
    )
    part = lambda i: F.slice(
        F.col(lines), first_line(F.col(ends), i) + 1, F.get(ends, i) - first_line(F.col(ends), i) + 1
    )
    cut = cut.withColumn(kept, F.flatten(F.transform(stays, part)))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    left = F.when(F.size(gone) == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))
    return fenced(
        cut,
        {
            "n_lines": n_lines,
            "n_removed_lines": F.when(F.size(gone) == 0, 0).otherwise(F.size(lines) - F.size(kept)).cast("long"),
            "n_removed_chunks": F.size(gone).cast("long"),
            text: left,
        },
    ).drop(key, lines, ends, gone, kept)


# The operator's rows over ``documents`` as DuckDB SQL.
SQL = f"""
WITH lines AS (
  SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '~') || chr(31) || coalesce(text, chr(30))) AS key, text,
    unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT % {LINE_PRIME} AS h, max(i) OVER (PARTITION BY key) AS last
  FROM lines
), rolled AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * {WEIGHT} + h) % {ROLL_PRIME} AS r FROM hashed
  WINDOW w AS (PARTITION BY key ORDER BY i)
), flagged AS (
  SELECT *, length(line) >= {LONG_LINE} OR coalesce(length(lead(line) OVER w) >= {LONG_LINE}, false)
    OR i > 0 AND i < last - 1 AND length(lag(line) OVER w) < {LONG_LINE} AND length(lead(line, 2) OVER w) < {LONG_LINE}
    AND r < lag(r) OVER w AND r <= lead(r) OVER w AS is_end, lag(line) OVER w AS before, lead(line) OVER w AS after
  FROM rolled
  WINDOW w AS (PARTITION BY key ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS number FROM flagged
), chunks AS (
  SELECT key, doc_id, number, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk,
    CASE WHEN count(*) > 1 OR length(min(line)) >= {LONG_LINE} THEN string_agg(line, chr(10) ORDER BY i)
      ELSE coalesce(min(before) || chr(10) || min(line), min(line) || chr(10) || min(after)) END AS bytes
  FROM numbered GROUP BY ALL
), marked AS (
  SELECT *, bytes IS NOT NULL AND row_number() OVER (PARTITION BY bytes
    ORDER BY doc_id NULLS FIRST, key, number) > 1 AS gone
  FROM chunks
), texts AS (
  SELECT key, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed_lines,
    count(*) FILTER (gone) AS n_removed_chunks,
    coalesce(string_agg(chunk, chr(10) ORDER BY number) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY key
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN t.text END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END::BIGINT AS n_lines,
  n_removed_lines::BIGINT AS n_removed_lines, n_removed_chunks::BIGINT AS n_removed_chunks
FROM documents d
JOIN texts t ON t.key = md5(coalesce(d.doc_id::VARCHAR, '~') || chr(31) || coalesce(d.text, chr(30)))
"""
