"""Benchmark decontamination by MinHash containment search, items partitioned by size.

A test item is a small set of word shingles that may lie inside a long document. Comparing signatures of the
whole document fails there, so the sketch is taken of the item alone: its shingles with the smallest hashes. A
document that holds a share ``threshold`` of the item lacks at most m of its n shingles, so it holds one of any
m + 1; items are partitioned by size, each partition takes its sketches large enough for its largest n, and the
search therefore loses nothing. Found pairs are verified by exact containment of the shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import fenced, free_name, reshuffled, row_key, words
from trackline.session import checkpointed

SHINGLE = 5
THRESHOLD = 0.8
SKETCH_SEED = 7
# Sketch rows up to which the search broadcasts them (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def spans(size: Column, n: int) -> Column:
    """Start positions of the n-word shingles of a text with ``size`` words; a shorter text is one shingle."""
    some = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
    return F.when(size > 0, some).otherwise(F.array().cast("array<int>"))


def with_shingles(df: DataFrame, text: str, out: str, n: int) -> DataFrame:
    """``out``: the shingle texts of the lowered text, repeats included."""
    w, at = free_name(df, "words"), free_name(df, "starts")
    df = df.withColumn(w, words(F.lower(text))).withColumn(at, spans(F.size(w), n))
    return df.withColumn(out, F.transform(at, lambda i: F.array_join(F.slice(F.col(w), i + 1, n), " "))).drop(w, at)


def with_shingle_hashes(df: DataFrame, text: str, out: str, n: int) -> DataFrame:
    """``out``: hashes of the same shingles, from word hashes, without building their texts."""
    h, at = free_name(df, "word_hashes"), free_name(df, "starts")
    df = df.withColumn(h, F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn(at, spans(F.size(h), n))
    return df.withColumn(
        out, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(n)]))
    ).drop(h, at)


def sketches(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(item, hash): per item the shingle hashes that come first in a random order, as many as its size class needs."""
    hashed = with_shingle_hashes(items, "text", "hashes", n).select("item", F.array_distinct("hashes").alias("hashes"))
    largest = F.least(
        F.size("hashes"), F.pow(F.lit(2), F.floor(F.log2(F.size("hashes"))) + 1).cast("int") - 1
    )
    spare = F.floor(largest * F.lit(1.0) - F.ceil(F.round(largest * threshold, 6))).cast("int")
    order = F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit(SKETCH_SEED)), h.alias("h"))))
    taken = F.slice(order, 1, spare + 1)
    taken = F.when(F.size("hashes") > 0, taken.getField("h"))
    return hashed.select("item", F.explode_outer(taken).alias("hash")).where("hash IS NOT NULL")


def contaminated(
    df: DataFrame,
    items: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, key, item, n_shared, n_shingles, containment): rows of ``df`` that hold an item, and which.

    Containment is the share of the item's distinct shingles that occur in the whole text; words are lowered. A
    text shorter than a shingle is one shingle itself, so a short item only matches texts that equal it. Null or
    wordless texts and items match nothing. Rows equal in id and text each give their rows, items are told apart
    by id and text, and an empty table on either side gives no rows. ``key`` is the row's key (see ``row_key``).
    """
    tests = items.select(F.struct(F.col(item).alias("id"), F.col(item_text).alias("text")).alias("item"))
    tests = tests.distinct().select("item", F.col("item.text").alias("text"))
    sketch = checkpointed(sketches(tests, shingle, threshold))
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    docs = df.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    docs = docs.withColumn("key", row_key(F.col("id"), F.col("text")))
    probes = with_shingle_hashes(docs, "text", "hashes", shingle).select("key", F.explode_outer("hashes").alias("hash"))
    pairs = checkpointed(probes.join(sketch, "hash").select("key", "item").distinct())
    # Every row of a key has the same text: the shingle texts are built once per candidate.
    found = docs.join(reshuffled(pairs, "key"), "key")
    found = with_shingles(found, "text", "shingles", shingle)
    found = with_shingles(found.withColumn("item_text", F.col("item.text")), "item_text", "item_shingles", shingle)
    found = found.withColumn("item_shingles", F.array_distinct("item_shingles"))
    found = fenced(
        found,
        {
            "n_shingles": F.size("item_shingles").cast("long"),
            "n_shared": F.size(F.array_intersect("item_shingles", "shingles")).cast("long"),
        },
    )
    share = F.col("n_shared") / F.col("n_shingles")
    found = found.withColumn("containment", F.round(share, 9)).where(F.col("containment") >= threshold)
    return found.select("id", "key", F.col("item.id").alias("item"), "n_shared", "n_shingles", "containment")


def drop_contaminated(df: DataFrame, items: DataFrame, identity: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``df`` whose text holds no item."""
    key = free_name(df, "row_key")
    bad = contaminated(df, items, identity, text, **kw).select(F.col("key").alias(key)).distinct()
    rows = df.withColumn(key, row_key(F.col(identity), F.col(text)))
    return rows.join(reshuffled(bad, key), key, "left_anti").drop(key)


# The operator's rows over ``documents`` and ``benchmark`` as DuckDB SQL: exact containment of every pair.
SQL = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents
), held AS (
  SELECT DISTINCT row, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
    list_transform(range(0, greatest(len(w) - {SHINGLE}, 0) + 1), lambda i: array_to_string(w[i + 1 : i + {SHINGLE}], ' ')) END) AS s
  FROM split
), item_words AS (
  SELECT DISTINCT item_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w
  FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, text, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
    list_transform(range(0, greatest(len(w) - {SHINGLE}, 0) + 1), lambda i: array_to_string(w[i + 1 : i + {SHINGLE}], ' ')) END) AS s
  FROM item_words
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n FROM wanted
)
SELECT doc_id, item_id, count(*) AS n_shared, min(n) AS n_shingles, round(count(*) / min(n), 9) AS containment
FROM held JOIN sized USING (s)
GROUP BY row, doc_id, item_id, text
HAVING round(count(*) / min(n), 9) >= {THRESHOLD}
"""
