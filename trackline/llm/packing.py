"""Packing of tokenised documents into sequences of one length, as a cutting-stock problem.

A document longer than a sequence gives full pieces and a rest. The lengths of all pieces are counted in some 250
classes; column generation over that histogram finds patterns of classes that fill a sequence, and the
ranked pieces of each class are dealt to the rounded patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackline.llm.common import gapless_rank
from trackline.llm.cutting import patterns
from trackline.llm.tokens import default_vocabulary, word_tokenizer
from trackline.session import checkpointed

SEQUENCE = 4096
END_ID = 2
UNIT = 8  # tokens per unit of room; lengths are rounded up to whole units
# Longer pieces, of which a sequence holds few, are rounded to 2 and 4 units: from a quarter and a half of a sequence.
COARSE = ((4, 2), (2, 4))
RANK_BUCKETS = 1024
ROWS = 256  # texts encoded together


def pieces(df: DataFrame, identity: str, text: str, vocabulary: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids cut at multiples of ``size``.

    A document's ids are those of its whole text, then ``end_id``; a null text is empty, so it has that one id.
    """
    path = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[identity]
    # Ids that are neither whole numbers nor text travel as text.
    sent = kind if kind in ("bigint", "int") else "string"
    schema = f"doc_id {sent}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(path)
        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                rows = []
                for identity_, data in zip(part["id"].tolist(), tokenizer.encode(part["text"].tolist())):
                    data += end
                    for start in range(0, len(data), 4 * size):
                        piece = data[start : start + 4 * size]
                        row = (identity_, start // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4)
                        rows.append((*row, piece) if keep_ids else row)
                out = pd.DataFrame.from_records(rows, columns=names)
                if sent != "string":
                    out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    own = df.select(F.col(identity).cast(sent).alias("id"), F.col(text).alias("text"))
    found = own.mapInPandas(cut, schema)
    return found if sent == kind else found.withColumn("doc_id", F.col("doc_id").cast(kind))


def length_class(length: Column, size: int) -> Column:
    """Units of room for a piece: its length rounded up, more coarsely for longer ones."""
    step = F.lit(1)
    for share, units in COARSE:
        step = F.when(length > size // share, units).otherwise(step)
    return F.least(F.ceil(length / (UNIT * step)) * step, F.lit(size // UNIT)).cast("int")


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs of ranks (class, first, after, each, sequence, slot).

    The pieces of a class with ranks from ``first`` up to ``after`` fill consecutive sequences from ``sequence``
    on, ``each`` of them per sequence, from place ``slot`` on.
    """
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    taken, sequence, rows = np.zeros(len(sizes), np.int64), 0, []
    for pattern, times in patterns(sizes, demand, capacity):
        slot = 0
        for kind in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[kind])
            first = int(taken[kind])
            taken[kind] += each * times
            rows.append((int(sizes[kind]), first, int(taken[kind]), each, sequence, slot))
            slot += each
        sequence += times
    return pd.DataFrame(rows, columns=["class", "first", "after", "each", "sequence", "slot"])


def pack(df: DataFrame, identity: str = "doc_id", text: str = "text", vocabulary: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``start`` counts the document's ids before the piece, ``offset`` those before it in its sequence, without gaps.
    Every id lies in one piece. With ``keep_ids`` the ids come along as little-endian 32-bit integers. Rows are
    packed one by one, whether or not ids or texts repeat or are null; other columns are not read; an empty table
    gives no rows. What the driver gets is one count per length class.
    """
    if size % UNIT or size < UNIT:
        raise ValueError(f"a sequence holds a multiple of {UNIT} tokens")
    found = checkpointed(pieces(df, identity, text, vocabulary, size, end_id, keep_ids))
    found = found.withColumn("class", length_class(F.col("length"), size))
    counted = {r["class"]: r["count"] for r in found.groupBy("class").count().collect()}
    runs = plan(counted, size // UNIT)
    # Rows alike in all of these are alike in their ids too but for a hash collision, and interchangeable.
    order = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    spread = F.struct(*order)
    ranked = gapless_rank(found, "class", order, spread, RANK_BUCKETS, "rank")
    starts = {c: (g["first"].to_numpy(), g[["first", "each", "sequence", "slot"]].to_numpy()) for c, g in runs.groupby("class")}

    @F.pandas_udf("sequence_id long, slot long")
    def place(classes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.empty((len(classes), 2), np.int64)
        kinds, ranks = classes.to_numpy(), ranks.to_numpy()
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            firsts, table = starts[int(kind)]
            first, each, sequence, slot = table[np.searchsorted(firsts, ranks[at], "right") - 1].T
            inside = ranks[at] - first
            out[at] = np.stack((sequence + inside // each, slot + inside % each), axis=1)
        return pd.DataFrame(out, columns=["sequence_id", "slot"])

    placed = ranked.withColumn("place", place("class", "rank")).withColumns(
        {"sequence_id": F.col("place.sequence_id"), "slot": F.col("place.slot")}
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*names, *(["ids"] if keep_ids else []))
