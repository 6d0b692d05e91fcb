"""Best-fit packing of tokenised documents by bin completion, with whole documents kept whole.

Pieces shorter than a sequence are dealt at random into blocks that one task packs by branch and bound. A block wastes
less than a sequence or so, all of it in its last bins: those with room left are opened again and their pieces dealt
into the far fewer blocks of the next round, until one block is left or little can be gained.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trackline.llm.completion import pack_block
from trackline.llm.packing import SEQUENCE, pieces
from trackline.session import checkpointed

END_ID = 1
ITEMS = 4096  # mean number of pieces in a block
SPARE = 64  # a sequence is nearly full if at most 1 in SPARE of its room is left
ROUNDS = 32  # the pieces halve at least in each round, so that these do for any corpus


def pack_items(found: DataFrame, size: int) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset``: rows of ``length`` below ``size``, checkpointed.

    Equal rows are told apart by where they lie in the checkpoint, so copies spread over all blocks.
    """
    n, done = found.count(), []
    kept = [f.name for f in found.schema]
    for round_ in range(ROUNDS):
        blocks = max(1, -(-n // ITEMS))
        own = found.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(blocks)))

        def fill(frame: pd.DataFrame) -> pd.DataFrame:
            lengths = frame["length"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            edges = np.searchsorted(lengths[order], np.arange(size + 2))
            following = edges.tolist()  # per length, the place in the order of the next piece
            numbers, offsets, rooms = (np.empty(len(frame), np.int64) for _ in range(3))
            for number, bin_ in enumerate(pack_block(lengths.tolist(), size)):
                at = 0
                for length in bin_:
                    row = order[following[length]]
                    following[length] += 1
                    numbers[row], offsets[row], rooms[row] = number, at, size - sum(bin_)
                    at += length
            # Numbers of a block stay below 2 ** 24, those of the rounds below 64.
            ids = (frame["block"].to_numpy() * (1 << 24) + numbers) * 64 + round_
            return frame.drop(columns="block").assign(sequence_id=ids, offset=offsets, room=rooms)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        packed = checkpointed(own.groupBy("block").applyInPandas(fill, f"{schema}, sequence_id long, offset long, room long"))
        spacious = F.col("room") * SPARE > size
        left = packed.where(spacious).count() if blocks > 1 else 0
        if not left or 2 * left > n:
            done.append(packed.drop("room"))
            break
        done.append(packed.where(~spacious).drop("room"))
        found, n = packed.where(spacious).select(kept), left
    return reduce(DataFrame.unionAll, done)


def pack_whole(df: DataFrame, identity: str = "doc_id", text: str = "text", vocabulary: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A document's ids are those of its whole text and ``end_id``, so a null or empty text has one id. Only a document of
    more than ``size`` ids is cut, into pieces of ``size`` and a last one; a full piece is a sequence of its own.
    Sequence numbers are any; ``offset`` counts the ids before the piece in its sequence, without gaps. Rows are packed
    one by one, whether or not ids and texts repeat or are null; other columns are not read; an empty table gives no
    rows. With ``keep_ids`` the ids come along as little-endian 32-bit integers. The driver gets row counts only.
    """
    found = pieces(df, identity, text, vocabulary, size, end_id, keep_ids)
    found = found.withColumn("piece", F.expr(f"cast(start div {size} as int)")).drop("doc_tokens")
    found = checkpointed(found)
    whole = found.where(F.col("length") == size)
    # Rounds leave no negative numbers.
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pack_items(found.where(F.col("length") < size), size)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return whole.select(names).unionAll(rest.select(names))
