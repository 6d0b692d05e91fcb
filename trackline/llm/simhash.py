"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are grouped by short keys cut from their bits. Inside a group they are stored as bit planes, 64 of
them to a machine word, and carry-save counters add the differing bits of many pairs at once; a block is
abandoned as soon as all its pairs are beyond the radius. A group larger than ``CHUNK`` is dealt out as pairs of
chunks, so no task meets an unbounded group, and each task returns links that span what it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import connected_components, free_name, reshuffled, row_key, split_words
from trackline.session import checkpointed

SEED = 42
CHUNK = 2048  # most fingerprints of one group that a task compares with each other
BUFFER = 8192  # rows a task gathers before it compares
SLICE = 512  # pairs of blocks compared at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Scheme:
    """Shingle length, words of 64 bits per fingerprint, radius, and keys as lists of (word, shift, width)."""

    shingle: int
    words: int
    radius: int
    keys: tuple[tuple[tuple[int, int, int], ...], ...]


def exact_scheme(shingle: int = 4, radius: int = 4) -> Scheme:
    """64 bits in radius + 2 segments, keyed by every pair: at most ``radius`` bits differ, so two segments agree."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    parts = [(0, a, b - a) for a, b in zip(edges, edges[1:])]
    return Scheme(shingle, 1, radius, tuple(combinations(parts, 2)))


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The shingle hashes themselves for word 0, independent remixes of them for the others."""
    if not word:
        return hashes
    z = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of the space-joined n-word shingles of the text with A-Z lowered; a shorter text is one shingle."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words).lower()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())]
    return np.array(found, np.uint64)


def print_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bit i is set if it is set in over half of the hashes; zero without any."""
    out = np.empty(words, np.uint64)
    for word in range(words):
        totals = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = mixed(hashes[at : at + (1 << 16)], word)
            totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
        out[word] = np.packbits(totals * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str | None, n: int, words: int) -> np.ndarray:
    """The fingerprint of a text's shingle hashes, repeats included; zero without words."""
    return print_of(shingle_hashes(text, n), words)


def fingerprints(text: Column, scheme: Scheme) -> Column:
    """A struct of longs w0, w1, ... with the fingerprint of a text."""
    names = [f"w{i}" for i in range(scheme.words)]
    n, words = scheme.shingle, scheme.words

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def computed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [fingerprint(t, n, words) for t in texts]
            found = np.stack(rows) if rows else np.empty((0, words), np.uint64)
            yield pd.DataFrame(found.view(np.int64), columns=names)

    return computed(text)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(bits, n / 64) words: bit q of word [b, i] is bit b of fingerprint 64 i + q."""
    n, words = prints.shape
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8 * words), axis=1, bitorder="little")
    blocks = np.ascontiguousarray(bits.reshape(n // 64, 64, 64 * words).transpose(2, 0, 1))
    return np.packbits(blocks, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder of three planes: their sum and their carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


class Counters:
    """Vertical counters per lane that start so that ``radius`` + 1 additions overflow; ``over`` keeps that."""

    def __init__(self, over: np.ndarray, radius: int):
        self.width = (radius + 1).bit_length()
        start = (1 << self.width) - 1 - radius
        self.planes = [np.full_like(over, ALL if start >> k & 1 else 0) for k in range(self.width)]
        self.over = over

    def add(self, plane: np.ndarray, level: int) -> None:
        for k in range(level, self.width):
            self.planes[k], plane = self.planes[k] ^ plane, self.planes[k] & plane
        self.over |= plane

    def add_seven(self, p: list[np.ndarray]) -> None:
        one, two = carry_save(p[0], p[1], p[2])
        one, more = carry_save(one, p[3], p[4])
        one, most = carry_save(one, p[5], p[6])
        two, four = carry_save(two, more, most)
        for level, plane in enumerate((one, two, four)):
            self.add(plane, level)

    def keep(self, alive: np.ndarray) -> None:
        self.planes = [p[alive] for p in self.planes]
        self.over = self.over[alive]


def close_lanes(planes: np.ndarray, masks: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, radius: int):
    """Index pairs i < j within the radius, of each fingerprint of block ``left`` and lane of block ``right``."""
    bits, blocks = planes.shape
    lane = np.arange(64, dtype=np.uint64)
    upper = np.where(lane < 63, ALL << (lane + np.uint64(1)), np.uint64(0))  # the lanes behind each lane
    over = np.zeros((len(left), 64), np.uint64)
    over[left == right] = ~upper
    for at in np.flatnonzero(right == blocks - 1):
        used = n - 64 * (blocks - 1)
        over[at] |= ALL << np.uint64(used) if used < 64 else np.uint64(0)
    for at in np.flatnonzero(left == blocks - 1):
        over[at, n - 64 * (blocks - 1) :] = ALL
    counters, at = Counters(over, radius), np.arange(len(left))
    by_block = masks.reshape(bits, blocks, 64)
    differ = lambda b: by_block[b, left[at]] ^ planes[b, right[at]][:, None]
    for first in range(0, bits, 7):
        group = range(first, min(first + 7, bits))
        if len(group) == 7:
            counters.add_seven([differ(b) for b in group])
        else:
            for b in group:
                counters.add(differ(b), 0)
        if first >= 14:
            alive = (counters.over != ALL).any(axis=1)
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if alive.mean() < 0.75:
                counters.keep(alive)
                at = at[alive]
    pair, query = np.nonzero(counters.over != ALL)
    near = np.unpackbits((~counters.over[pair, query])[:, None].view(np.uint8), axis=1, bitorder="little")
    row, j = np.nonzero(near)
    return left[at[pair[row]]] * 64 + query[row], right[at[pair[row]]] * 64 + j


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of i and j; each label is the smallest index of its set."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def block_pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of 64-row blocks that together hold all pairs of rows of one group; rows lie sorted by group."""
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    first, last = edge[:-1] // 64, (edge[1:] - 1) // 64
    pairs = {(x, x) for x in np.unique(np.concatenate((first, last))).tolist()}
    for a, b in zip(first[first < last].tolist(), last[first < last].tolist()):
        pairs.update((x, y) for x in range(a, b + 1) for y in range(x, b + 1))
    found = np.array(sorted(pairs), np.int64)
    return found[:, 0], found[:, 1]


def in_company(group: np.ndarray) -> np.ndarray:
    """Which rows, sorted by group, are not alone in theirs."""
    alone = np.ones(len(group), bool)
    same = group[1:] == group[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return ~alone


def pair_slices(group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of rows of one group within the radius, some at a time; rows lie sorted by group."""
    n = len(group)
    padded = np.zeros((-(-n // 64) * 64, prints.shape[1]), np.uint64)
    padded[:n] = prints
    planes = bit_planes(padded)
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    masks = np.where(bits.T, ALL, np.uint64(0))
    left, right = block_pairs(group)
    for at in range(0, len(left), SLICE):
        yield close_lanes(planes, masks, left[at : at + SLICE], right[at : at + SLICE], n, radius)


def spanning_links(node: np.ndarray, group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the pairs of rows of one group within the radius connect.

    Rows lie sorted by group. Rows of different groups that share a block are compared too; such links are as true.
    """
    together = in_company(group)
    node, group, prints = node[together], group[together], prints[together]
    if not len(node):
        return node, node
    values, places = np.unique(node, return_inverse=True)
    labels = np.arange(len(values))
    for i, j in pair_slices(group, prints, radius):
        merge(labels, places[i], places[j])
    linked = labels != np.arange(len(values))
    return values[linked], values[labels[linked]]


def links(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """Edges (a, b) of nodes with close fingerprints, out of (node, w0, w1, ...) with distinct fingerprints."""
    names = [f"w{i}" for i in range(scheme.words)]

    def key(number: int, parts: tuple[tuple[int, int, int], ...]) -> Column:
        value, at = F.lit(number).cast("long"), 0
        for word, shift, width in parts:
            piece = F.shiftrightunsigned(F.col(names[word]), shift).bitwiseAND((1 << width) - 1)
            value = F.shiftleft(value, width).bitwiseOR(piece)
        return value

    keys = F.array(*[key(i, parts) for i, parts in enumerate(scheme.keys)])
    keyed = prints.select("node", *names, F.explode(keys).alias("group"))
    large = keyed.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    dealt = keyed.join(reshuffled(large, "group"), "group", "left")
    own = F.pmod(F.xxhash64("node", "group"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != own)
    parts = F.transform(others, lambda x: F.least(x, own) * F.col("chunks") + F.greatest(x, own))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(parts)))
    radius = scheme.radius

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            group = frame.groupby(["group", "part"], sort=False).ngroup().to_numpy()
            found = frame[names].to_numpy(np.int64).view(np.uint64)
            a, b = spanning_links(frame["node"].to_numpy(np.int64), group, np.ascontiguousarray(found), radius)
            yield pd.DataFrame({"a": a, "b": b})

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < BUFFER:
                continue
            rows = pd.concat(held, ignore_index=True)
            end = rows.iloc[-1]
            open_group = ((rows["group"] == end["group"]) & (rows["part"] == end["part"])).to_numpy()
            closed = int(len(rows) - open_group.sum())
            if closed:
                yield from run(rows.iloc[:closed])
            held, size = [rows.iloc[closed:]], len(rows) - closed
        if size:
            yield from run(pd.concat(held, ignore_index=True))

    rows = dealt.select("group", "part", "node", *names).repartition("group", "part")
    return rows.sortWithinPartitions("group", "part").mapInPandas(compare, "a long, b long")


def grouped(df: DataFrame, identity: str, text: str, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(id, key, w0, ...) per row, and (w0, ..., best) per fingerprint: the struct (none, id, key) its component keeps."""
    names = [f"w{i}" for i in range(scheme.words)]
    rows = df.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", row_key(F.col("id"), F.col("text")).alias("key"), fingerprints(F.col("text"), scheme).alias("f"))
    rows = checkpointed(rows.select("id", "key", "f.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    nodes = rows.groupBy(*names).agg(first).withColumn("node", F.monotonically_increasing_id())
    nodes = checkpointed(nodes)
    groups = connected_components(links(nodes.select("node", *names), scheme))
    joined = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = joined.groupBy("component").agg(F.min("first").alias("best"))
    return rows, checkpointed(joined.join(reshuffled(best, "component"), "component").select(*names, "best"))


def near_duplicates(df: DataFrame, identity: str = "doc_id", text: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """(id, key, w0, ..., component, keeper): one row per row of ``df``.

    ``key`` is the row's key (see ``row_key``), ``component`` the smallest id among all rows that a chain of links
    reaches, ``keeper`` true for the rows whose (id, key) is the smallest there; an id that is null comes last.
    Equal fingerprints are linked, whatever the texts; a null or wordless text has fingerprint zero and is linked
    like any other. Copies collapse to one node before anything is compared. An empty table gives no rows.
    """
    scheme = scheme or exact_scheme()
    names = [f"w{i}" for i in range(scheme.words)]
    rows, known = grouped(df, identity, text, scheme)
    known = known.withColumnRenamed("w0", "v0")
    same = [F.col("w0") == F.col("v0"), *[F.col(f"known.{c}") == F.col(f"rows.{c}") for c in names[1:]]]
    found = rows.alias("rows").join(known.alias("known"), same)
    is_best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    return found.select(
        "id", "key", *[F.col(f"rows.{c}" if c != "w0" else c) for c in names],
        F.col("best.id").alias("component"), is_best.alias("keeper"),
    )


def drop_near_duplicates(df: DataFrame, identity: str = "doc_id", text: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """``df`` with one row of each component of close fingerprints: the row with the smallest id, see ``near_duplicates``.

    Rows with the same fingerprint are near duplicates whatever their texts, so of the texts without words, nulls
    included, one row stays. Of rows equal in id and text one stays, and a null id comes after all others.
    """
    key, n = free_name(df, "row_key"), free_name(df, "row_copies")
    rows, known = grouped(df, identity, text, scheme or exact_scheme())
    best = known.select(F.col("best.key").alias("key")).distinct()
    copies = rows.groupBy("key").agg(F.count("*").alias(n))
    stays = checkpointed(copies.join(reshuffled(best, "key"), "key").withColumnRenamed("key", key))
    rows = df.withColumn(key, row_key(F.col(identity), F.col(text))).join(stays, key)
    single, several = rows.where(F.col(n) == 1), rows.where(F.col(n) > 1).dropDuplicates([key])
    return single.unionByName(several).drop(key, n)
