"""Merkle manifest of a dataset: a ternary hash tree per group of rows and one over the groups' roots.

Trees are stored as blocks, aligned subtrees of ``HEIGHT`` levels, one row of Parquet each. Inside a block the digests
lie in van Emde Boas order: the levels are split at half height, the upper part comes first and each lower subtree
follows whole, and so on inside each part. Where a digest lies follows from its depth and index by arithmetic alone,
for building as for reading siblings. The roots of the blocks are the leaves of the next level's blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackline.llm.common import reshuffled
from trackline.session import checkpointed

FAN = 3
HEIGHT = 5  # levels above the leaves of a block
LEAVES = FAN**HEIGHT
DIGEST = 32
BLOCK = "block long, n int, height int, nodes binary, claims binary"


def nodes_of(levels: int) -> int:
    """Nodes of a complete tree with so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


@cache
def splits(height: int) -> tuple[tuple[int, int, int], ...]:
    """Per depth: depth of the part's root above it, nodes of that upper part, nodes of one lower part."""
    found: list[tuple[int, int, int]] = [(0, 0, 0)] * (height + 1)

    def split(depth: int, levels: int) -> None:
        if levels < 2:
            return
        upper = levels // 2
        found[depth + upper] = (depth, nodes_of(upper), nodes_of(levels - upper))
        split(depth, upper)
        split(depth + upper, levels - upper)

    split(0, height + 1)
    return tuple(found)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth in the van Emde Boas order of a tree of ``height``."""
    place = np.zeros_like(index)
    while depth:
        above, upper, lower = splits(height)[depth]
        below = FAN ** (depth - above)
        place += upper + index % below * lower
        depth, index = above, index // below
    return place


@cache
def addresses(height: int) -> tuple[tuple[int, ...], ...]:
    """The places of all nodes of a block, by depth and index."""
    return tuple(tuple(address(height, d, np.arange(FAN**d)).tolist()) for d in range(height + 1))


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def least_height(n: int) -> int:
    height = 0
    while FAN**height < n:
        height += 1
    return height


def block_nodes(leaves: list[str], height: int) -> bytes:
    """A block's digests in van Emde Boas order; zeros where the tree has no node."""
    places = addresses(height)
    out = ["0" * (2 * DIGEST)] * nodes_of(height + 1)
    level = leaves
    for depth in range(height, -1, -1):
        for place, digest in zip(places[depth], level):
            out[place] = digest
        level = [joined(level[i : i + FAN]) for i in range(0, len(level), FAN)] if depth else level
    return bytes.fromhex("".join(out))


def sibling_runs(nodes: str, n: int, height: int, index: int) -> list[tuple[int, list[str]]]:
    """(place among them, the others) of a leaf's run on each level of a block, from below; ``nodes`` in hex."""
    places, runs = addresses(height), []
    for depth in range(height, 0, -1):
        first = index - index % FAN
        others = [places[depth][i] for i in range(first, min(first + FAN, n)) if i != index]
        runs.append((index - first, [nodes[64 * p : 64 * p + 64] for p in others]))
        index, n = index // FAN, -(-n // FAN)
    return runs


def fold(digest: str, runs: list[tuple[int, list[str]]]) -> str:
    for place, others in runs:
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def packed(runs: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(struct.pack("BB", place, len(others)) + bytes.fromhex("".join(others)) for place, others in runs)


def unpacked(data: bytes) -> list[tuple[int, list[str]]]:
    runs, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        text = data[at + 2 : at + 2 + DIGEST * n].hex()
        runs.append((place, [text[64 * i : 64 * i + 64] for i in range(n)]))
        at += 2 + DIGEST * n
    return runs


def record_digest(columns: list[Column]) -> Column:
    """SHA-256 of a row: each value as its number of UTF-8 bytes, a colon and its text; a null as a hyphen."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (grp, id, leaf, claim) with ``index``: the place in their group by id and leaf, nulls first, from 0.

    Rows are sorted by ranges of (group, id, leaf, row), so a hot group or id is spread over many tasks, and numbered
    where they lie. Only a partition's first group can have begun before it; where it goes on is found from two counts
    per partition, all that the driver sees.
    """
    order = ["grp", "id", "leaf", "row"]
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.drop("row")).withColumn("pid", F.spark_partition_id())
    counts = rows.groupBy("pid", "grp").count().groupBy("pid").agg(
        F.md5(F.min("grp")).alias("low"), F.md5(F.max("grp")).alias("high"),
        F.min_by("count", "grp").alias("n_low"), F.max_by("count", "grp").alias("n_high"),
    )
    offsets, group, so_far = {}, None, 0
    for r in sorted(counts.collect()):
        offsets[r.pid] = so_far if r.low == group else 0
        so_far = offsets[r.pid] + r.n_low if r.low == r.high else r.n_high
        group = r.high

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group, following = None, 0
        for frame in frames:
            if not len(frame):
                continue
            groups, at = frame["grp"].to_numpy(object), np.arange(len(frame))
            starts = np.concatenate(([True], groups[1:] != groups[:-1]))
            index = at - np.maximum.accumulate(np.where(starts, at, 0))
            if open_group is None:
                following = offsets.get(int(frame["pid"].iloc[0]), 0)
            elif groups[0] != open_group:
                following = 0
            index[: np.flatnonzero(starts)[1] if starts.sum() > 1 else len(index)] += following
            open_group, following = groups[-1], int(index[-1]) + 1
            yield frame.drop(columns="pid").assign(index=index)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(number, f"grp string, id {kinds['id']}, leaf binary, claim binary, index long")


def blocks_of(leaves: DataFrame) -> DataFrame:
    """(grp, block, n, height, nodes, claims, ids) out of (grp, index, leaf, claim, id)."""
    kind = dict(leaves.dtypes)["id"]
    rows = leaves.withColumns({"block": F.expr(f"index div {LEAVES}"), "place": F.col("index") % LEAVES})

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def built(rows: pd.DataFrame) -> pd.DataFrame:
            blocks, groups = rows["block"].to_numpy(), rows["grp"].to_numpy(object)
            edges = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (groups[1:] != groups[:-1]), [True])))
            digests, claims, ids, out = rows["leaf"].tolist(), rows["claim"].tolist(), rows["id"].tolist(), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                height = HEIGHT if blocks[a] else least_height(b - a)
                nodes = block_nodes([bytes(x).hex() for x in digests[a:b]], height)
                own = [None if x != x else x for x in ids[a:b]]
                out.append((groups[a], blocks[a], b - a, height, nodes, b"".join(map(bytes, claims[a:b])), own))
            return pd.DataFrame(out, columns=["grp", "block", "n", "height", "nodes", "claims", "ids"])

        held: pd.DataFrame | None = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = rows.iloc[-1] if len(rows) else None
            if last is None:
                continue
            open_rows = ((rows["grp"] == last["grp"]) & (rows["block"] == last["block"])).to_numpy()
            cut = len(rows) - int(open_rows.sum())
            if cut:
                yield built(rows.iloc[:cut])
            held = rows.iloc[cut:]
        if held is not None and len(held):
            yield built(held)

    # Nullable integers would come as floats, which are not exact.
    sent = rows.withColumn("id", F.col("id").cast("string")) if kind != "string" else rows
    sent = sent.select("grp", "block", "place", "leaf", "claim", "id").repartition("grp", "block")
    found = sent.sortWithinPartitions("grp", "block", "place").mapInPandas(build, f"grp string, {BLOCK}, ids array<string>")
    return found.withColumn("ids", F.col("ids").cast(f"array<{kind}>"))


@dataclass
class Forest:
    """One tree per group: its levels of blocks, and (grp, level, digest) of each tree's root with its topmost level."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, folder: str) -> Forest:
    """Write the blocks of all levels below ``folder``. Levels grow with the logarithm of the largest group."""
    spark, levels, roots = leaves.sparkSession, [], []
    while True:
        path = f"{folder}/level={len(levels)}"
        blocks_of(leaves).write.parquet(path)
        levels.append(spark.read.parquet(path))
        tops = levels[-1].select("grp", F.col("block").alias("index"), F.substring("nodes", 1, DIGEST).alias("leaf"))
        # One row per group that goes on: no key is hot on either side.
        more = tops.where("index = 1").select("grp")
        first = tops.where("index = 0")
        ended = first.join(more, "grp", "left_anti").select("grp", F.lit(len(levels) - 1).alias("level"), F.col("leaf").alias("digest"))
        roots.append(ended)
        if more.isEmpty():
            break
        going = first.join(more, "grp", "left_semi").union(tops.where("index > 0"))
        leaves = going.withColumns({"claim": F.col("leaf"), "id": F.lit(None).cast("string")})
    found = roots[0]
    for r in roots[1:]:
        found = found.union(r)
    return Forest(levels, found)


def unfold(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, index, id, path, subroot, root) of all leaves of ``blocks`` by what lies ``above`` (grp, block, path, ...)."""
    kind = dict(blocks.dtypes)["ids"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                nodes, n = bytes(r.nodes).hex(), int(r.n)
                path = [packed(sibling_runs(nodes, n, int(r.height), i)) + bytes(r.path) for i in range(n)]
                yield pd.DataFrame({
                    "grp": r.grp, "index": np.arange(n) + LEAVES * int(r.block), "id": list(r.ids), "path": path,
                    "subroot": [r.subroot] * n, "root": [r.root] * n,
                })

    both = blocks.withColumn("ids", F.col("ids").cast("array<string>")).join(above, ["grp", "block"])
    found = both.mapInPandas(read, "grp string, index long, id string, path binary, subroot binary, root binary")
    return found.withColumn("id", F.col("id").cast(kind[6:-1]))


def above_leaves(forest: Forest, start: DataFrame) -> DataFrame:
    """(grp, block, path, subroot, root) for the blocks of the lowest level, from ``start`` (grp, path, subroot, root)."""
    above = None
    for level in reversed(range(len(forest.levels))):
        here = start.join(forest.roots.where(F.col("level") == level), "grp", "left_semi")
        here = here.select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if above is not None:
            found = unfold(forest.levels[level + 1], above)
            here = here.union(found.select("grp", F.col("index").alias("block"), "path", "subroot", "root"))
        above = checkpointed(here)
    return above


@dataclass
class Manifest:
    """The trees of the groups, and the tree over their roots: its groups are the rows, its one group is empty."""

    groups: Forest
    top: Forest


def build(rows: DataFrame, folder: str) -> Manifest:
    """The manifest of (grp, id, leaf, claim), written below ``folder``, which all executors reach."""
    groups = grow(ranked(rows), f"{folder}/groups")
    subroots = groups.roots.select(
        F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("digest").alias("leaf"), F.col("digest").alias("claim")
    )
    return Manifest(groups, grow(ranked(subroots), f"{folder}/top"))


def audit(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, folded over its claim."""
    none = F.lit(b"").alias("path")
    root = manifest.top.roots.select("grp", none, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    # The rows of the top tree are the groups.
    tops = unfold(manifest.top.levels[0], above_leaves(manifest.top, root))
    own = manifest.groups.roots.select("grp", F.col("digest").alias("subroot"))
    start = tops.select(F.col("id").alias("grp"), "path", "root").join(own, "grp").select("grp", "path", "subroot", "root")
    blocks = manifest.groups.levels[0]
    kind = dict(blocks.dtypes)["ids"]

    def prove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                nodes, claims, n, height = bytes(r.nodes).hex(), bytes(r.claims).hex(), int(r.n), int(r.height)
                above, rows, places = unpacked(bytes(r.path)), [], addresses(height)[height]
                subroot, root = bytes(r.subroot).hex(), bytes(r.root).hex()
                over = "".join(x for _, others in above for x in others)
                reached: dict[str, str] = {}  # the root over each digest of the block's root that rows fold to
                for i, id_ in enumerate(r.ids):
                    runs = sibling_runs(nodes, n, height, i)
                    proof = sha256(("".join(x for _, others in runs for x in others) + over).encode()).hexdigest()
                    inside = fold(claims[64 * i : 64 * i + 64], runs)
                    folded = reached.get(inside) or reached.setdefault(inside, fold(inside, above))
                    at = 64 * places[i]
                    rows.append((id_, nodes[at : at + 64], subroot, root, proof, folded, folded == root))
                yield pd.DataFrame(rows, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    both = blocks.withColumn("ids", F.col("ids").cast("array<string>")).join(
        reshuffled(above_leaves(manifest.groups, start), "grp"), ["grp", "block"]
    )
    found = both.mapInPandas(
        prove, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return found.withColumn("id", F.col("id").cast(kind[6:-1]))


def manifest_rows(df: DataFrame, columns: list[str], identity: str, group: str, claimed: dict[str, Column] | None = None) -> DataFrame:
    """(grp, id, leaf, claim) of ``df``: ``columns`` are hashed in order, for the claim with ``claimed`` in their place.

    A null group is a group of its own and comes first; groups are ordered by their UTF-8 bytes.
    """
    own = [F.col(f"`{c}`") for c in columns]
    leaf = record_digest(own)
    claim = leaf
    if claimed:
        seen = [claimed.get(c, F.col(f"`{c}`")) for c in columns]
        differ = F.lit(False)
        for c, s in zip(own, seen):
            if s is not c:
                differ = differ | ~s.eqNullSafe(c)
        claim = F.when(differ, record_digest(seen)).otherwise(leaf)
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    return df.select(grp.alias("grp"), F.col(f"`{identity}`").alias("id"), leaf.alias("leaf"), claim.alias("claim"))


def audited(
    spark: SparkSession, df: DataFrame, folder: str, columns: list[str], identity: str = "doc_id", group: str = "source",
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """Build the manifest of ``df`` below ``folder`` and check every row, as ``claimed``, against its root.

    One row per row of ``df``: the id with the digests of ``audit``, in hexadecimal. Rows of a group are ordered by id,
    null first, and equal ids by their digests, so repeated rows are leaves of their own with one defined order; other
    columns are not read. An empty table has no root and gives no rows. A claim that changes a row to a text that was
    the same before still verifies.
    """
    return audit(build(manifest_rows(df, columns, identity, group, claimed), folder))
